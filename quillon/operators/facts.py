"""Append-only facts on two time axes: ends, views and joins as of an instant.

A fact has a chain (what it is about), valid_from and recorded, and an id. Its successor is the next fact of its chain. Ends are
derived, never stored; they are exclusive unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def active_view(log: DataFrame, key: str = "id", supersedes: str = "supersedes") -> DataFrame:
    """The rows that no row supersedes."""
    gone = log.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("__gone")).distinct()
    return log.join(gone, log[key] == gone["__gone"], "left_anti")


def with_successor(facts: DataFrame, chain: list[str], order: list[str], key: str = "id") -> DataFrame:
    """Adds successor, valid_to (the successor's valid_from) and expired_at (its recorded)."""
    w = Window.partitionBy(*chain).orderBy(*order)
    return facts.withColumns({"successor": F.lead(key).over(w), "valid_to": F.lead("valid_from").over(w), "expired_at": F.lead("recorded").over(w)})


def version_rank(facts: DataFrame, chain: list[str], order: list[str]) -> DataFrame:
    """Adds version (1 is the newest) to each fact of its chain."""
    return facts.withColumn("version", F.row_number().over(Window.partitionBy(*chain).orderBy(*[F.col(c).desc() for c in order])))


def nth_before_latest(facts: DataFrame, chain: list[str], order: list[str], n: int) -> DataFrame:
    return version_rank(facts, chain, order).where(F.col("version") == n + 1).drop("version")


def latest(facts: DataFrame, chain: list[str], order: list[str]) -> DataFrame:
    """One row a chain: the last in order, by a partially aggregated max_by, so that a hot chain is no hot task."""
    row = F.struct(*[F.col(c) for c in facts.columns])
    return facts.groupBy(*chain).agg(F.max_by(row, F.struct(*order)).alias("row")).select("row.*")


def valid_at(facts: DataFrame, at: Column, chain: list[str], order: list[str], end_inclusive: bool = False) -> DataFrame:
    """On the valid axis: the last fact of each chain with valid_from <= at; explicit ends (valid_until) exclude it."""
    seen = latest(facts.where(F.col("valid_from") <= at), chain, order)
    if "valid_until" not in facts.columns:
        return seen
    open_ = F.col("valid_until").isNull() | (F.col("valid_until") >= at if end_inclusive else F.col("valid_until") > at)
    return seen.where(open_)  # an expired winner revives nothing


def as_known_at(facts: DataFrame, known: Column, chain: list[str], order: list[str]) -> DataFrame:
    """On the transaction axis: the last fact of each chain recorded by then."""
    return latest(facts.where(F.col("recorded") <= known), chain, order)


def bitemporal(facts: DataFrame, valid: Column, known: Column, chain: list[str], order: list[str]) -> DataFrame:
    return latest(facts.where((F.col("recorded") <= known) & (F.col("valid_from") <= valid)), chain, order)


def as_of_join(probes: DataFrame, facts: DataFrame, chain: list[str], at: str, since: str, tie: str, strict: bool = False) -> DataFrame:
    """Each probe with the last fact of its chain at or before its instant (strict: before), by one shuffle on the chain.

    Probes and facts are put in one order per chain; the last fact so far is carried along it. No pair is formed.
    """
    values = [c for c in facts.columns if c not in chain]
    left = probes.select(*chain, F.col(at).alias("__t"), F.lit(1 if not strict else -1).alias("__side"), F.struct(*[F.col(c) for c in probes.columns]).alias("__probe"), F.lit(None).cast(facts.select(F.struct(*values)).schema[0].dataType).alias("__fact"), F.lit(None).cast(facts.schema[tie].dataType).alias("__tie"))
    right = facts.select(*chain, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"), F.struct(*values).alias("__fact"), F.col(tie).alias("__tie"))
    w = Window.partitionBy(*chain).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("__last", F.last("__fact", ignorenulls=True).over(w)).where(F.col("__probe").isNotNull())
    return carried.select("__probe.*", *[F.col("__last")[c].alias(f"fact_{c}") for c in values])


def overlapping(facts: DataFrame, spans: DataFrame, on: list[str], bucket_seconds: int) -> DataFrame:
    """Facts [valid_from, valid_to) joined with spans [low, high) of the same key that they overlap.

    Both sides are cut into time buckets of a fixed width and joined on key and bucket; a pair is kept in the bucket in which
    the later of both begins, so it occurs once.
    """
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.unix_timestamp(a) / bucket_seconds), F.floor(F.unix_timestamp(b) / bucket_seconds)))
    a = facts.withColumn("__b", cut("valid_from", "valid_to"))
    b = spans.withColumn("__b", cut("low", "high"))
    later = F.floor(F.unix_timestamp(F.greatest("valid_from", "low")) / bucket_seconds)
    return a.join(b, [*on, "__b"]).where((F.col("valid_from") < F.col("high")) & (F.col("low") < F.col("valid_to")) & (later == F.col("__b"))).drop("__b")


def within_days(items: DataFrame, group: list[str], day: str, days: int, kind: str) -> DataFrame:
    """Adds earlier and kinds: how many items stand on the `days` days before each item's day (not on it), and of which kinds (a set: as many
    as there are kinds, not items)."""
    w = Window.partitionBy(*group).orderBy(day).rangeBetween(-days, -1)
    return items.withColumns({"earlier": F.count("*").over(w), "kinds": F.collect_set(kind).over(w)})


def timeline(log: DataFrame, order: list[str], limit: int, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The last events, newest first; the limit is held between 1 and 200."""
    rows = log.where(F.col("kind").isin(*kinds)) if kinds else log
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(min(200, max(1, limit)))


def monotone_breaks(log: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is less than that of the row before."""
    w = Window.partitionBy(*group).orderBy(order)
    return log.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before"))


def merged_spans(spans: DataFrame, key: list[str], low: str = "low", high: str = "high") -> DataFrame:
    """key, spans, covered: the number of merged spans [low, high) and the length that they cover."""
    w = Window.partitionBy(*key).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(low) < F.col(high)).withColumn("__new", (reach.isNull() | (F.col(low) > reach)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    runs = marked.groupBy(*key, "__run").agg(F.min(low).alias("a"), F.max(high).alias("b"))
    return runs.groupBy(*key).agg(F.count("*").alias("spans"), F.sum(F.col("b") - F.col("a")).alias("covered"))
