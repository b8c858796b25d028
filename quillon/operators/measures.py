"""Evaluation aggregates. What is undefined is null, never 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def running(rows: DataFrame, order: str, sums: dict[str, Column], tie: str | None = None, descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds running sums over all rows (of each group `by`) in order, without one task that holds them all.

    Rows are dealt by ranges of the order's value (equal values stay together), summed within their range, and moved by what the ranges
    before hold. The driver holds the ranges' bounds, two to a shuffle partition; the ranges' sums are so many rows a group. Nulls come last.
    """
    spark = rows.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = F.array(*[F.lit(b).cast(rows.schema[order].dataType) for b in sorted(set(bounds))]) if bounds else F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>")
    place = F.size(F.filter(cuts, lambda b: b < F.col(order)))
    place = F.when(F.col(order).isNull(), parts).otherwise(-place if descending else place)
    dealt = rows.withColumn("__place", place).withColumns({f"__{k}": c for k, c in sums.items()})
    offsets = dealt.groupBy(*by, "__place").agg(*[F.sum(f"__{k}").alias(f"__all_{k}") for k in sums])
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = offsets.select(*by, "__place", *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums])
    first = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    within = Window.partitionBy(*by, "__place").orderBy(first, *([tie] if tie else []))
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow) if tie else within
    offsets = offsets if by else F.broadcast(offsets)  # one row a range
    joined = dealt.withColumns({f"__sum_{k}": F.sum(f"__{k}").over(within) for k in sums}).join(offsets, [*by, "__place"])
    return joined.select(*rows.columns, *[(F.col(f"__sum_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def retrieval_scores(ranked: DataFrame, gold: DataFrame, queries: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """query, recall, precision, rr, ndcg and hits at k of every query; null for queries without gold."""
    hits = ranked.where(F.col("rank") <= k).join(gold.select(query, doc).distinct(), [query, doc]).groupBy(query).agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    size = gold.select(query, doc).distinct().groupBy(query).agg(F.count("*").alias("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    rows = queries.select(query).distinct().join(size, query, "left").join(hits, query, "left")
    known = F.col("gold").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        query, F.when(known, F.round(zero(F.col("hits")) / F.col("gold"), 6)).alias("recall"), F.when(known, F.round(zero(F.col("hits")) / k, 6)).alias("precision"),
        F.when(known, F.round(zero(1 / F.col("first")), 6)).alias("rr"), F.when(known, F.round(zero(F.col("dcg")) / F.when(known, ideal), 6)).alias("ndcg"), zero(F.col("hits")).cast("bigint").alias("hits"),
    )


def macro_micro(rows: DataFrame, stratum: str, value: str) -> DataFrame:
    """One row: macro (mean of the strata's means) and micro (mean of all)."""
    return rows.groupBy(stratum).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n")).agg(F.round(F.avg("m"), 6).alias("macro"), F.round(ratio(F.sum("s"), F.sum("n")), 6).alias("micro"))


def brier_ece(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """One row: brier and ece (equal-width bins)."""
    binned = rows.select(F.col(score).alias("s"), F.col(label).cast("double").alias("y")).withColumn("b", F.least(F.lit(bins - 1), F.floor(F.col("s") * bins)))
    each = binned.groupBy("b").agg(F.count("*").alias("n"), F.avg("s").alias("ms"), F.avg("y").alias("my"), F.sum((F.col("s") - F.col("y")) ** 2).alias("e"))
    return each.agg(F.round(F.sum("e") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.abs(F.col("ms") - F.col("my")) * F.col("n")) / F.sum("n"), 6).alias("ece"))


def auroc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs in order, ties as half; null without both labels.

    Equal scores are summed first; the distinct ones are summed up by ranges.
    """
    each = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"))
    upto = running(each, "s", {"upto": F.col("n")})
    summed = upto.withColumn("w", F.col("p") * (F.col("upto") - F.col("n") / 2)).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return summed.select(F.round(ratio(F.col("w"), F.col("p") * F.col("n")), 6).alias("auroc"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n11, n10, n01, n00 of two 0/1 columns."""
    cell = lambda x, y: F.coalesce(F.sum(F.when((F.col(a) == x) & (F.col(b) == y), 1).otherwise(0)), F.lit(0)).cast("double")
    return rows.agg(cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"))


def phi_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: phi and Cohen's kappa; null where a margin is empty."""
    t = contingency(rows, a, b)
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    r1, r0, c1, c0 = F.col("n11") + F.col("n10"), F.col("n01") + F.col("n00"), F.col("n11") + F.col("n01"), F.col("n10") + F.col("n00")
    phi = ratio(F.col("n11") * F.col("n00") - F.col("n10") * F.col("n01"), F.sqrt(r1 * r0 * c1 * c0))
    agreed, chance = (F.col("n11") + F.col("n00")) / n, (r1 * c1 + r0 * c0) / (n * n)
    return t.select(F.round(phi, 6).alias("phi"), F.round(ratio(agreed - chance, 1 - chance), 6).alias("kappa"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 and dof of independence; all cells of the table count, empty ones too."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    whole, by_a, by_b = Window.partitionBy(F.lit(0)), Window.partitionBy("a"), Window.partitionBy("b")
    rows_ = cells.withColumns({"n": F.sum("o").over(whole), "r": F.sum("o").over(by_a), "c": F.sum("o").over(by_b)})
    e = F.col("r") * F.col("c") / F.col("n")
    return rows_.agg(F.round(F.sum(F.col("o") * F.col("o") / e) - F.max("n"), 6).alias("chi2"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("dof"))


def midranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the mid-rank of a column: equal values share the mean of their places."""
    each = rows.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    upto = running(each, "__v", {"__upto": F.col("__n")})
    ranks = upto.select("__v", (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
    return rows.join(ranks, rows[value] == ranks["__v"]).drop("__v")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    ranked = midranks(midranks(rows.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "__ra"), b, "__rb")
    return ranked.agg(F.round(F.corr("__ra", "__rb"), 6).alias("spearman"))


def percentiles(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """group, linear, nearest_rank (ceil(p n)), index_rule (floor(p n), held in range): three rules for one percentile. Places are running
    counts of a group's distinct values, so a hot group is no one task."""
    known = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    each = known.groupBy(group, value).agg(F.count("*").alias("c"))
    ranked = running(each, value, {"upto": F.col("c")}, by=(group,)).join(each.groupBy(group).agg(F.sum("c").alias("n")), group)
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col(value)))
    pn = F.round(F.lit(p) * F.col("n"), 9)
    places = ranked.groupBy(group).agg(at(F.greatest(F.lit(1), F.ceil(pn))).alias("nearest_rank"), at(F.least(F.col("n"), F.floor(pn) + 1)).alias("index_rule"))
    return known.groupBy(group).agg(F.round(F.expr(f"percentile({value}, {p})"), 6).alias("linear")).join(places, group)


def risk_coverage(rows: DataFrame, score: str, wrong: str) -> DataFrame:
    """threshold, coverage and risk at each distinct score, from the greatest down."""
    each = rows.groupBy(F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(wrong).cast("int")).alias("bad"))
    cum = running(each, "threshold", {"a": F.col("n"), "r": F.col("bad")}, descending=True).crossJoin(F.broadcast(each.agg(F.sum("n").alias("t"))))  # one row
    return cum.select("threshold", F.round(F.col("a") / F.col("t"), 6).alias("coverage"), F.round(F.col("r") / F.col("a"), 6).alias("risk"))


def area(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the trapezoid area under y over x. Each point meets the one before it by its number in the order."""
    numbered = running(curve.select(x, y), x, {"__i": F.lit(1)}, tie=y)
    last = numbered.select((F.col("__i") + 1).alias("__i"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    return numbered.join(last, "__i").agg(F.round(F.coalesce(F.sum((F.col(x) - F.col("__x")) * (F.col(y) + F.col("__y")) / 2), F.lit(0.0)), 6).alias("area"))


def log_area(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group and area: the trapezoid area under y over log2 x, as a share of the width; null for fewer than two points."""
    w = Window.partitionBy(group).orderBy(x)
    steps = points.withColumns({"__x": F.lag(F.log2(x)).over(w), "__y": F.lag(y).over(w), "__l": F.log2(x)})
    each = steps.groupBy(group).agg(F.sum((F.col("__l") - F.col("__x")) * (F.col(y) + F.col("__y")) / 2).alias("a"), (F.max("__l") - F.min("__l")).alias("w"))
    return each.select(group, F.round(ratio(F.col("a"), F.col("w")), 6).alias("area"))


def interaction(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """One row: s0, a, b, ab and contrast S(AB) - S(A) - S(B) + S0 of the arms none, a, b and ab, and its reading."""
    mean = lambda name: F.avg(F.when(F.col(arm) == name, F.col(value)))
    t = rows.agg(mean("none").alias("s0"), mean("a").alias("a"), mean("b").alias("b"), mean("ab").alias("ab"))
    c = F.round(F.col("ab") - F.col("a") - F.col("b") + F.col("s0"), 6)
    reading = F.when(c.isNull(), "unknown").when(c > 0, "synergy").when(c < 0, "interference").otherwise("additive")
    return t.select(*[F.round(x, 6).alias(x) for x in ("s0", "a", "b", "ab")], c.alias("contrast"), reading.alias("reading"))


def gap_closed(value: Column, floor: Column, ceiling: Column) -> Column:
    """The share of the way from floor to ceiling; null where there is none."""
    return F.round(ratio(value - floor, ceiling - floor), 6)


def rank_shares(rows: DataFrame, value: str) -> DataFrame:
    """Adds share (the mid-rank over the number of rows, 0 to 1), decile (0 to 9) and tercile (0 to 2)."""
    known = rows.where(F.col(value).isNotNull())
    ranked = midranks(known, value, "__r").crossJoin(F.broadcast(known.agg(F.count("*").alias("__n"))))  # one row
    share = (F.col("__r") - 0.5) / F.col("__n")
    bin_ = lambda k: F.least(F.lit(k - 1), F.floor(F.round(share * k, 9))).cast("int")
    return ranked.select(*rows.columns, F.round(share, 6).alias("share"), bin_(10).alias("decile"), bin_(3).alias("tercile"))


def conditional_rate(rows: DataFrame, by: list[str], event: Column, given: Column) -> DataFrame:
    """by, given and rate: how often the event holds where the condition does; null where it never does."""
    return rows.groupBy(*by).agg(F.sum(given.cast("bigint")).alias("given"), F.round(F.avg(F.when(given, event.cast("int"))), 6).alias("rate"))


def confident_wrong(rows: DataFrame, by: str, confidence: str, correct: str, least: float) -> DataFrame:
    """by, n and rate: the share of answers that are wrong though their confidence is at least `least`."""
    sure_and_wrong = (F.col(confidence) >= least) & (F.col(correct) == 0)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(sure_and_wrong.cast("int")), 6).alias("rate"))


def icc(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: one-way intraclass correlation with n0, held between 0 and 1; null for fewer than two groups or no spare rows."""
    each = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = each.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("w"))
    k, big = F.col("k"), F.col("N")
    between, within = ratio(F.col("s2") - F.col("s") ** 2 / big, k - 1), ratio(F.col("w"), big - k)
    n0 = ratio(big - F.col("n2") / big, k - 1)
    return t.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(between - within, between + (n0 - 1) * within))), 6).alias("icc"))


def entropy(rows: DataFrame, group: str, term: str) -> DataFrame:
    """group and the Shannon entropy (bits) of its terms."""
    counts = rows.groupBy(group, term).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(group))
    return counts.withColumn("p", p).groupBy(group).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def first_wins(rows: DataFrame, key: Column, order: list[str], labels: str) -> DataFrame:
    """One row a key: the first in order, with all labels of the key's rows, sorted."""
    keyed = rows.withColumn("__key", key)
    w = F.struct(*order)
    kept = keyed.groupBy("__key").agg(F.min_by(F.struct(*rows.columns), w).alias("row"), F.array_join(F.sort_array(F.collect_set(labels)), ",").alias("labels"))
    return kept.select("row.*", "labels")


def expanding_percentile(rows: DataFrame, channel: str, order: str, value: str) -> DataFrame:
    """Adds percentile: the mid-rank of each reading among the earlier ones of its channel; null for the first. Channels come sorted, batch by
    batch; a task holds the sorted readings of the channel that it reads."""
    import bisect

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != order]
    dealt = rows.repartition(channel).sortWithinPartitions(channel, order).drop(order)

    def run(frames):
        last, seen = None, []
        for pdf in frames:
            out = []
            for name, x in zip(pdf[channel].tolist(), pdf[value].tolist()):
                if name != last:
                    last, seen = name, []
                low, high = bisect.bisect_left(seen, x), bisect.bisect_right(seen, x)
                out.append(round((low + (high - low) / 2) / len(seen), 6) if seen else None)
                seen.insert(high, x)
            yield pdf.assign(percentile=pd.array(out, dtype="Float64"))

    return dealt.mapInPandas(run, ", ".join([*names, "percentile double"]))
