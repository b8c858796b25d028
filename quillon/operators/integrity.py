"""Declarative rules over logs and tables: each violation is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def violations(log: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule of every rule that a row breaks (a null condition is no breach); one pass over the log."""
    broken = F.array_compact(F.array(*[F.when(breach, F.lit(name)) for name, breach in rules.items()]))
    return log.select(key, F.explode(broken).alias("rule"))


def duplicates(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("duplicate-id").alias("rule"))


def dangling(rows: DataFrame, ref: str, targets: DataFrame, key: str) -> DataFrame:
    """References without a target."""
    named = targets.select(F.col(key).alias("__k"))
    return rows.where(F.col(ref).isNotNull()).join(named, F.col(ref) == F.col("__k"), "left_anti")


def set_audit(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """key and status: missing (planned, not done), extra (done, not planned), repeated (done more than once)."""
    counted = done.groupBy(*key).agg(F.count("*").alias("__n"))
    wanted = planned.select(*key).distinct()
    missing = wanted.join(counted, key, "left_anti").select(*key, F.lit("missing").alias("status"))
    extra = counted.join(wanted, key, "left_anti").select(*key, F.lit("extra").alias("status"))
    return missing.unionByName(extra).unionByName(counted.where("__n > 1").select(*key, F.lit("repeated").alias("status")))


def supersession_cycles(log: DataFrame, key: str, supersedes: str, order: str) -> DataFrame:
    """Rows that supersede a row which does not come before them."""
    before = log.select(F.col(key).alias("__k"), F.col(order).alias("__o"))
    return log.join(before, F.col(supersedes) == F.col("__k")).where(F.col("__o") >= F.col(order)).select(key, F.lit("supersedes-later").alias("rule"))


def span_coverage(spans: DataFrame, key: str, size: Column) -> DataFrame:
    """key, covered, exact: whether spans [char_start, char_end) in order cover 0..size without a gap."""
    w = Window.partitionBy(key).orderBy("char_start", "char_end")
    reach = F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumns({"__gap": F.greatest(F.lit(0), F.col("char_start") - F.coalesce(reach, F.lit(0))), "__size": size})
    return marked.groupBy(key).agg((F.max("char_end") - F.sum("__gap")).alias("covered"), ((F.sum("__gap") == 0) & (F.max("char_end") == F.max("__size"))).alias("exact"))


def split_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: shared, only_a and only_b of two sets of keys."""
    both = a.select(key).distinct().withColumn("__a", F.lit(1)).join(b.select(key).distinct().withColumn("__b", F.lit(1)), key, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    x, y = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.agg(count(x & y).alias("shared"), count(x & ~y).alias("only_a"), count(~x & y).alias("only_b"))


def comparable(contracts: DataFrame, run: str, fields: list[str]) -> DataFrame:
    """One row: runs, contracts (distinct) and comparable."""
    rows = contracts.select(run, F.to_json(F.struct(*fields)).alias("__c"))
    return rows.agg(F.countDistinct(run).alias("runs"), F.countDistinct("__c").alias("contracts"), (F.countDistinct("__c") == 1).alias("comparable"))


def checked_numbers(published: DataFrame, computed: DataFrame, key: str, digits: int) -> DataFrame:
    """key, published, computed and holds: whether the published number is the computed one at its decimals."""
    both = published.select(key, F.col("value").alias("published")).join(computed.select(key, F.col("value").alias("computed")), key, "left")
    return both.withColumn("holds", F.coalesce(F.round("computed", digits) == F.round("published", digits), F.lit(False)))
