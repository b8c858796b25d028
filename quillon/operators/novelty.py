"""Repetition and novelty of texts in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions.text import ascii_tokens, ngrams


def grams_of(items: DataFrame, key: list[str], text: str, n: int) -> DataFrame:
    """key and gram, one row a distinct n-gram."""
    tokens = items.select(*key, ascii_tokens(F.col(text)).alias("__tokens"))  # a column: inside ngrams() the expression would run for each place
    return tokens.select(*key, F.explode(ngrams(F.col("__tokens"), n)).alias("gram"))


def union_novelty(grams: DataFrame, group: str, order: str) -> DataFrame:
    """group, order, grams and novelty: the share of an item's grams that no earlier item of its group has."""
    first = F.min(order).over(Window.partitionBy(group, "gram"))
    marked = grams.withColumn("__new", (F.col(order) == first).cast("int"))
    return marked.groupBy(group, order).agg(F.count("*").alias("grams"), F.round(F.avg("__new"), 6).alias("novelty"))


def repetition(grams: DataFrame, group: str, order: str, window: int) -> DataFrame:
    """group, order, repetition: the greatest share of an item's grams that one item of the `window` places before it holds.

    Pairs meet on a shared gram within a group, so items without any are never paired.
    """
    sizes = grams.groupBy(group, order).agg(F.count("*").alias("__n"))
    earlier = grams.select(F.col(group).alias("__g"), F.col(order).alias("__o"), F.col("gram").alias("__gram"))
    shared = grams.join(earlier, (F.col(group) == F.col("__g")) & (F.col("gram") == F.col("__gram")) & (F.col("__o") < F.col(order)) & (F.col("__o") >= F.col(order) - window))
    best = shared.groupBy(group, order, "__o").agg(F.count("*").alias("__c")).groupBy(group, order).agg(F.max("__c").alias("__c"))
    return sizes.join(best, [group, order], "left").select(group, order, F.round(F.coalesce("__c", F.lit(0)) / F.col("__n"), 6).alias("repetition"))


def expanding_surprisal(tokens: DataFrame, group: str, order: str) -> DataFrame:
    """group, order and surprisal: the mean -ln p of an item's tokens under the add-one smoothed counts of the items before it (of
    the same group). tokens: group, order, term, tf."""
    before = F.coalesce(F.sum("tf").over(Window.partitionBy(group, "term").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = F.row_number().over(Window.partitionBy(group, "term").orderBy(order))
    marked = tokens.withColumns({"__c": before, "__first": (seen == 1).cast("int")})
    items = marked.groupBy(group, order).agg(F.sum("tf").alias("__dl"), F.sum("__first").alias("__fresh"))
    w = Window.partitionBy(group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    totals = items.withColumns({"__total": F.coalesce(F.sum("__dl").over(w), F.lit(0)), "__vocab": F.coalesce(F.sum("__fresh").over(w), F.lit(0))})
    p = (F.col("__c") + 1) / (F.col("__total") + F.col("__vocab") + 1)
    return marked.join(totals, [group, order]).groupBy(group, order).agg(F.round(F.sum(-F.log(p) * F.col("tf")) / F.sum("tf"), 6).alias("surprisal"))
