"""Association and fact graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def shared_edges(refs: DataFrame, item: str, ref: str, most_refs: int | None = None) -> DataFrame:
    """a < b and support: how many references two items share. most_refs: references of more items say nothing and are left out
    (a stop list by document count, a parameter of the graph, not of the engine)."""
    rows = refs.select(item, ref).distinct()
    if most_refs is not None:
        rows = rows.join(rows.groupBy(ref).count().where(F.col("count") <= most_refs).select(ref), ref, "left_semi")
    left, right = rows.select(F.col(item).alias("a"), ref), rows.select(F.col(item).alias("b"), ref)
    return left.join(right, ref).where("a < b").groupBy("a", "b").agg(F.count("*").alias("support"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "support").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "support"))


def neighbours(seeds: DataFrame, edges: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """query, item, support, rank: the items one hop from a query's seeds, seeds left out, by (-support, item)."""
    around = seeds.select(query, F.col(item).alias("a")).join(both_ways(edges), "a").groupBy(query, F.col("b").alias(item)).agg(F.sum("support").alias("support"))
    fresh = around.join(seeds.select(query, item), [query, item], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("support").desc(), item))).where(F.col("rank") <= k)


def spread(direct: DataFrame, edges: DataFrame, query: str, item: str, k: int, decay: float, cap: float) -> DataFrame:
    """query, item, weight: direct weights, and for each weighted item its k strongest neighbours at decay times its weight; sums are
    capped."""
    top = both_ways(edges).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("support").desc(), "b"))).where(F.col("r") <= k)
    sent = direct.select(query, F.col(item).alias("a"), "weight").join(top, "a").select(query, F.col("b").alias(item), (F.col("weight") * decay).alias("weight"))
    return direct.select(query, item, "weight").unionByName(sent).groupBy(query, item).agg(F.round(F.least(F.lit(cap), F.sum("weight")), 6).alias("weight"))


def paths(edges: DataFrame, starts: DataFrame, hops: int, limit: int) -> DataFrame:
    """start, path (array), hops: simple paths of directed edges s -> o from the starts; of each start at most `limit` a length
    (in path order), as the operator's definition has it."""
    level = starts.select(F.col("s").alias("start"), F.array("s").alias("path"))
    out = None
    w = Window.partitionBy("start").orderBy("path")
    for n in range(1, hops + 1):
        grown = level.withColumn("s", F.element_at("path", -1)).join(edges.select("s", "o").distinct(), "s").where(~F.array_contains("path", F.col("o")))
        level = grown.select("start", F.concat("path", F.array("o")).alias("path")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")
        found = level.withColumn("hops", F.lit(n))
        out = found if out is None else out.unionByName(found)
    return out


def latest_edges(facts: DataFrame, subject: str, relation: str, obj: str, serial: str) -> DataFrame:
    """The newest object of each (subject, relation)."""
    return facts.groupBy(subject, relation).agg(F.max_by(obj, F.struct(serial, obj)).alias(obj), F.max(serial).alias(serial))


def fold_edges(edges: DataFrame, folds: int) -> DataFrame:
    """Adds fold: a hash of the pair, so that both directions are held out together."""
    pair: Column = F.concat_ws("|", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    return edges.withColumn("fold", F.pmod(F.conv(F.substring(F.sha2(pair, 256), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int"))


def left_out_recall(edges: DataFrame, folds: int, k: int) -> DataFrame:
    """fold, held, hits and recall: for each fold of pairs, how many of its edges stand among the k best guesses of their first end when the fold is taken
    away. A guess for a is a node two hops away that a is not linked to otherwise; its score is the sum over paths of the products of supports.

    All folds come from one pass over the two-hop paths: a path counts for every fold but those of its two edges, so a pair's score without a fold
    is its whole score less what the fold's edges gave, and the folds are columns of one aggregation.
    """
    marked = fold_edges(edges, folds)
    way = marked.select("a", "b", "support", "fold").unionByName(marked.select(F.col("b").alias("a"), F.col("a").alias("b"), "support", "fold"))
    first, second = way.select(F.col("a").alias("x"), F.col("b").alias("c"), F.col("support").alias("s"), F.col("fold").alias("f")), way.select(F.col("a").alias("c"), F.col("b").alias("y"), F.col("support").alias("t"), F.col("fold").alias("g"))
    product = F.col("s") * F.col("t")
    scores = first.join(second, "c").where("x <> y").groupBy("x", "y").agg(F.sum(product).alias("whole"), *[F.sum(F.when((F.col("f") == i) | (F.col("g") == i), product).otherwise(0)).alias(f"less{i}") for i in range(folds)])
    own = way.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("fold").alias("own"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), (F.col("whole") - F.col(f"less{i}")).alias("score")) for i in range(folds)])).alias("z")
    guesses = scores.join(own, ["x", "y"], "left").select("x", "y", "own", each).select("x", "y", "own", "z.*").where("score > 0 and (own is null or own = fold)")
    ranked = guesses.withColumn("rank", F.row_number().over(Window.partitionBy("x", "fold").orderBy(F.col("score").desc(), "y")))
    hits = ranked.where((F.col("own") == F.col("fold")) & (F.col("rank") <= k)).groupBy("fold").agg(F.count("*").alias("hits"))
    held = way.groupBy("fold").agg(F.count("*").alias("held"))
    return held.join(hits, "fold", "left").select("fold", "held", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("hits", F.lit(0)) / F.col("held"), 6).alias("recall"))
