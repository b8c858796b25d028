"""Samples, shuffles, ablations, percentiles of pairs, concepts and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.sources.index import Index


def seeded(seed: int, key: str) -> Column:
    """The order of a seeded shuffle: SHA-256 of seed and key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


def per_label(rows: DataFrame, excluded: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """n rows of each label in a seeded order, without the excluded keys."""
    left = rows.join(excluded.select(key).distinct(), key, "left_anti")
    return left.withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy(seeded(seed, key)))).where(F.col("__k") <= n).drop("__k")


def capped(rows: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """The rows that stay when no key may hold more than floor(share * rows), the first in order staying, repeated until nothing changes.

    Each turn keeps a prefix of every key's rows, so a turn needs the keys' counts alone: the fixed point is found on them, and the rows
    are ranked once.
    """
    counts = {r["k"]: r["n"] for r in rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).collect()}  # one number a key: a sample's families
    while True:
        most = int(share * sum(counts.values()) + 1e-9)
        new = {k: min(n, most) for k, n in counts.items()}
        if new == counts:
            break
        counts = new
    most = max(counts.values(), default=0)
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__k") <= most).drop("__k")


def ablated(rows: DataFrame, gone: DataFrame, group: str, key: str, link: str) -> DataFrame:
    """The rows without the groups that go; links to rows that went are null."""
    left = rows.join(gone.select(group).distinct(), group, "left_anti")
    there = left.select(F.col(key).alias("__k"))
    return left.join(there, left[link] == there["__k"], "left").withColumn(link, F.col("__k")).drop("__k")


def permuted(rows: DataFrame, group: str, key: str, value: str, seed: int) -> DataFrame:
    """The rows with the values of each group dealt anew, by a seeded order: places meet places in a join on group and number."""
    a = rows.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy(key)).alias("__k"))
    b = rows.select(group, value, F.row_number().over(Window.partitionBy(group).orderBy(seeded(seed, key))).alias("__k"))
    return a.join(b, [group, "__k"]).select(group, key, value)


def shifted(rows: DataFrame, group: str, order: str, value: str, by: int) -> DataFrame:
    """The rows with each value that of the row `by` places earlier in its group; null before."""
    return rows.withColumn(value, F.lag(value, by).over(Window.partitionBy(group).orderBy(order)))


def pair_percentiles(queries: DataFrame, vectors: DataFrame, pairs: DataFrame, key: str, vector: str, block: int = 1024) -> DataFrame:
    """x, y, sim and below: the cosine of each given pair, and the share of the likenesses of a stated query set to all other vectors that are
    less.

    Blocks of queries and vectors are matrix products; each sends on how many of its likenesses have each value (six digits), so what is
    shuffled are at most 2e6 counts a block pair, not its pairs.
    """
    from .measures import running

    size = lambda df: max(1, -(-df.count() // block))
    nq, nv = size(queries), size(vectors)
    narrow = lambda df, name, n: df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.lit(name == "q").alias("asks"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"))
    q = narrow(queries, "q", nq).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))).withColumnRenamed("b", "i")
    d = narrow(vectors, "d", nv).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumnRenamed("b", "j")

    def unit(s) -> np.ndarray:
        m = np.stack(s.to_numpy()).astype(np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def counts(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"sim": [], "n": []}).astype({"sim": "float64", "n": "int64"})
        sims = np.round(unit(a["v"]) @ unit(b["v"]).T, 6)
        values, n_ = np.unique(sims[a["k"].to_numpy()[:, None] != b["k"].to_numpy()[None]] + 0.0, return_counts=True)
        return pd.DataFrame({"sim": values, "n": n_.astype("int64")})

    every = q.unionByName(d).groupBy("i", "j").applyInPandas(counts, "sim double, n bigint").groupBy("sim").agg(F.sum("n").alias("n"))
    total = every.agg(F.sum("n").alias("t"))
    x, y = (vectors.select(F.col(key).alias(name), F.transform(vector, lambda e: e.cast("double")).alias(f"v{name}")) for name in ("x", "y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, e: acc + e)
    given = pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", (F.round(dot("vx", "vy") / F.sqrt(dot("vx", "vx") * dot("vy", "vy")), 6) + 0.0).alias("sim"))
    # Likenesses and given pairs are one order; equal values stand before what is counted of them.
    marks = every.select("sim", "n").unionByName(given.groupBy("sim").agg(F.lit(0).cast("bigint").alias("n"))).groupBy("sim").agg(F.sum("n").alias("n"))
    below = running(marks, "sim", {"upto": F.col("n")}).select("sim", (F.col("upto") - F.col("n")).alias("less"))
    return given.join(below, "sim").crossJoin(F.broadcast(total)).select("x", "y", "sim", F.round(F.col("less") / F.col("t"), 6).alias("below"))  # one row


def expanding_median(rows: DataFrame, channel: list[str], order: list[str], value: str) -> DataFrame:
    """Adds median: that of the channel's earlier readings; null for the first. Rows come sorted by channel; a task holds two heaps of the
    channel that it reads, and a batch."""
    import heapq

    fields = rows.schema.fields
    dealt = rows.repartition(*channel).sortWithinPartitions(*channel, *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, low, high = None, [], []
        for pdf in frames:
            out = []
            for name, x in zip(pdf[channel].itertuples(index=False, name=None), pdf[value].tolist()):
                if name != last:
                    last, low, high = name, [], []
                out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
                if x is None or x != x:
                    continue
                heapq.heappush(high, -heapq.heappushpop(low, -x))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
            yield pdf.assign(median=np.round(np.array(out, float), 6))

    return dealt.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", median double")


def concepts(index: Index, doc: str, k: int, least: int, most_share: float) -> DataFrame:
    """doc, term and weight: the k terms of greatest tf * ln(n / df) of each document, of those that stand in at least `least` documents and
    at most a share of them."""
    rows = index.posts.crossJoin(F.broadcast(index.stats)).where((F.col("df") >= least) & (F.col("df") <= most_share * F.col("n")))  # one row
    weighed = rows.select(doc, "term", F.round(F.col("tf") * F.log(F.col("n") / F.col("df")), 6).alias("weight"))
    return weighed.withColumn("__k", F.row_number().over(Window.partitionBy(doc).orderBy(F.col("weight").desc(), "term"))).where(F.col("__k") <= k).drop("__k")


def pools(observed: DataFrame, target: str, line: str) -> DataFrame:
    """target and lines: every target that some line observes, with all of them in order."""
    return observed.groupBy(target).agg(F.array_sort(F.collect_set(line)).alias("lines"))


def leaders(rows: DataFrame, group: str, order: str, key: str, terms: str, least: float) -> DataFrame:
    """group, key and leader: rows in order join the leader of the greatest cosine of their term sets if it is at least `least` (the earliest of
    equals), or become leaders. A fold over each group's short list: what a row joins depends on all before it."""
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).cast("string").alias("k"), F.array_distinct(F.col(terms)).alias("t")))).alias("l"))
    kind = "array<struct<k:string,t:array<string>,leader:string>>"
    cosine = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt((F.size(a) * F.size(b)).cast("double"))).otherwise(0.0)

    def step(acc, x):
        heads = F.filter(acc, lambda h: h["k"] == h["leader"])
        best = F.array_max(F.transform(heads, lambda h, i: F.struct(cosine(h["t"], x["t"]).alias("c"), (-i).alias("i"), h["k"].alias("k"))))
        leader = F.when(best["c"] >= least, best["k"]).otherwise(x["k"])
        return F.concat(acc, F.array(F.struct(x["k"].alias("k"), x["t"].alias("t"), leader.alias("leader"))))

    folded = listed.select(group, F.explode(F.aggregate("l", F.array().cast(kind), step)).alias("m"))
    return folded.select(group, F.col("m.k").alias(key), F.col("m.leader").alias("leader"))
