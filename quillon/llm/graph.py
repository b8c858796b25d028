"""Connected components of links that stay in Spark tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import persist


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of a list of edges: each node's root is the least node that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    for i in range(len(up)):  # parents come first: they are less
        up[i] = up[up[i]]
    return nodes, nodes[up] if len(nodes) else nodes


def _one_task(batches):
    tables = [pa.Table.from_batches([b]) for b in batches]
    if tables:
        whole = pa.concat_tables(tables)
        nodes, roots = forest(np.array(whole.column(0)), np.array(whole.column(1)))
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(roots[k : k + 100_000])], names=["node", "root"])


def components(links: DataFrame, name: str = "components", bound: int = 1 << 20) -> DataFrame:
    """node and root (the least node reachable) of every node of the links (a, b: bigint); one row a node.

    Large-star and small-star steps alternate (Kiveris et al. 2014): each hangs a node's neighbours below its least one, by
    a partially aggregated minimum and a join that Spark can split at hubs; rounds grow as the logarithm of the nodes. At most `bound`
    edges (a proven size, counted first) are finished by one executor task. Loops and null ends are ignored; an empty table
    gives an empty one.
    """
    edges = persist(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= bound:
            return edges.coalesce(1).mapInArrow(_one_task, "node bigint, root bigint")
        if state == before:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = persist(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
