"""Dense retrieval by an inverted file of residual codes: an approximate way beside the exact ranking.dense_top()."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillon.sources.index import cut

from .ranking import top


@dataclass
class InvertedFile:
    """centers (lists x dimensions, unit length); probes: how many lists a query needs for the recall that was asked; rows: k, list, part (a long
    list is dealt into parts), code (a byte a dimension), scale, v."""

    centers: np.ndarray
    probes: int
    rows: DataFrame


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[pdf["v"].map(lambda v: v is not None and len(v) > 0 and bool(np.linalg.norm(v) > 0))]


def fit_centers(points: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit vectors, the same in every run."""
    centers = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)].copy()
    for _ in range(rounds):
        nearest = (points @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(lengths > 0, sums / np.maximum(lengths, 1e-12), centers)
    return centers


def probes_for(points: np.ndarray, centers: np.ndarray, k: int, goal: float, asked: int = 256) -> int:
    """The fewest lists in which `asked` of the points find a share `goal` of their k nearest others."""
    if len(points) < 2:
        return 1
    some = points[np.linspace(0, len(points) - 1, min(asked, len(points))).astype(int)]
    scores = some @ points.T
    scores[scores > 1 - 1e-9] = -np.inf  # itself, and copies, which lie in its own list
    near = np.argsort(-scores, axis=1)[:, : min(k, len(points) - 1)]
    order = np.argsort(np.argsort(-(some @ centers.T), axis=1), axis=1)  # each list's place for each query
    lists = (points @ centers.T).argmax(1)
    needed = np.sort(np.take_along_axis(order, lists[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(goal * len(needed))) - 1)])


def inverted_file(vectors: DataFrame, key: str, vector: str, lists: int, k: int = 5, goal: float = 0.96, most: int = 20_000, part: int = 4096) -> InvertedFile:
    """Every vector in the list of its nearest center, as its residual's code. Null and zero vectors are in no list.

    Centers, and the lists that a query needs to find a share `goal` of its k nearest, come from the `most` vectors of least key hash, which are what
    reaches the driver.
    """
    sample = _usable(vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.xxhash64("k"), "k").limit(most).toPandas())
    points = _unit(sample["v"]) if len(sample) else np.zeros((0, 0))
    centers = fit_centers(points, lists) if len(points) else points
    probes = probes_for(points, centers, k, goal) if len(points) else 1

    def coded(frames):
        for pdf in frames:
            pdf = _usable(pdf)
            if not len(pdf):
                continue
            unit = _unit(pdf["v"])
            nearest = (unit @ centers.T).argmax(1)
            rest = unit - centers[nearest]
            scale = np.abs(rest).max(1) / 127 + 1e-12
            codes = np.round(rest / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"k": pdf["k"].to_numpy(), "list": nearest.astype(np.int32), "code": [c.tobytes() for c in codes], "scale": scale, "v": pdf["v"].to_numpy()})

    rows = vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null")
    placed = cut(rows.mapInPandas(coded, "k bigint, list int, code binary, scale double, v array<double>"), "lists")
    sizes = placed.groupBy("list").agg(F.count("*").alias("n"))
    parts = placed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / part)).cast("int")).drop("n")  # a row a list
    return InvertedFile(centers, probes, parts)


def inverted_top(queries: DataFrame, found: InvertedFile, key: str, vector: str, k: int, probes: int | None = None, wider: int = 8) -> DataFrame:
    """query, doc, score and rank: the k vectors of greatest cosine, other than itself, among the `probes` lists (found.probes) nearest to each query.

    A part of a list meets the queries that probe it, once: codes give the `wider` * k best of each pair, of which the wider * k best of a query are scored
    again by their vectors.
    """
    centers, probes = found.centers, probes or found.probes
    if not len(centers):
        return queries.sparkSession.createDataFrame([], "query bigint, doc bigint, score double, rank int")

    def probed(frames):
        for pdf in frames:
            pdf = _usable(pdf)
            if not len(pdf):
                continue
            near = np.argsort(-(_unit(pdf["v"]) @ centers.T), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"q": np.repeat(pdf["k"].to_numpy(), near.shape[1]), "qv": np.repeat(pdf["v"].to_numpy(), near.shape[1]), "list": near.ravel().astype(np.int32)})

    asked = queries.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(probed, "q bigint, qv array<double>, list int")
    places = found.rows.select("list", "part").distinct()
    left = asked.join(places, "list").select(F.col("list").alias("at_list"), F.col("part").alias("at_part"), "q", "qv")
    right = found.rows.select("list", "part", "k", "code", "scale")

    def rough(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "doc": [], "rough": []}).astype({"query": "int64", "doc": "int64", "rough": "float64"})
        q = _unit(a["qv"])
        codes = np.stack([np.frombuffer(c, np.int8) for c in b["code"]]).astype(np.float64) * b["scale"].to_numpy()[:, None]
        scores = q @ (codes + centers[int(b["list"].iloc[0])]).T
        ids = b["k"].to_numpy()
        scores[a["q"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, : wider * k]
        best = np.take_along_axis(scores, order, axis=1)
        r, c = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"query": a["q"].to_numpy()[r], "doc": ids[order[r, c]], "rough": best[r, c]})

    met = left.groupBy("at_list", "at_part").cogroup(right.groupBy("list", "part")).applyInPandas(rough, "query bigint, doc bigint, rough double")
    near = top(met.withColumnRenamed("rough", "score"), wider * k, "query", "doc", positive=False).select("query", "doc")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, w: u * w), F.lit(0.0), lambda acc, z: acc + z)
    full = near.join(found.rows.select(F.col("k").alias("doc"), F.col("v").alias("dv")), "doc").join(queries.select(F.col(key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("qv")), "query")
    exact = full.select("query", "doc", F.round(dot("qv", "dv") / F.sqrt(dot("qv", "qv") * dot("dv", "dv")), 6).alias("score"))
    return top(exact, k, "query", "doc", positive=False)
