"""A logistic probe trained by sums, searches in rounds, and queries with a deadline."""

from __future__ import annotations

import itertools
import threading
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from quillon.functions.text import ascii_tokens
from quillon.sources.index import cut


def logistic_fit(rows: DataFrame, features: list[Column], label: Column, ridge: float = 1.0, steps: int = 25, tolerance: float = 1e-9) -> np.ndarray:
    """The weights (bias first) of a ridge-regularised logistic regression, by Newton steps. A step is one aggregation: its gradient and
    curvature are sums over the rows, so the driver sees k + k * k numbers a step for k weights (the bias is not regularised)."""
    x = [F.lit(1.0), *[F.coalesce(f.cast("double"), F.lit(0.0)) for f in features]]
    known = rows.where(label.isNotNull()).select(*[c.alias(f"x{i}") for i, c in enumerate(x)], label.cast("double").alias("y"))
    k, w = len(x), np.zeros(len(x))
    penalty = ridge * np.diag([0.0] + [1.0] * (k - 1))
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((F.col(f"x{i}") * float(w[i]) for i in range(k)), F.lit(0.0))))
        sums = [F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k)] + [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(k)]
        row = known.withColumn("p", p).agg(*sums).first()
        if row[0] is None:
            return w
        gradient, curvature = np.array(row[:k]) - penalty @ w, np.array(row[k:]).reshape(k, k) + penalty
        move = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        w = w + move
        if np.abs(move).max() < tolerance:
            break
    return w


def leak_probe(rows: DataFrame, features: list[Column], label: Column, fold: Column, ridge: float = 1.0) -> DataFrame:
    """fold, n and auroc: how well a probe fitted on the other folds tells the label in each; near 0.5 nothing leaks."""
    from .measures import auroc

    marked = rows.withColumn("__fold", fold)
    out = None
    for r in sorted(x[0] for x in marked.select("__fold").distinct().collect()):  # a handful of folds
        w = logistic_fit(marked.where(F.col("__fold") != r), features, label, ridge)
        score = sum((f.cast("double") * float(v) for f, v in zip(features, w[1:])), F.lit(float(w[0])))
        held = marked.where(F.col("__fold") == r).select(score.alias("s"), label.alias("y"))
        part = auroc(held, "s", "y").select(F.lit(r).alias("fold"), F.lit(held.count()).alias("n"), "auroc")
        out = part if out is None else out.unionByName(part)
    return out


def iterative_search(first: DataFrame, search: Callable[[DataFrame], DataFrame], texts: DataFrame, query: str, doc: str, rounds: int | None = None, most: int = 1) -> DataFrame:
    """query, doc and round: the first hits (round 0), then in each round at most `most` unseen hits of a search with the text of the best hit
    of the round before; a query whose round brings nothing stops. Without a number of rounds it ends when all queries have stopped. A text that
    several queries come to is searched once. search: (query, term) -> (query, doc, rank), by the terms alone."""
    seen = first.select(query, doc, F.lit(0).alias("round"))
    last, hits = first.where("rank = 1").select(query, doc), None
    for n in itertools.count(1) if rounds is None else range(1, rounds + 1):
        asks = last.groupBy(doc).agg(F.min(query).alias(query))
        asks = cut(asks if hits is None else asks.join(hits.select(F.col("__from").alias(doc)).distinct(), doc, "left_anti"), f"asks-{n}")
        if hits is None or not asks.isEmpty():
            terms = asks.join(texts, doc).select(query, F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("term"))
            found = cut(search(terms).join(asks.withColumnRenamed(doc, "__from"), query).select("__from", doc, "rank"), f"hits-{n}")
            hits = found if hits is None else hits.unionByName(found)
        unseen = last.withColumnRenamed(doc, "__from").join(hits, "__from").join(seen.select(query, doc), [query, doc], "left_anti")
        new = cut(unseen.withColumn("__i", F.row_number().over(Window.partitionBy(query).orderBy("rank", doc))).where(F.col("__i") <= most).select(query, doc, "__i"), f"round-{n}")
        if new.isEmpty():
            break
        last = new.where("__i = 1").select(query, doc)
        seen = seen.unionByName(new.select(query, doc, F.lit(n).alias("round")))
    return seen


def within_time(df: DataFrame, seconds: float) -> tuple[str, list[Row]]:
    """("ok", rows), or ("timeout", []) where the rows are not there after so many seconds: the query's jobs are cancelled then."""
    context, group, late = df.sparkSession.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a query with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        rows = df.collect()
        return ("timeout", []) if late.is_set() else ("ok", rows)
    except Exception:
        if late.is_set():
            return "timeout", []
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
