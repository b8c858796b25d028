"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target (words) by water-filling: the whole is shared by weight, a source stops at `most` times its
size, and the excess is shared again by weight among the others. A document of a source with target r times its size is
copied floor(r) times for sure and once more with probability r - floor(r). These fractional copies are rounded
dependently: two sides exchange mass, measured in words, until one of them is whole (the pivotal step), so the source's
words stay what they were and every copy keeps its probability. Documents are dealt in chunks of bounded size. In a chunk, where all
start with one probability, each document, largest first, is paired with the pool of all smaller ones (which keep one common
probability, so that a pair's step is one for the pool); a chunk leaves at most one fractional document, a small one. Those residuals
are paired one with the next, chunk by chunk, in a tree of bounded fan-in until each source has one, which a coin rounds. A source's
words miss its target by less than that document's size.

Defined results: null and empty texts have size 0 and are never copied; a null source is a source of its own, last in
order; repeated rows are documents of their own; a table without words has targets 0; an empty table gives an empty one;
columns other than the id, the source and those to carry are dropped, so clashing names do no harm. Documents are dealt and ordered by
hashes of their id and text, and all draws are hashes of the seed, the source, the chunk and the step: reruns agree whatever the
partitioning or the order of the rows. Rows equal in id and text are told apart by an ordinal only, so which of them is copied more often is open.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import WORD, persist

# The weights, repeated over the sources in code-point order.
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (the number of words of the whole text), key (a hash of id and text) and the carried columns."""
    body = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(f"`{doc_id}`", body).alias("key"), *[F.col(f"`{c}`") for c in carry],
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size and target: one row a source.

    The level of the water is the one at which the sources whose limit lies below it give way: sources are ordered by
    limit / weight, and the level after the first k are full is (total - their limits) / (weight of the rest).
    Windows run over the sources alone, which partial aggregation has brought down to one row each.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = each.withColumn("weight", F.element_at(weight, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    level = ranked.withColumns({
        "full": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": F.sum(F.col("source_size").cast("double")).over(whole), "all_weight": F.sum("weight").over(whole),
    })
    level = level.withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_weight") - F.col("gone")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    level = level.withColumn("water", F.max(fits).over(whole))  # from the first source that fits on, the level falls
    return level.select("source", "source_size", F.coalesce(F.least("limit", F.col("water") * F.col("weight")), F.col("limit")).alias("target"))


def _draw(*parts) -> float:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest()) / (1 << 56)


def pivot(p: list[float], size: list[int], seed: tuple) -> tuple[list[float], int]:
    """Rounds probabilities so that sum(p * size) is kept; returns them and the index of the one left fractional, or -1.

    In each step the held document and the next exchange words until one of the two is 0 or 1.
    """
    out, held, tiny = list(p), -1, 1e-9
    for i, q in enumerate(p):
        if q <= tiny or q >= 1 - tiny:
            out[i] = float(round(q))
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min(size[a] * (1 - out[a]), size[b] * out[b])  # words that a can take from b
        down = min(size[a] * out[a], size[b] * (1 - out[b]))
        words = up if _draw(*seed, i) * (up + down) < down else -down
        out[a] += words / size[a]
        out[b] -= words / size[b]
        for k in (a, b):
            if out[k] <= tiny or out[k] >= 1 - tiny:
                out[k] = float(round(out[k]))
        held = next((k for k in (a, b) if 0.0 < out[k] < 1.0), -1)
    return out, held


def pivot_even(p: float, size: list[int], seed: tuple) -> tuple[list[float], int]:
    """pivot() where all start with the same p: each document, largest first, exchanges words with all smaller ones together.

    The smaller ones keep one common probability, so expectations stay right, and what is left fractional at the end is a
    small document. `size` descends.
    """
    n = len(size)
    out, rest = [0.0] * n, sum(size)
    for i, words in enumerate(size):
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i:] = [float(round(p))] * (n - i)
            return out, -1
        rest -= words
        if rest <= 0:
            out[i] = p
            return out, i
        up, down = min(words * (1 - p), rest * p), min(words * p, rest * (1 - p))
        moved = up if _draw(*seed, i) * (up + down) < down else -down
        out[i], p = p + moved / words, p - moved / rest
        if 1e-9 < out[i] < 1 - 1e-9:  # the rest is whole now
            out[i + 1 :] = [float(round(p))] * (n - i - 1)
            return out, i
        out[i] = float(round(out[i]))
    return out, -1


def round_copies(fractional: DataFrame, seed: int, chunk: int) -> DataFrame:
    """fractional: source, size > 0, key, ordinal (unique with the key in a source), p and other columns; returns the rows with p
    rounded to 0 or 1.

    Level 0 deals documents by their hash into chunks of about `chunk`; level n deals the residuals of level n - 1. The number
    of levels is the logarithm of the largest source's count, read as one number.
    """
    schema = T.StructType([*fractional.schema.fields, T.StructField("done", T.BooleanType())])

    def settle(level: int, final: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "key", "ordinal"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            key = (seed, level, str(pdf["source"].iloc[0]), int(pdf["part"].iloc[0]))
            p, held = pivot_even(float(pdf["p"].iloc[0]), pdf["size"].tolist(), key) if level == 0 else pivot(pdf["p"].tolist(), pdf["size"].tolist(), key)
            done = np.ones(len(pdf), bool)
            if held >= 0:
                if final:
                    p[held] = float(_draw(*key, "last") < p[held])
                else:
                    done[held] = False
            return pdf.assign(p=p, done=done)[schema.names]

        return run

    largest = fractional.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    settled, rest, level = None, fractional, 0
    while True:
        final = largest <= chunk
        parts = 1 if final else -(-largest // chunk)
        # A small source has one chunk as well as a large one: parts follow the source's own count.
        counts = rest.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(chunk))).cast("bigint").alias("parts"))
        dealt = rest.join(counts, rest["source"].eqNullSafe(counts["source"])).select(rest["*"], "parts")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key", "ordinal", F.lit(seed), F.lit(level)), "parts"))
        done = persist(dealt.groupBy("source", "part").applyInPandas(settle(level, final), schema), f"pivot-{level}")
        finished = done.where("done").drop("done")
        settled = finished if settled is None else settled.unionByName(finished)
        if final:
            return settled
        rest, largest, level = done.where("not done").drop("done"), parts, level + 1


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 17, chunk: int = 4096, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size) and the carried columns of every document.

    chunk: most documents, and most residuals, that one task rounds together (its memory bound).
    """
    rows = persist(sizes(docs, doc_id, source, text, carry), "sizes")
    shares = targets(rows, weights, most)
    joined = rows.join(shares, rows["source"].eqNullSafe(shares["source"])).select(rows["*"], "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("ratio", F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio)).withColumn("sure", F.floor("ratio"))
    joined = joined.withColumn("p", F.when(F.col("size") > 0, F.col("ratio") - F.col("sure")).otherwise(0.0)).drop("ratio")
    ordinal = F.row_number().over(Window.partitionBy("source", "key").orderBy("doc_id", *carry))
    fractional = persist(joined.where("p > 0").withColumn("ordinal", ordinal).withColumn("doc_id", F.col("doc_id").cast("string")), "fractional")  # ids with nulls would be floats in pandas
    rounded = round_copies(fractional, seed, chunk).drop("ordinal").withColumn("doc_id", F.col("doc_id").cast(joined.schema["doc_id"].dataType))
    settled = rounded.unionByName(joined.where("p = 0"))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.col("p").cast("bigint")).otherwise(0).cast("bigint")
    return settled.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"`{c}`") for c in carry])
