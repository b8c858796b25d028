"""Search over windows of texts whose hits are shown only while their source still says the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quillon.sources.index import Index, build_index, cut, read_index, shared_folder

from .controls import text_windows
from .ranking import bm25_top

#: Windows of a source at most; a window's key is its source's key times this, plus its number.
MOST = 1 << 20


@dataclass
class WindowIndex:
    """ix: the index over windows (key window_id); windows: window_id, the source's key, window, char_start, char_end, source_sha and part_sha."""

    ix: Index
    windows: DataFrame
    key: str


def window_index(docs: DataFrame, key: str, text: str = "text", size: int = 1600, overlap: int = 160) -> WindowIndex:
    """Cuts each text into byte-exact windows, keeps where they are and the digests of source and part, and indexes them.

    Null and empty texts have no windows; null keys are left out. The texts themselves are kept in the index's blocks as terms alone.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(text).cast("string").alias("__t"))
    sources = rows.select(key, F.sha2("__t", 256).alias("source_sha"))
    parts = text_windows(rows, key, "__t", size, overlap).withColumn("window_id", F.col(key) * MOST + F.col("window"))
    placed = cut(parts.join(sources, key).select("window_id", key, "window", "char_start", "char_end", "source_sha", F.sha2("text", 256).alias("part_sha"), "text"), "windows")
    folder = build_index(placed.select("window_id", "text"), "window_id", f"{shared_folder(spark)}/quillon-windows")
    return WindowIndex(read_index(spark, folder, "window_id"), placed.drop("text"), key)


def search_windows(query_terms: DataFrame, found: WindowIndex, docs: DataFrame, query: str, k: int, text: str = "text") -> DataFrame:
    """query, rank, score, the source's key, window, char_start, char_end and shown (the window's text) of the k best windows of each query.

    docs are the sources as they are now. A hit is shown if the source's digest, and the span's, are still those of the index; a source that changed
    makes exactly its own windows go (shown is null), others keep their ranks. Only the sources of hits are read again.
    """
    hits = bm25_top(query_terms, found.ix, query, "window_id", k).join(found.windows, "window_id")
    now = docs.select(F.col(found.key).cast("bigint").alias(found.key), F.col(text).cast("string").alias("__t")).join(hits.select(found.key).distinct(), found.key, "left_semi")
    span = F.expr("substring(__t, char_start + 1, char_end - char_start)")
    whole = (F.sha2("__t", 256) == F.col("source_sha")) & (F.sha2(span, 256) == F.col("part_sha"))
    return hits.join(now, found.key, "left").select(query, "rank", "score", found.key, "window", "char_start", "char_end", F.when(F.coalesce(whole, F.lit(False)), span).alias("shown"))
