"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs often hold the same conversation several times, each snapshot longer than the one before. The rolling hash of a
conversation's turns after turn k identifies its prefix of k turns. A conversation whose whole hash is the hash of a
longer conversation's prefix is dropped by an anti-join; of equal conversations the one with the least id stays. What
is left, the maximal conversations, is rendered.

The rolling hash of k turns is k and two running sums, over the turns, of 64-bit hashes of a turn and its place (under two
seeds): a window adds them up in one pass over a conversation, however long it is.

Defined results: null roles and texts count as empty; null conversation ids form one conversation; turns sort by turn (nulls
last), then role and text, so ties have one order; rows that agree in conversation, turn, role and text are one turn; empty
tables give empty results; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Fixed values of the default template.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the different turns, nulls of the last two as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text")).distinct()


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, k, n and prefix_hash: the rolling hash after the k-th of n turns."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _turns(turns).select("conv_id", F.row_number().over(order).alias("k"), F.count("*").over(Window.partitionBy("conv_id")).cast("int").alias("n"), *[F.xxhash64(F.lit(seed), "role", "text").alias(f"h{seed}") for seed in (1, 2)], "turn", "role", "text")
    wide = lambda seed: F.sum(F.xxhash64("k", f"h{seed}").cast("decimal(20,0)")).over(so_far).cast("string")
    return placed.select("conv_id", "k", "n", F.concat_ws("|", F.col("k").cast("string"), wide(1), wide(2)).alias("prefix_hash"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n and chain_hash of the conversations that no longer conversation begins with, and that are the first of their equals."""
    prefixes = turn_prefixes(turns)
    whole = prefixes.where("k = n").groupBy("prefix_hash").agg(F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNull()).alias("unnamed"), F.count("*").alias("copies"), F.first("n").alias("n"))
    whole = whole.withColumn("conv_id", F.when(~(F.col("unnamed") & (F.col("copies") == 1)), F.col("conv_id")))
    inner = prefixes.where("k < n").select("prefix_hash").distinct()  # partial distinct: a hot first turn is one row a task
    return whole.join(inner, "prefix_hash", "left_anti").select("conv_id", "n", "copies", F.col("prefix_hash").alias("chain_hash"))


def render(turns: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """conv_id, n_turns, copies and rendered: the maximal conversations in the chat template."""
    kept = maximal(turns) if kept is None else kept
    chosen = _turns(turns).alias("r").join(kept.alias("k"), F.col("r.conv_id").eqNullSafe(F.col("k.conv_id"))).select("r.*", "k.copies")
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text")
    line = lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(BETWEEN), x["text"], F.lit("\n" + CLOSE))
    grouped = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("lines"), F.first("copies").alias("copies"))
    return grouped.select("conv_id", F.size("lines").cast("bigint").alias("n_turns"), F.col("copies").cast("bigint").alias("copies"), F.array_join(F.transform("lines", line), "").alias("rendered"))
