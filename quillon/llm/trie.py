"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and its smallest member owns it.
What a conversation owns is a suffix of its path, as the members of a deeper node are fewer and the smallest can only grow. Each node of
a subtree is owned by exactly one conversation, which is a member of the subtree's top too. So a sum over the nodes of a subtree
is a sum over the top's members alone: (members - 1) * tokens, summed, is the tokens of all occurrences less those of owned ones, and
the leaves and children are counted where they are owned. One group-by over occurrences gives all of it.

An occurrence names its node by a chain of hashes (SHA-256, of which 128 bits are kept): of the parent's and the turn's. The smallest
member of each node is a partial aggregation, so that a hot first turn costs a row a task; a window along each conversation, not
over a node, marks the owned suffix from the first node it owns. Parents are looked up by the node that each conversation
owns first; parents of more than one node in 256 (at most 255 of them) are broadcast. The ids that end at a node are
hashed in order, in chunks of at most 4,096 ids, from a stream: no list of all is made.

Defined results: turns sort by turn (nulls first), then role, then the hex SHA-256 of the text; rows that agree in all are as many turns;
null roles and texts count as empty; rows without conv_id belong to no conversation; an empty table gives an empty result; very
long texts and conversations are handled whole; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import persist

#: A parent is hot if more than one node in so many is its child.
HOT = 256
#: Conversation ids are hashed in chunks of at most 2 ** CHUNK.
CHUNK = 12

ROOT = hashlib.sha256(b"").digest()[:16]
OCCURRENCES = "conv_id bigint, depth bigint, node binary, parent binary, tokens bigint, ends boolean"


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn (a digest of role and text) and tokens (code points of the text)."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("at"), role.alias("role"), F.sha2(text, 256).alias("digest"), F.length(text).cast("bigint").alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy(F.col("at").asc_nulls_first(), "role", "digest")
    name = F.unhex(F.sha2(F.concat("digest", "role"), 256))  # the digest has 64 characters, so nothing else has the same pair
    return rows.select("conv_id", F.row_number().over(order).cast("bigint").alias("pos"), name.alias("turn"), "tokens")


def graft(turns: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """conv_id, part, pos, turn and tokens of rebuilt conversations: the first `taken` (0 to most) turns of the conversation `base`,
    as they are in turns, then the conversation's own turns after its first `taken`. Part -1 is a row for each conversation."""
    every = turns.where("pos = 1").select("conv_id", base.alias("base"), taken.alias("taken"))
    heads = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "turn", "tokens")
    lent = every.where("taken > 0").join(heads, "base").where("pos <= taken").select("conv_id", F.lit(0).alias("part"), "pos", "turn", "tokens")
    own = turns.where(F.col("pos") > taken).select("conv_id", F.lit(1).alias("part"), "pos", "turn", "tokens")
    root = every.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("tokens"))
    return root.unionByName(lent).unionByName(own)


def whole(turns: DataFrame) -> DataFrame:
    """The rows of graft() with every conversation as it is."""
    return graft(turns, F.col("conv_id"), F.lit(0), 0)


def _chained(batches):
    """Occurrences of sorted rows; the row in hand waits for the next to tell whether it ends its conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("tokens", pa.int64()), ("ends", pa.bool_())])
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    held = None
    for batch in batches:
        out = []
        for conv, part, turn, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "tokens"))):
            if held is not None:
                out.append((*held, part < 0))
            held = (conv, 0, ROOT, None, 0) if part < 0 else (conv, held[1] + 1, hashlib.sha256(held[2] + turn).digest()[:16], held[2], tokens)
        if out:
            yield table(out)
    if held is not None:
        yield table([(*held, True)])


def occurrences(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, tokens and ends for every node on every conversation's path."""
    return rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(_chained, OCCURRENCES)


def _digested(batches):
    """node, ends_sha256 of chunks sorted by node and place."""
    node, sha = None, None
    for batch in batches:
        names, digests = [], []
        for here, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if here != node:
                if node is not None:
                    names.append(node)
                    digests.append(sha.hexdigest())
                node, sha = here, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """node and ends_sha256: of the ids of the conversations that end there, ascending, comma-joined."""
    chunk = F.shiftright("conv_id", CHUNK).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    chunks = paths.where("ends").groupBy("node", chunk).agg(ids)
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_digested, "node binary, ends_sha256 string")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    rebuilt: rows of graft() or whole().
    """
    paths = persist(occurrences(rebuilt), "paths")
    owners = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), (F.count("*") == F.count(F.when(F.col("ends"), 1))).alias("leaf"))
    owned = owners.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max("leaf").cast("int").alias("leaf"))  # one row a conversation
    along = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = paths.join(owned, "conv_id", "left").withColumn("mine", F.coalesce(F.col("depth") >= F.col("first"), F.lit(False)))
    marked = known.select(
        "conv_id", "depth", "node", "parent", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.sum(F.when(F.col("mine"), 0).otherwise(F.col("tokens"))).over(along).alias("saved"),
        F.coalesce(~F.col("ends") & (F.col("depth") + 1 >= F.col("first")), F.lit(False)).cast("int").alias("child"),
    )
    grouped = marked.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    nodes = persist(grouped, "nodes")
    total = nodes.count()
    name = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") * HOT > total
    busy = F.broadcast(name.where(hot).select("parent", F.col("parent_conv_id").alias("busy_id")))  # fewer than HOT rows: each has more than a HOT-th of the nodes as children
    looked = nodes.join(busy, "parent", "left")
    rest = name.where(~hot).drop("n_children")
    some = looked.where("busy_id is null and parent is not null").join(rest, "parent", "left")
    found = some.unionByName(looked.where("busy_id is not null or parent is null").withColumn("parent_conv_id", F.col("busy_id")))
    empty = hashlib.sha256(b"").hexdigest()
    out = found.join(end_digests(paths), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def grafted_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations that share their beginnings: each is given the first h turns of the conversation that opens its
    hundred, h from 0 to 5 by its id."""
    at = persist(placed(turns), "turns")
    taken = F.crc32(F.col("conv_id").cast("string")) % 6
    return prefix_trie(graft(at, F.col("conv_id") - F.col("conv_id") % 100, taken, 5))
