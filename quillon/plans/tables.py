"""The driver tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of the chain (user_id, event_type): id, valid_from, recorded (up to three hours later), value, k."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").cast("timestamp").alias("valid_from"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=(F.col("event_id") % 180).cast("int"))).alias("recorded"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


FACTS_SQL = "SELECT event_id AS id, user_id, event_type, ts AS valid_from, ts + to_minutes(CAST(event_id % 180 AS INTEGER)) AS recorded, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"
CHAIN, ORDER = ["user_id", "event_type"], ["valid_from", "id"]

TOKENS_SQL = """dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
posts AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)),
dl AS (SELECT doc_id, sum(tf) AS dl FROM posts GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1)"""
GOLD_SQL = "gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def lexical(spark: SparkSession, sf_dir: str):
    """(query terms, index): benchmark items ask, documents answer. The index is written once and read by every lexical query."""
    from quillon.functions.text import ascii_tokens
    from quillon.sources.index import open_index

    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(ascii_tokens(F.col("text"))).alias("term")).distinct()
    return asked, open_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, doc_id: documents that hold a benchmark passage as it stands.

    Pairs meet on the passage's second to sixth tokens as a gram (passages of three to six tokens: on their second), then the text is searched, so no
    document is compared with all items. A passage may begin or end inside a document's token; those of one or two tokens, of which none need be whole, meet
    every document.
    """
    from quillon.functions.text import ascii_tokens
    from quillon.sources.index import HELD, cut, token_grams

    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    size = F.size(ascii_tokens(F.col("text")))
    # A passage may begin or end inside a document's token: its second to sixth tokens are whole ones there too.
    pairs = token_grams(docs, "doc_id", 5).join(token_grams(items.where(size > 6), "item_id", 5, at=1), "gram").select("item_id", "doc_id").distinct()
    short = items.where(size.between(3, 6)).select("item_id", ascii_tokens(F.col("text"))[1].alias("term"))
    if not short.isEmpty():
        terms = docs.select("doc_id", F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("term"))
        pairs = pairs.unionByName(terms.join(short, "term").select("item_id", "doc_id"))
    tiny = items.where(size < 3).select("item_id")
    if not tiny.isEmpty():
        pairs = pairs.unionByName(tiny.crossJoin(docs.select("doc_id")))
    pairs = cut(pairs, "gold")
    held = F.broadcast(pairs) if pairs.count() <= HELD else pairs  # texts are not exchanged to meet few pairs
    full = docs.select("doc_id", "text").join(held, "doc_id").join(items.withColumnRenamed("text", "passage"), "item_id")
    return full.where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id")
