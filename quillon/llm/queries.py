"""The operators' queries over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, html, jaccard, langid, middle, mixing, oracle, prefixhash, quality, secrets, toxicity, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's wrapper."""
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, rank_file(), decode_back=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder and read back from them."""
    path = warc.archive_path(spark)
    warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.scan_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.render(_table(spark, sf_dir, "conversations"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every whole text: base counts and the digest of their spans, and all spans."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are alike to 0.85 or more."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op7_prefix_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how alike they and the next document's are."""
    return prefixhash.neighbour_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labelled rows that are not held out."""
    return toxicity.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every whole text and whether the document is kept."""
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the documents that are not held out."""
    return langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix by its seed, and put together again."""
    cut = middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = middle.restored(F.col("form"), F.col("output"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of conversations that begin with turns of the one that opens their hundred."""
    return trie.grafted_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_warc": op3_warc,
    "op4_chat_format": op4_chat_format,
    "op5_secret_scan": op5_secret_scan,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_prefix_fingerprint": op7_prefix_fingerprint,
    "op8_source_mix": op8_source_mix,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_language_id": op11_language_id,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": oracle.WARC,
    "op4_chat_format": oracle.CHAT,
    "op6_jaccard_join": oracle.JACCARD,
    "op10_quality_rules": oracle.quality_sql(),
    "op12_fill_in_middle": oracle.MIDDLE,
    "op13_prefix_trie": oracle.TRIE,
}
