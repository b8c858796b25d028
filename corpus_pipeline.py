"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents. A row is a document, whatever its id: null and repeated ids are decided row by row, by the rows' numbers in the table that
the stage reads. Null and empty texts and texts without words fail the base rules; an empty table gives an empty one; other columns
of documents are kept as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import bpe, jaccard, mixing, quality, secrets
from quillon.llm.common import bounded_batches, persist
from quillon.llm.queries import rank_file

#: Near duplicates: shingles of five words, likeness of 0.8 or more.
SHINGLE_WORDS, LIKE_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; cutoffs come from the labelled documents among docs."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with `__row`, a number of each row that is the same in every scan, whatever the partitions: the row's place in its file, after
    the file's place among all files. Rows that come from no file are written first. The driver holds the names of the files,
    which it lists for any scan, and the numbers of files are broadcast: 16 bytes a file."""
    spark = docs.sparkSession
    try:
        place = docs.metadataColumn("_metadata")
        placed = docs.select("*", F.xxhash64(place["file_path"]).alias("__file"), place["row_index"].alias("__at"))
    except AnalysisException:
        return _numbered(persist(docs, "rows"))
    files = sorted((r["p"], r["f"]) for r in docs.select(place["file_path"].alias("p")).distinct().select("p", F.xxhash64("p").alias("f")).collect())
    if len({f for _, f in files}) < len(files):
        raise ValueError("two files have the same hash of their names")
    numbers = spark.createDataFrame([(f, k << 40) for k, (_, f) in enumerate(files)], "__file bigint, __base bigint")
    return placed.join(F.broadcast(numbers), "__file").withColumn("__row", F.col("__base") + F.col("__at")).drop("__file", "__at", "__base")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, the first in the table."""
    bounded_batches(spark)
    rows = _numbered(docs)
    groups = jaccard.jaccard_components(rows.select("__row", "text"), words=SHINGLE_WORDS, percent=LIKE_PERCENT, doc_id="__row")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a marker; n_chars follows."""
    bounded_batches(spark)
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none to three times."""
    bounded_batches(spark)
    rows = _numbered(docs)
    copies = mixing.mix_sources(rows.select("doc_id", "source", "text", "__row"), carry=("__row",)).where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    taken = rows.join(copies, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
    return taken.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text (packed unsigned 32-bit integers), with where tokens end in its bytes, and whether they decode to it."""
    bounded_batches(spark)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text"), rank_file(), decode_back=True)
    return encoded.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "token_ends",
        (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", tokens),
]

#: Thresholds, rounding and merges have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
