"""Readers and writers of append-only logs, text trees and ledgers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: Extensions and the greatest size of files that a text tree holds.
TEXT_EXTENSIONS = ("md", "txt", "rst", "py", "json", "jsonl", "toml", "csv", "yaml")
MOST_BYTES = 5 << 20

_NAMES = "schema_version id operation kind title summary body tags source_refs confidence status created_at valid_from claim_class supersedes supersession_kind supersession_reason related_ids"
_KINDS = {"schema_version": T.IntegerType(), "tags": T.ArrayType(T.StringType()), "source_refs": T.ArrayType(T.StringType()), "related_ids": T.ArrayType(T.StringType())}
EVENT = T.StructType([T.StructField(name, _KINDS.get(name, T.StringType())) for name in _NAMES.split()])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): one JSON object a line; blank lines go; lines that are none are rows of malformed with their text. A byte
    order mark is skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("line", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    return parsed.where(~bad).select("row.*").drop("_corrupt"), parsed.where(bad).select("line")


def last_line(path: str) -> str:
    """What stands after a file's last line feed, read from its end: nothing in a file that ends in one."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with store.open_input_file(name) as file:
        size, most = file.size(), 1 << 16
        while True:
            file.seek(max(0, size - most))
            data = file.read()
            if b"\n" in data or most >= size:
                return data.rsplit(b"\n", 1)[-1].decode("utf-8", "replace")
            most *= 4


def read_torn(spark: SparkSession, path: str, schema: T.StructType, position: str = "seq") -> DataFrame:
    """read_jsonl() of one file's rows that carry their position: a malformed line is forgiven only as the end of the file without a line
    feed (a torn append). Malformed lines are counted by Spark; the driver reads the file's end alone."""
    rows, malformed = read_jsonl(spark, path, schema)
    bad = malformed.agg(F.count("*").alias("n"), F.max("line").alias("line")).first()
    if bad["n"] > 1 or bad["n"] == 1 and last_line(path).strip() != bad["line"].strip():
        raise ValueError("a malformed line before the end of the log")
    return rows.orderBy(position) if position in rows.columns else rows


def broken_links(log: DataFrame, order: str, stream: str | None = None) -> DataFrame:
    """Rows (previous, sha256, event) of a hash-chained log whose digest or link is wrong. Chains are verified per stream."""
    w = Window.partitionBy(stream if stream else F.lit(0)).orderBy(order)
    digest = F.sha2(F.concat(F.coalesce("previous", F.lit("")), F.col("event")), 256)
    marked = log.withColumn("__before", F.lag("sha256").over(w))
    return marked.where((F.col("sha256") != digest) | ~F.col("previous").eqNullSafe(F.col("__before"))).drop("__before")


def chain(events: list[str]) -> list[dict]:
    """Rows of a hash-chained log (a writer appends one at a time)."""
    out, previous = [], None
    for i, event in enumerate(events):
        digest = hashlib.sha256(((previous or "") + event).encode()).hexdigest()
        out.append({"seq": i, "previous": previous, "sha256": digest, "event": event})
        previous = digest
    return out


def read_text_tree(spark: SparkSession, path: str, excluded: tuple[str, ...] = (".git", "__pycache__")) -> DataFrame:
    """path, title (the first heading, else the path's last part) and text of the text files of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kept = files.where((F.col("length") <= MOST_BYTES) & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*TEXT_EXTENSIONS))
    for part in excluded:
        kept = kept.where(~F.col("path").contains(f"/{part}/"))
    text = F.decode("content", "UTF-8")
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return kept.select("path", F.when(heading != "", heading).otherwise(F.regexp_extract("path", r"([^/]+)$", 1)).alias("title"), text.alias("text"))


def read_units(spark: SparkSession, path: str, keys: str = "cycle string, unit string, arm string, seed int") -> DataFrame:
    """A CSV of per-unit results: typed keys, the other columns as numbers where they are. Raises on repeated keys."""
    rows = spark.read.option("header", True).csv(path)
    typed = T.StructType.fromDDL(keys)
    names = [f.name for f in typed if f.name in rows.columns]
    out = rows.select(*[F.col(c).cast(typed[c].dataType).alias(c) for c in names], *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in rows.columns if c not in names])
    if not out.groupBy(*names).count().where("count > 1").isEmpty():
        raise ValueError("repeated keys")
    return out


def inverted_text(index: DataFrame, key: str, positions: str) -> DataFrame:
    """key and text of a map word -> places."""
    each = index.select(key, F.explode(positions).alias("w", "ps")).select(key, "w", F.explode("ps").alias("p"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "w"))), lambda x: x["w"]), " ").alias("text"))


def write_canonical(df: DataFrame, path: str) -> None:
    """JSON lines with sorted names."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def digest_of(df: DataFrame) -> DataFrame:
    """One row: rows and digest, an order-free sum of the rows' SHA-256 (first 15 hex digits)."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def append_event(log: DataFrame, event: dict) -> dict:
    """Validates an event against the log (known enums, provenance of evidence, ids) and returns the full row; the caller writes it."""
    row = {f.name: event.get(f.name) for f in EVENT} | {"schema_version": 2}
    if not row["id"] or row["operation"] not in ("create", "supersede"):
        raise ValueError("an event needs an id and an operation")
    if row["kind"] == "evidence" and not row["source_refs"]:
        raise ValueError("evidence needs its sources")
    if not log.where(F.col("id") == row["id"]).isEmpty():
        raise ValueError("the id is taken")
    if row["operation"] == "supersede":
        if log.where(F.col("id") == row["supersedes"]).isEmpty() or not log.where(F.col("supersedes") == row["supersedes"]).isEmpty():
            raise ValueError("only an active event can be superseded")
    row["tags"] = list(dict.fromkeys(t.strip() for t in row["tags"] or [] if t.strip()))
    return row


def upcast(log: DataFrame) -> DataFrame:
    """Version 1 rows to version 2: valid_from from created_at, classes unclassified; nothing is lost."""
    have = set(log.columns)
    fill = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    superseding = F.col("operation") == "supersede"
    added = {
        "valid_from": fill("valid_from", F.col("created_at")), "claim_class": fill("claim_class", F.lit("unclassified")),
        "supersession_kind": fill("supersession_kind", F.when(superseding, F.lit("unclassified"))), "schema_version": F.lit(2),
    }
    return log.withColumns(added)


def ledger_balance(ledger: DataFrame, scope: list[str]) -> DataFrame:
    """scope, settled and open: v1 charges and v2 reserve / settle / charge rows; a settlement closes its reservation. Unknown events raise."""
    event = F.when(F.col("v") == 1, "charge").otherwise(F.col("event"))
    rows = ledger.withColumn("__e", event).withColumn("__ok", F.when(F.col("__e").isin("charge", "reserve", "settle"), True).otherwise(F.raise_error(F.lit("unknown ledger event")).cast("boolean")))
    closed = rows.where("__ok and __e = 'settle'").select(F.col("id").alias("__id")).distinct()
    open_ = rows.where("__ok and __e = 'reserve'").join(closed, F.col("id") == F.col("__id"), "left_anti").groupBy(*scope).agg(F.sum("usd").alias("open"))
    settled = rows.where("__ok and __e <> 'reserve'").groupBy(*scope).agg(F.sum("usd").alias("settled"))
    return settled.join(open_, scope, "full_outer").select(*scope, F.round(F.coalesce("settled", F.lit(0.0)), 6).alias("settled"), F.round(F.coalesce("open", F.lit(0.0)), 6).alias("open"))


def config(text: str) -> dict:
    """A TOML document as nested dicts."""
    import tomllib

    return tomllib.loads(text)


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path and value of every leaf of a JSON column."""
    schema = T.StructType.fromDDL("path string, value string")

    def leaves(x, path):
        if isinstance(x, dict):
            for k, v in sorted(x.items()):
                yield from leaves(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from leaves(v, f"{path}[{i}]")
        else:
            yield path, x if isinstance(x, str) or x is None else json.dumps(x)

    def run(frames):
        for pdf in frames:
            out = [(k, p, v) for k, raw in zip(pdf[key], pdf[column]) if raw for p, v in leaves(json.loads(raw), "")]
            yield pdf.__class__(out, columns=[key, "path", "value"])

    return df.select(key, column).mapInPandas(run, T.StructType([df.schema[key], *schema.fields]))
