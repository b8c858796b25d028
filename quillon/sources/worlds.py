"""Directories of tables with a digest, JSON arrays, web sources, generated streams, pointers into JSON."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.operators.audit import digest_of_rows
from quillon.operators.inference import splitmix


def write_world(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines below path, and a manifest of their counts and digests, written last."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        r = digest_of_rows(spark.read.schema(df.schema).json(f"{path}/{name}")).first()
        rows.append((name, int(r["n"]), r["digest"], df.schema.json()))
    spark.createDataFrame(rows, "name string, n bigint, digest string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_world(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of write_world(); a table whose rows are not those of the manifest is an error."""
    from pyspark.sql.types import StructType

    out = {}
    for row in spark.read.schema("name string, n bigint, digest string, schema string").json(f"{path}/manifest").collect():
        df = spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).json(f"{path}/{row['name']}")
        found = digest_of_rows(df).first()
        if (found["n"], found["digest"]) != (row["n"], row["digest"]):
            raise ValueError(f"table {row['name']} is not what the manifest says")
        out[row["name"]] = df
    return out


#: Rows of a key that write_json_arrays() puts into one array.
ARRAY_ROWS = 10_000


def write_json_arrays(df: DataFrame, path: str, by: str, field: str, most: int = ARRAY_ROWS) -> None:
    """The rows without their key, as lines of JSON: an object with one array for each key, with several of about `most` rows for a key of more. The
    files are those of the tasks, however many keys there are."""
    large = df.groupBy(F.col(by).alias("__by")).agg(F.ceil(F.count("*") / most).alias("__parts")).where("__parts > 1")  # one row for `most` rows of the table at most
    placed = df.withColumn("__at", F.monotonically_increasing_id()).join(F.broadcast(large), F.col(by).eqNullSafe(F.col("__by")), "left")
    rows = placed.select(by, F.pmod("__at", F.coalesce("__parts", F.lit(1))).alias("__part"), F.struct(*[c for c in df.columns if c != by]).alias("__x"))
    rows.groupBy(by, "__part").agg(F.to_json(F.struct(F.collect_list("__x").alias(field))).alias("value")).select("value").write.mode("overwrite").text(path)


def read_json_array(spark: SparkSession, path: str, schema=None, field: str | None = None, lines: bool = False) -> DataFrame:
    """The elements of a JSON array (of an object's field, if named) as rows. lines: each line is one, so that tasks share files."""
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return df.select(F.explode(field).alias("__x")).select("__x.*") if field else df


def fetch(url: str, get: Callable[[str], tuple[int, dict, bytes]], attempts: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a page, tried again after 429 and 5xx answers: after Retry-After seconds if the answer says so, else after a pause
    that doubles. get: url -> (status, headers, body)."""
    for attempt in range(attempts):
        status, headers, body = get(url)
        if status < 400:
            return body
        if status != 429 and status < 500:
            raise ValueError(f"{url}: status {status}")
        if attempt + 1 < attempts:
            after = {k.lower(): v for k, v in headers.items()}.get("retry-after", "")
            sleep(float(after) if str(after).strip().isdigit() else base * 2**attempt)
    raise TimeoutError(f"{url}: no answer after {attempts} attempts")


def read_pages(spark: SparkSession, urls: list[str], get: Callable[[str], tuple[int, dict, bytes]], partitions: int = 4, **retry) -> DataFrame:
    """url and body of every address, fetched by tasks; polite limits are partitions times one request."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(body=[fetch(u, get, **retry).decode("utf-8", "replace") for u in pdf["url"]])

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, min(partitions, len(urls)))).mapInPandas(run, "url string, body string")


def lcg(seed: int, label: str, n: int) -> list[int]:
    """n numbers of a 64-bit linear congruential stream, keyed by seed and label (upper 32 bits)."""
    import hashlib

    x = int.from_bytes(hashlib.sha256(f"{seed}|{label}".encode()).digest()[:8], "big")
    out = []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)  # fixed values: the multiplier and increment of a common generator
        out.append(x >> 32)
    return out


def synthetic_streams(spark: SparkSession, seeds: list[int], rows: int, kinds: tuple[str, ...] = ("note", "reading", "visit")) -> DataFrame:
    """seed, seq, ts, kind and value: one deterministic stream a seed; a seed is one task's work and streams are many."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for seed in pdf["seed"].tolist():
                draws = splitmix(seed, 3 * rows).reshape(rows, 3)
                gaps = (draws[:, 0] % 120 + 1).astype("int64")
                yield pd.DataFrame({"seed": seed, "seq": range(rows), "ts": gaps.cumsum(), "kind": [kinds[int(k)] for k in draws[:, 1] % len(kinds)], "value": (draws[:, 2] >> 11).astype("float64") / (1 << 53)})

    return spark.createDataFrame([(s,) for s in seeds], "seed bigint").repartition(max(1, min(len(seeds), 64)), "seed").mapInPandas(run, "seed bigint, seq bigint, ts bigint, kind string, value double")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _steps(pointer: str) -> list[str]:
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer begins with /")
    return [x.replace("~1", "/").replace("~0", "~") for x in pointer.split("/")[1:]]


def get_pointer(value: Any, pointer: str) -> Any:
    """What a JSON pointer names; KeyError or IndexError where there is none."""
    for step in _steps(pointer):
        value = value[int(step)] if isinstance(value, list) else value[step]
    return value


def set_pointer(value: Any, pointer: str, replacement: Any) -> Any:
    """A copy of the value with what a pointer names replaced; '-' adds to a list."""
    steps = _steps(pointer)
    if not steps:
        return replacement
    out = json.loads(json.dumps(value))
    here = get_pointer(out, "/" + "/".join(s.replace("~", "~0").replace("/", "~1") for s in steps[:-1])) if len(steps) > 1 else out
    if isinstance(here, list):
        if steps[-1] == "-":
            here.append(replacement)
        else:
            here[int(steps[-1])] = replacement
    else:
        here[steps[-1]] = replacement
    return out


def normalised_struct(json_text: Column, schema: str) -> Column:
    """A JSON object as a struct of a schema, and from there canonical JSON: missing fields are null, others go, types are the schema's."""
    return F.to_json(F.from_json(json_text, schema), {"ignoreNullFields": "false"})


def records(observed: DataFrame, specs: DataFrame, key: str, channel: DataFrame | None = None, provenance: bool = True) -> DataFrame:
    """id, text, at, channel, source and heartbeat: what a memory may see of a world's observations (key, text, at, channel). Of its specification only the
    source is shown, and that only with provenance (else it is empty); heartbeat is the channel's value of the observation, null without one. Rows
    are as they were observed; specifications without an observation, and the reverse, are what spec_audit() tells.
    """
    out = observed.join(specs.select(key, F.col("source").alias("__source")), key, "left")
    out = out.join(channel.select(key, F.col("value").alias("heartbeat")), key, "left") if channel is not None else out.withColumn("heartbeat", F.lit(None).cast("double"))
    source = F.coalesce("__source", F.lit("")) if provenance else F.lit("")
    return out.select(F.col(key).alias("id"), "text", "at", "channel", source.alias("source"), "heartbeat")


def spec_audit(observed: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """One row: unspecified (observations without a specification), unobserved (the reverse) and repeated keys of either."""
    seen, told = observed.groupBy(key).agg(F.count("*").alias("a")), specs.groupBy(key).agg(F.count("*").alias("b"))
    both = seen.join(told, key, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return both.agg(count(F.col("b").isNull()).alias("unspecified"), count(F.col("a").isNull()).alias("unobserved"), count((F.coalesce("a", F.lit(0)) > 1) | (F.coalesce("b", F.lit(0)) > 1)).alias("repeated"))
