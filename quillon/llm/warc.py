"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames of whole WARC records, followed by a seek table in a skippable frame
(the layout of the Zstandard seekable format, so that any zstd tool reads the bundle). A Parquet index beside the bundles
maps each record's id to its bundle, its frame, the frame's place in the file and the record's offset within the frame.
A reader goes from an id to one frame without touching the rest.

Records with equal payloads: the one with the largest key is a response, the others are revisits that refer to it and
carry no payload. Null payloads count as empty; rows that share the largest key of their payload are all responses; null
keys rank below all others. Empty tables give archives without bundles. Columns other
than key, url and payload are not written, so clashing names cannot occur.

Bundles are written by the tasks of one Spark job through pyarrow's file systems (local, HDFS, S3, ...), under a name made
of the partition's number: first to a name of the attempt, then moved to the final name. Rows are sorted in each partition,
so a task that runs again after a lost executor writes the same bytes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import new_path, persist

# Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table's footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Packed bytes of frames that one task reads (several times as much when unpacked, but one frame at a time).
TASK_BYTES = 4 << 20

INDEX = "record_id string, page_id bigint, bundle string, frame int, frame_at bigint, frame_bytes bigint, record_at bigint, record_bytes bigint"
RECORD = "record_id string, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base 32: each five hex digits are four digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classify(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload (binary), payload_digest, payload_bytes, record_type and refers_to of every row.

    Keys are compared per digest by a partially aggregated maximum; only digests of two rows or more are joined back, and
    Spark splits a hot digest's partition.
    """
    rows = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string").cast("binary"), F.lit(b"")).alias("payload")
    )
    rows = rows.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("bigint")})
    digests = pages.select(F.col(f"`{key}`").cast("bigint").alias("page_id"), base32_sha1(F.coalesce(F.col(f"`{payload}`").cast("string").cast("binary"), F.lit(b""))).alias("payload_digest"))
    shared = digests.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = rows.join(shared, "payload_digest", "left")
    revisit = F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
    )


def record_urn(page_id: int | None, digest: str) -> str:
    """A name-based UUID of the key and the payload's digest: the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> tuple[str, bytes]:
    """(record id, bytes) of one WARC/1.1 record; the block is an HTTP head and, in a response, the payload."""
    name = record_urn(page_id, digest)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "response":
        block += payload
    target = "".join(c for c in (url or "about:blank") if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a decompressed frame."""
    at = 0
    while at < len(data):
        gap = data.index(b"\r\n\r\n", at)
        lines = data[at:gap].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = gap + 4
        end = start + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record of wrong length at {at}")
        yield at, end + 4 - at, headers, data[start:end]
        at = end + 4


@dataclass
class Frame:
    at: int
    size: int
    plain: int


def seek_table(frames: list[Frame]) -> bytes:
    """The footer: a skippable frame with both sizes of every frame, its count, a descriptor and the magic number."""
    body = b"".join(struct.pack("<II", f.size, f.plain) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file, size: int) -> list[Frame]:
    """The frames of an open bundle, read from its last bytes."""
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        out.append(Frame(at, packed, plain))
        at += packed
    return out


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, path: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, **names: str) -> DataFrame:
    """Writes the bundles under path/bundles and the index under path/index in one Spark job; returns the index.

    frame_bytes: records are added to a frame until it holds so many plain bytes; a longer record has a frame of its own.
    bundle_bytes: a partition goes on in a further bundle after so many plain bytes.
    """
    spark = pages.sparkSession
    classified = classify(pages, **names)
    rows = classified.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload").sortWithinPartitions("page_id", "payload_digest", "url")
    target = f"{path}/bundles"

    def run(batches):
        import zstandard

        store, root = _store(target)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store.create_dir(root, recursive=True)
        press = zstandard.ZstdCompressor(level=level)
        out, names_, frames, pending, rows_, number, taken = None, None, [], [], [], 0, 0
        entries: list[tuple] = []

        def close_frame():
            nonlocal pending, rows_
            if pending:
                plain = b"".join(pending)
                packed = press.compress(plain)
                at = frames[-1].at + frames[-1].size if frames else 0
                out.write(packed)
                for name, page, offset, length in rows_:
                    entries.append((name, page, names_[1], len(frames), at, len(packed), offset, length))
                frames.append(Frame(at, len(packed), len(plain)))
                pending, rows_ = [], []

        def close_bundle():
            nonlocal out, frames, number, taken
            if out is not None:
                close_frame()
                out.write(seek_table(frames))
                out.close()
                store.move(f"{root}/{names_[0]}", f"{root}/{names_[1]}")
                out, frames, number, taken = None, [], number + 1, 0

        def index():
            nonlocal entries
            cols = list(zip(*entries))
            entries = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, KINDS)], names=FIELDS)

        plain_in_frame = 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, kind, refers, digest, size, payload = (batch.column(i)[k].as_py() for i in range(7))
                if out is None:
                    final = f"part-{part:06d}-{number:04d}.warc.zst"
                    names_ = (f".{final}.{attempt}", final)
                    out = store.open_output_stream(f"{root}/{names_[0]}")
                name, raw = warc_record(page_id, url, kind, refers, digest, size, payload)
                if pending and plain_in_frame + len(raw) > frame_bytes:
                    close_frame()
                    plain_in_frame = 0
                rows_.append((name, page_id, plain_in_frame, len(raw)))
                pending.append(raw)
                plain_in_frame += len(raw)
                taken += len(raw)
                if taken >= bundle_bytes:
                    close_bundle()
                    plain_in_frame = 0
            if entries:
                yield index()
        close_bundle()
        if entries:
            yield index()

    schema = T.StructType.fromDDL(INDEX)
    from pyspark.sql.pandas.types import to_arrow_type

    KINDS, FIELDS = [to_arrow_type(f.dataType) for f in schema], schema.names
    rows.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.schema(schema).parquet(f"{path}/index")


def _rows(data: bytes, wanted: set[int] | None, check: bool) -> Iterator[tuple]:
    for at, _, headers, block in parse_records(data):
        if wanted is not None and at not in wanted:
            continue
        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        if check and payload is not None:
            import base64

            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != int(headers["X-Payload-Length"]):
                raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not what its digest says")
        page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
        yield (headers["WARC-Record-ID"], int(page) if page else None, headers["WARC-Target-URI"], kind, int(refers) if refers else None, digest, int(headers["X-Payload-Length"]), payload)


def _read(spots: DataFrame, path: str, selective: bool, check: bool) -> DataFrame:
    """spots: bundle, frame_at, frame_bytes and, if selective, record_at; sorted so that a bundle is opened once a task."""
    target, schema = f"{path}/bundles", T.StructType.fromDDL(RECORD)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches):
        import zstandard

        store, root = _store(target)
        plain = zstandard.ZstdDecompressor()
        name, file = None, None
        for batch in batches:
            spots_ = batch.to_pylist()
            k = 0
            while k < len(spots_):
                spot = spots_[k]
                wanted = None
                if selective:
                    wanted = set()
                    while k < len(spots_) and (spots_[k]["bundle"], spots_[k]["frame_at"]) == (spot["bundle"], spot["frame_at"]):
                        wanted.add(spots_[k]["record_at"])
                        k += 1
                else:
                    k += 1
                if spot["bundle"] != name:
                    name, file = spot["bundle"], store.open_input_file(f"{root}/{spot['bundle']}")
                file.seek(spot["frame_at"])
                rows = list(_rows(plain.decompress(file.read(spot["frame_bytes"])), wanted, check))
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 500]), kinds)], names=schema.names)

    return spots.mapInArrow(run, schema)


def scan_archives(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Every record of every bundle, frame by frame as the bundles' own seek tables list them; check: verify payload digests."""
    target = f"{path}/bundles"
    bundles = spark.read.schema(T.StructType.fromDDL(INDEX)).parquet(f"{path}/index").select("bundle").distinct()

    def frames(batches):
        store, root = _store(target)
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    out += [(name, f.at, f.size) for f in read_seek_table(file, file.size())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["bundle", "frame_at", "frame_bytes"])

    listed = persist(bundles.mapInArrow(frames, "bundle string, frame_at bigint, frame_bytes bigint"), "frames")
    return _read(_spread(listed, TASK_BYTES).sortWithinPartitions("bundle", "frame_at"), path, False, check)


def _spread(spots: DataFrame, task_bytes: int) -> DataFrame:
    """The spots dealt by frame over as many tasks as their frames' packed bytes ask for. The number is given, so that Spark does not
    coalesce what is a short list of much work."""
    total = spots.select("bundle", "frame_at", "frame_bytes").distinct().agg(F.sum("frame_bytes")).first()[0] or 0
    return spots.repartition(max(1, -(-total // task_bytes)), "bundle", "frame_at")


def lookup(spark: SparkSession, path: str, record_ids: DataFrame, check: bool = True) -> DataFrame:
    """The records with the given ids (column record_id), each by its frame alone."""
    index = spark.read.schema(T.StructType.fromDDL(INDEX)).parquet(f"{path}/index")
    spots = persist(index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame_at", "frame_bytes", "record_at"), "spots")
    return _read(_spread(spots, TASK_BYTES).sortWithinPartitions("bundle", "frame_at", "record_at"), path, True, check)


def archive_path(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return new_path(spark, "warc")
