"""A written full-text index: blocks of postings by term bucket, terms, documents, corpus statistics.

The index of a table is built once and read by every lexical query; its manifest holds a mark of the source (names, sizes and times
of its files), and an index whose mark differs from the source's is stale and built anew. A built index is never changed: each mark
has a folder of its own, and the manifest is written last, so a half-written folder is no index.

Postings lie in blocks: a term and a range of documents (by hash, about RANGE documents to a range) are a row, with the postings as two arrays side
by side (places of documents in their range, and occurrences) and what bounds their impacts: the most occurrences, the shortest document. What
belongs to a document (key, lengths, norm) is written once, in the row of its range, where postings read it by place. Blocks are partitioned by a hash
bucket of the term, so a query reads the partitions of its terms and no other, and can tell from the bounds, without the
arrays, which ranges may hold one of its best documents.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillon.functions.text import ascii_tokens


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one on the driver's machine,
    which only a local session can use."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder: what several branches of a plan read is computed once, and a lost executor costs a
    reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-cuts/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_cuts(spark: SparkSession) -> None:
    """Deletes the tables that cut() wrote for this application; results that read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quillon-cuts/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The layout of the folders: an index of another one is not read.
LAYOUT = "places"
#: Documents to a range, postings to a bucket, and the least and most buckets. At most MOST_BUCKETS numbers reach the driver for a query.
RANGE, POSTINGS, LEAST_BUCKETS, MOST_BUCKETS = 1024, 1 << 16, 16, 4096

#: Rows of terms that every task of the build may hold, so that postings are not exchanged to meet them.
HELD = 2_000_000
#: Documents whose lengths every task of a query may hold (about 8 bytes each a field), so that blocks are not exchanged to meet them.
HELD_DOCS = 8_000_000

#: What a posting has beside its key, term and df.
FIELDS = ("tf", "dl", "dn", "unit")


@dataclass
class Index:
    """posts: key, term, tf, dl, df, dn (different terms of the document) and unit (the posting's share of its document's tf-idf
    vector of length 1); docs: key, dl, dn; terms: term and df; stats: one row, n and avgdl (documents that have a term).

    blocks, of written indexes: bucket, term, df, range, the arrays at (places in the range) and tf in one order, most_tf, least_dl and least_dn.
    rows: a row for each range of documents, with its documents' keys, dl, dn and norm as arrays, by place. ranges: how many there are. n: documents in all.

    gone and norms, of removed(): for each range, whether a document is out, by place, and the norms of those left; blocks and rows are those written, and asked() and told() leave out what is gone."""

    key: str
    posts: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None
    buckets: int = 1
    ranges: int = 1
    rows: DataFrame | None = None
    n: int = 0
    gone: DataFrame | None = None
    norms: DataFrame | None = None

    def bucket(self, term: Column | str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def asked(self, terms: DataFrame) -> DataFrame:
        """The blocks of some terms: the partitions of their buckets alone are read. terms: a column term, among others."""
        numbers = [r[0] for r in terms.select(self.bucket("term").alias("b")).distinct().collect()]  # at most MOST_BUCKETS
        blocks = self.blocks.where(F.col("bucket").isin(numbers)) if len(numbers) < self.buckets else self.blocks
        return blocks if self.gone is None else _left(blocks, self, self.terms.join(terms.select("term").distinct(), "term", "left_semi"))

    def told(self, columns: Iterable[str]) -> DataFrame:
        """rows, where `columns` of them will be read."""
        return self.rows if self.norms is None or "norm" not in columns else self.rows.drop("norm").join(self.norms, "range")

    def of(self, terms: DataFrame) -> DataFrame:
        """The postings (as in posts) of some terms."""
        wanted = terms.select("term").distinct()
        if self.blocks is None:
            return self.posts.join(wanted, "term", "left_semi")
        return flat(self.asked(wanted).join(wanted, "term", "left_semi"), self)


def scale(n: int) -> Column:
    """The idf of tf-idf weights: ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1


def flat(blocks: DataFrame, ix: Index, *more: str, fields: tuple[str, ...] = FIELDS, on: tuple[str, ...] = ("range",)) -> DataFrame:
    """The postings of blocks, with further columns of theirs: key, term, df, fields and more. The documents' row of a range is read by place, so postings are not exchanged to meet their documents; of its arrays, those of `fields` are read."""
    told = {"dl": "dl", "dn": "dn", "unit": "norm"}
    own = [told[f] for f in fields if f in told]
    rows = ix.told(own).select(*on, "keys", *own)
    met = blocks.join(F.broadcast(rows) if ix.n <= HELD_DOCS else rows.repartition(ix.ranges, "range").hint("shuffle_hash"), list(on))
    each = met.select("*", F.posexplode("at").alias("__i", "__at"))
    at, tf = F.col("__at"), F.get("tf", F.col("__i"))
    values = {"tf": lambda: tf, "dl": lambda: F.get("dl", at), "dn": lambda: F.get("dn", at), "unit": lambda: (1 + F.log(tf)) * scale(ix.n) / F.get("norm", at)}
    return each.select(F.get("keys", at).alias(ix.key), "term", "df", *[values[f]().alias(f) for f in fields], *more)


def postings(docs: DataFrame, key: str, text: str = "text", tokens=ascii_tokens) -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _weighed(posts: DataFrame, key: str, terms: DataFrame, n: Column) -> DataFrame:
    """posts with df and the unscaled tf-idf weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)."""
    return posts.join(terms, "term").withColumn("weight", (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1))


def index_of(posts: "DataFrame | Index", key: str) -> Index:
    """The index of postings at hand, not written; an index as it is."""
    if isinstance(posts, Index):
        return posts
    terms, stats = posts.groupBy("term").agg(F.count("*").alias("df")), posts.groupBy(key).agg(F.sum("tf").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    weighed = _weighed(posts.crossJoin(F.broadcast(stats.select("n"))), key, terms, F.col("n"))  # one row
    docs = weighed.groupBy(key).agg(F.sum("tf").alias("dl"), F.count("*").alias("dn"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    rows = weighed.join(docs, key).select(key, "term", "tf", "dl", "df", "dn", (F.col("weight") / F.col("norm")).alias("unit"))
    return Index(key, rows, docs.drop("norm"), terms, stats)


def _status(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)


def source_mark(docs: DataFrame) -> str:
    """A digest of the names, lengths and times of the files that a table reads; of its rows where it reads no files."""
    spark = docs.sparkSession
    files = sorted(docs.inputFiles())
    if files:
        parts = [f"{name}|{(s := _status(spark, name)).getLen()}|{s.getModificationTime()}" for name in files]
    else:
        row = docs.agg(F.count("*"), F.sum(F.xxhash64(*docs.columns).cast("decimal(38,0)"))).first()
        parts = [str(row[0]), str(row[1])]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


#: The bytes of ascii_tokens() in a lower-case text.
TOKEN_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _tokens(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of every token of a batch: of lists of tokens, or the ascii_tokens() of texts in lower case."""
    if not pa.types.is_string(column.type):
        return np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy()), column.flatten()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    texts, inside = offsets[:-1] - offsets[0], TOKEN_BYTES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = texts[texts < len(data)]
    begins[at] = inside[at]  # a token ends where its text does
    starts = np.flatnonzero(begins)
    places = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    return np.searchsorted(texts, starts, side="right") - 1, words


def token_grams(docs: DataFrame, key: str, size: int, text: str = "text", at: int | None = None) -> DataFrame:
    """key, gram: a hash of every `size` successive ascii_tokens() of a text (at: of those from this place on alone). Equal tokens have equal hashes."""
    factor = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = _tokens(batch.column(1))
            if len(rows) < size:
                continue
            held = words.dictionary_encode()
            ends = np.frombuffer(held.dictionary.buffers()[1], np.int32)[: len(held.dictionary) + 1]
            sizes, letters = np.diff(ends), np.frombuffer(held.dictionary.buffers()[2], np.uint8)[: ends[-1]]
            powers = np.multiply.accumulate(np.full(sizes.max(), factor))
            hashes = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(ends[:-1], sizes)], ends[:-1])
            hashes ^= hashes >> np.uint64(29)
            each, last = hashes[held.indices.to_numpy()], len(rows) - size + 1
            gram = np.zeros(last, np.uint64)
            for k in range(size):
                gram = gram * factor + each[k : k + last]
            inside = rows[:last] == rows[size - 1 :]
            if at is not None:
                inside &= np.arange(last) - np.searchsorted(rows, rows[:last]) == at
            ends = pa.array(np.append(0, np.cumsum(np.bincount(rows[:last][inside], minlength=batch.num_rows))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(gram[inside].view(np.int64)))], names=[key, "grams"])

    texts = docs.select(key, F.lower(F.col(text)).alias("text")).where("text is not null")
    return texts.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, grams array<bigint>").select(key, F.explode("grams").alias("gram"))


def by_range(batches: Iterator[pa.RecordBatch], prepared=lambda part: part) -> Iterator[tuple[int, list]]:
    """(range, parts) of batches that are sorted by their first column, the range of documents or another whole number."""
    at, parts = None, []
    for batch in batches:
        ranges = batch.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(ranges)) + 1), len(ranges)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high == low:
                continue
            if parts and ranges[low] != at:
                yield at, parts
                parts = []
            at = ranges[low]
            parts.append(prepared(batch.slice(low, high - low)))
    if parts:
        yield at, parts


def _counted(docs: DataFrame, key: str, text: str, tokens, ranges: int) -> DataFrame:
    """range, term, at, tf, least_dl, least_dn: the postings of a range's terms as arrays side by side, by place; the row with keys has the range's
    documents in their places, their lengths as tf, and, as dn, how many different terms they have.
    Texts are exchanged once, to their range (four to a part, however many parts the session has by default), and a task tokenises and counts one range after the other."""
    texts = F.lower(F.col(text)) if tokens is ascii_tokens else tokens(F.col(text))
    placed = docs.select(F.pmod(F.xxhash64(key), F.lit(ranges)).alias("range"), F.col(key), texts.alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, parts in by_range(batches, lambda part: (part.column(1), *_tokens(part.column(2)))):
            rows = np.cumsum([0, *(len(keys) for keys, _, _ in parts)])
            doc = np.concatenate([d + before for (_, d, _), before in zip(parts, rows)])
            if not len(doc):
                continue
            words, keys = (pa.concat_arrays([p[k] for p in parts]).dictionary_encode(null_encoding="encode") for k in (2, 0))
            order = pc.sort_indices(keys.dictionary).to_numpy()
            names, most = keys.dictionary.take(pa.array(order)), len(order)
            doc = np.argsort(order)[keys.indices.to_numpy()][doc]
            dl = np.bincount(doc, minlength=most)
            pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * most + doc, return_counts=True)
            term, doc = pairs // most, pairs % most
            dn, here = np.bincount(doc, minlength=most), np.flatnonzero(dl)
            place, starts, count = np.cumsum(dl > 0) - 1, np.flatnonzero(np.diff(term, prepend=-1)), len(words.dictionary)
            ends = [*starts, len(doc), len(doc) + len(here)]  # the last row: the documents themselves
            side = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            last = lambda values: pa.ListArray.from_arrays(pa.array([*[None] * count, 0, len(here)], pa.int32()), values)
            least = lambda values: pa.array(np.append(np.minimum.reduceat(values[doc], starts), 0), pa.int32())
            columns = [
                pa.array(np.full(count + 1, at)), pa.concat_arrays([words.dictionary, pa.nulls(1, pa.string())]), side(np.append(place[doc], place[here])), side(np.append(tf, dl[here])),
                least(dl), least(dn), last(names.take(pa.array(here))), last(pa.array(dn[here], pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "term", "at", "tf", "least_dl", "least_dn", "keys", "dn"])

    kind = docs.schema[key].dataType.simpleString()
    return placed.repartition(-(-ranges // 4), "range").sortWithinPartitions("range").mapInArrow(run, f"range bigint, term string, at array<int>, tf array<int>, least_dl int, least_dn int, keys array<{kind}>, dn array<int>")


def _squares(weighed: DataFrame, ranges: int, width: int) -> DataFrame:
    """range, at and square: sums, within a task, of the squares of a document's tf-idf weights. weighed: range, scale, at, tf; width: the most documents of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ranges * width)
        for batch in batches:
            at, scales, places, tf = batch.columns
            sizes = pc.list_value_length(places).to_numpy()
            spots, one = np.unique(np.repeat(at.to_numpy() * width, sizes) + places.flatten().to_numpy(), return_inverse=True)
            total[spots] += np.bincount(one, ((1 + np.log(tf.flatten().to_numpy())) * np.repeat(scales.to_numpy(), sizes)) ** 2)
        spots = np.flatnonzero(total)
        for part in np.array_split(spots, -(-len(spots) // 100_000) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(part // width), pa.array((part % width).astype(np.int32)), pa.array(total[part])], names=["range", "at", "square"])

    return weighed.mapInArrow(run, "range bigint, at int, square double")


def _norms(squares: DataFrame, rows: DataFrame) -> DataFrame:
    """range and norm, the documents' norms by place. squares: those of _squares(); rows: range, keys."""
    every = squares.unionByName(rows.select("range", F.posexplode("keys").alias("at", "k")).select("range", "at", F.lit(0.0).alias("square")))
    norms = every.groupBy("range", "at").agg(F.sqrt(F.sum("square")).alias("norm")).groupBy("range").agg(F.array_sort(F.collect_list(F.struct("at", "norm"))).alias("norms"))
    return norms.select("range", F.col("norms.norm").alias("norm"))


def _left(blocks: DataFrame, ix: Index, terms: DataFrame | None = None) -> DataFrame:
    """Blocks without the places of documents that are gone; with terms (term, df), those of the terms alone, with their df."""
    if terms is not None:
        blocks = blocks.drop("df").join(F.broadcast(terms) if terms.count() <= HELD else terms, "term")
    met = blocks.join(F.broadcast(ix.gone) if ix.n <= HELD_DOCS else ix.gone.repartition(ix.ranges, "range").hint("shuffle_hash"), "range")
    stays = lambda at: ~F.get("gone", at)
    kept = met.where(F.exists("at", stays)).withColumn("tf", F.filter("tf", lambda tf, i: stays(F.get("at", i))))  # before at, which it reads
    return kept.withColumn("at", F.filter("at", stays)).drop("gone")


def removed(ix: Index, gone: DataFrame) -> Index:
    """A written index without some documents (a column of their keys). No posting is exchanged: places that are gone are marked by range and left out
    where blocks are read, and what is written is the marks and the terms' new counts."""
    before = ix.rows.withColumn("gone", F.lit(None).cast("array<boolean>")) if ix.gone is None else ix.rows.join(ix.gone, "range")
    each = before.select("range", "gone", F.posexplode("keys").alias("at", ix.key)).join(gone.select(ix.key).distinct().withColumn("__out", F.lit(True)), ix.key, "left")
    marks = each.select("range", F.struct("at", F.coalesce("__out", F.get("gone", "at"), F.lit(False)).alias("out")).alias("x"))
    marks = cut(marks.groupBy("range").agg(F.array_sort(F.collect_list("x")).alias("x")).select("range", F.col("x.out").alias("gone")), "gone")
    spark, rows = ix.rows.sparkSession, ix.rows.join(marks, "range")
    docs = rows.select(F.explode(F.arrays_zip("keys", "dl", "dn", "gone")).alias("d")).where("not d.gone").select(F.col("d.keys").alias(ix.key), F.col("d.dl").cast("bigint").alias("dl"), F.col("d.dn").cast("bigint").alias("dn"))
    n, total = docs.agg(F.count("*"), F.sum("dl")).first()
    left = replace(ix, docs=docs, n=n, gone=marks, stats=spark.createDataFrame([(n, total / n if n else None)], "n bigint, avgdl double").coalesce(1))
    left.terms = cut(_left(ix.blocks, left).groupBy("term").agg(F.sum(F.size("at")).alias("df")), "terms")
    width = ix.rows.agg(F.max(F.size("keys"))).first()[0]
    blocks = _left(ix.blocks, left, left.terms)
    left.norms = _norms(_squares(blocks.select("range", scale(n).alias("scale"), "at", "tf"), ix.ranges, width or 1), ix.rows)
    left.posts = flat(blocks, left)
    return left


def build_index(docs: DataFrame, key: str, path: str, text: str = "text", tokens=ascii_tokens, name: str = "index", ranges: int | None = None) -> str:
    """Writes the index of a table below path and returns its folder. The texts are tokenised once, in their range of documents, and postings are
    counted and moved in arrays, a row for each term of a range. ranges: so many ranges of documents (by default of about RANGE each)."""
    spark, mark = docs.sparkSession, source_mark(docs)
    folder = f"{path}/{name}-{LAYOUT}-{mark}"
    if is_written(spark, folder):
        return folder
    put = lambda df, part: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{part}")
    ranges = ranges or max(1, -(-docs.count() // RANGE))
    put(_counted(docs, key, text, tokens, ranges), "raw")
    raw = spark.read.parquet(f"{folder}/raw")
    counted, placed = raw.where("keys is null and term is not null"), raw.where("keys is not null")
    put(counted.groupBy("term").agg(F.sum(F.size("at")).alias("df"), F.count("*").alias("parts")), "terms")
    size = placed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n"), F.sum(F.aggregate("tf", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"),
                      F.sum(F.aggregate("dn", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("postings"), F.max(F.size("keys")).alias("width")).first()
    # A term of one range has its df in its row; of the others the tasks hold a table, where it is small enough.
    wide = spark.read.parquet(f"{folder}/terms").where("parts > 1").select("term", "df")
    weighed = counted.join(F.broadcast(wide) if wide.count() <= HELD else wide, "term", "left").withColumn("df", F.coalesce("df", F.size("at")))
    squares = _squares(weighed.select("range", scale(size["n"]).alias("scale"), "at", "tf"), ranges, size["width"] or 1)
    put(placed.select("range", "keys", F.col("tf").alias("dl"), "dn").join(_norms(squares, placed), "range"), "docs")
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << int((size["postings"] or 0) // POSTINGS).bit_length()))
    # Dealt once, by bucket, in as many parts as there are postings for (whatever the session's number is): a term's rows are together there, so its df and the files follow without another exchange.
    dealt = counted.select("term", "range", "at", "tf", "least_dl", "least_dn", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
    dealt = dealt.repartition(int((size["postings"] or 0) // (8 * POSTINGS)) + 1, "bucket").sortWithinPartitions("bucket", "term", "range").withColumn("df", F.sum(F.size("at")).over(Window.partitionBy("bucket", "term")))
    dealt = dealt.select("term", "range", "df", "at", "tf", F.array_max("tf").alias("most_tf"), "least_dl", "least_dn", "bucket")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/blocks")
    average = size["total"] / size["n"] if size["n"] else None
    put(spark.createDataFrame([(size["n"], average, mark, buckets, ranges)], "n bigint, avgdl double, mark string, buckets int, ranges int").coalesce(1), "manifest")
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/raw")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return folder


def is_written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_index(spark: SparkSession, folder: str, key: str) -> Index:
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    manifest, rows = read("manifest"), read("docs")
    docs = rows.select(F.explode(F.arrays_zip("keys", "dl", "dn")).alias("d")).select(F.col("d.keys").alias(key), F.col("d.dl").cast("bigint").alias("dl"), F.col("d.dn").cast("bigint").alias("dn"))
    blocks = spark.read.schema("term string, range bigint, df bigint, at array<int>, tf array<int>, most_tf int, least_dl int, least_dn int, bucket int").parquet(f"{folder}/blocks")
    row = manifest.first()
    ix = Index(key, blocks, docs, read("terms").select("term", "df"), manifest.select("n", "avgdl"), blocks, row["buckets"], row["ranges"], rows, row["n"])
    ix.posts = flat(blocks, ix)
    return ix


def open_index(docs: DataFrame, key: str, text: str = "text", tokens=ascii_tokens, name: str = "index", ranges: int | None = None) -> Index:
    """The written index of a table, built first if it is missing or stale."""
    spark = docs.sparkSession
    return read_index(spark, build_index(docs, key, f"{shared_folder(spark)}/quillon-index", text, tokens, name, ranges), key)


def staleness(spark: SparkSession, folder: str, docs: DataFrame) -> str:
    """missing, stale or fresh."""
    if not is_written(spark, folder):
        return "missing"
    return "fresh" if spark.read.parquet(f"{folder}/manifest").first()["mark"] == source_mark(docs) else "stale"


def snapshot(df: DataFrame, path: str, order: Column | str) -> str:
    """An immutable copy of a table, named by the digest of its rows: equal rows have one snapshot, whatever their partitions, and a name
    that is written is never written again."""
    spark = df.sparkSession
    row = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("j").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "j").cast("decimal(38,0)")).alias("b")).first()
    folder = f"{path}/snapshot-{hashlib.sha256(repr(tuple(row)).encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.sortWithinPartitions(order).write.mode("overwrite").parquet(folder)
    return folder
