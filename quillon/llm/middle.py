"""Fill-in-the-middle transformation with an index of distinct texts.

Texts repeat; where their lines end does not depend on the document. The index has one row for each distinct text: its 64-bit hash, by
which texts are grouped, the SHA-256 of its content, which verifies that the members of a group are one text (texts that share the hash
alone stay apart), how many documents have it, and the ends of its units, in code points, as an Elias-Fano list: the low bits of
each end packed, the high bits in unary. Documents are joined back to the index by both hashes, and the two cuts that a
document's seed draws are selected from the list without unpacking it all.

A task that builds the index makes one list for the copies in a batch; the lists of equal texts from several tasks are
merged into one. A text held by more than one document in 256 is joined in as many parts as it has 256ths of all documents: there are at
most 255 such texts, so only they are broadcast. The texts themselves are shuffled once, with their documents.

Defined results: null texts count as empty, null ids as the empty string in the seed; empty texts have no unit and stay plain; texts
that hold one of the three marks stay plain; very long texts are handled whole; repeated rows and repeated ids each give a row; an empty
table gives an empty one; columns named in `carry` go along, others are ignored, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import binary_parts, chunks, persist

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text is hot if more than one document in so many has it.
HOT = 256

_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)
INDEX = "h bigint, content binary, n_chars bigint, n bigint, width int, low binary, high binary, copies bigint"


def pack(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """(width, low, high) of ascending numbers up to universe: Elias-Fano. The i-th number's low `width` bits are packed; its high bits
    are the place of the i-th set bit of `high`, less i."""
    n = len(ends)
    if not n:
        return 0, b"", b""
    width = max(0, int(universe // n).bit_length() - 1)
    low = ((ends[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros((int(ends[-1]) >> width) + n, np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(i: int, width: int, low: bytes, high: bytes) -> int:
    """The i-th number (from 0) of a packed list."""
    bits = np.frombuffer(high, np.uint8)
    upto = np.cumsum(_ONES[bits])
    at = int(np.searchsorted(upto, i, "right"))
    left = i - (int(upto[at - 1]) if at else 0)
    place = at * 8 + int(np.flatnonzero((bits[at] >> np.arange(8)) & 1)[left])
    first = i * width
    word = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little") >> (first % 8)
    return ((place - i) << width) | (word & ((1 << width) - 1))


def line_ends(data: np.ndarray) -> np.ndarray:
    """Where the lines of a UTF-8 text end, in code points: after each line feed, and at the end if something follows the last."""
    if not len(data):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(data == 10) + 1
    if not len(starts) or starts[-1] != len(data):
        starts = np.append(starts, len(data))
    starts = np.concatenate([[0], starts[:-1]])
    return np.cumsum(np.add.reduceat((data & 0xC0) != 0x80, starts, dtype=np.int64))


def _listed(batches):
    """One row for each distinct content of a batch."""
    schema = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("n_chars", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("copies", pa.int64())])
    for batch in batches:
        data, offsets = binary_parts(batch.column("text"))
        hashes, contents = batch.column("h").to_pylist(), batch.column("content").to_pylist()
        for a, b in chunks(offsets, 1 << 24):
            rows: dict[bytes, list] = {}
            for i in range(a, b):
                have = rows.get(contents[i])
                if have is None:
                    ends = line_ends(data[offsets[i] : offsets[i + 1]])
                    size = int(ends[-1]) if len(ends) else 0
                    rows[contents[i]] = [hashes[i], contents[i], size, len(ends), *pack(ends, size), 1]
                else:
                    have[-1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows.values()), schema)], schema=schema)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*columns, text.alias("text")).select(*columns, "text", F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("content"))


def text_index(docs: DataFrame) -> DataFrame:
    """h, content, n_chars, n, width, low, high, copies: one row for each distinct text."""
    parts = _keyed(docs).select("h", "content", F.col("text").cast("binary").alias("text")).mapInArrow(_listed, INDEX)
    listed = F.first(F.struct("n_chars", "n", "width", "low", "high")).alias("l")
    return parts.groupBy("h", "content").agg(listed, F.sum("copies").alias("copies")).select("h", "content", "l.*", "copies")


@F.pandas_udf(T.StructType([T.StructField("first", T.LongType()), T.StructField("second", T.LongType())]))
def _cut(n: pd.Series, width: pd.Series, low: pd.Series, high: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The ends of the first a and the first b units of a list, the lesser first."""
    end = lambda k, w, lo, hi: select(k - 1, w, lo, hi) if k else 0
    rows = [(end(min(x, y), w, lo, hi), end(max(x, y), w, lo, hi)) for w, lo, hi, x, y in zip(width, low, high, a, b)]
    return pd.DataFrame(rows, columns=["first", "second"], dtype="int64")


def seeds(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of carry, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    docs needs doc_id and text. Of 100 documents about `rate` are cut, of those about `spm` in a hundred have the suffix first.
    """
    index = persist(text_index(docs), "texts")
    total = index.agg(F.sum("copies")).first()[0] or 0
    hot = index.where(F.col("copies") * HOT > F.lit(total)).select("h", "content", F.ceil(F.col("copies") * HOT / F.lit(max(total, 1))).alias("parts"))
    hot = F.broadcast(hot)  # fewer than HOT rows, as each holds more than a HOT-th of the documents
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).alias("part")
    members = _keyed(docs, "doc_id", *carry).join(hot, ["h", "content"], "left").select("doc_id", *carry, "text", "h", "content", part)
    lists = index.join(hot, ["h", "content"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    joined = members.join(lists.drop("parts", "copies").hint("shuffle_hash"), ["h", "content", "part"])
    h1, h2, h3, h4 = seeds(F.col("doc_id"), seed)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    drawn = joined.withColumn("form", form).withColumn("cut", _cut("n", "width", "low", "high", h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)))
    whole = F.col("form") == "plain"
    sized = drawn.withColumns({"a": F.col("cut.first").cast("int"), "m": (F.col("cut.second") - F.col("cut.first")).cast("int")})
    prefix, middle, suffix = F.expr("left(text, a)"), F.expr("substring(text, a + 1, m)"), F.expr("substring(text, a + m + 1)")
    output = F.when(whole, F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    chars = lambda c: F.when(~whole, F.col(c).cast("bigint"))
    return sized.select("doc_id", *carry, "n", "form", chars("a").alias("prefix_chars"), chars("m").alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that transform() made an output of; the marks alone tell the parts, as no text that is cut holds one."""
    second = F.when(form == "psm", F.instr(output, SUFFIX)).otherwise(F.instr(output, PREFIX))
    third = F.instr(output, MIDDLE)
    one, two = F.substring(output, F.lit(4), second - 4), F.substring(output, second + 3, third - second - 3)
    three = F.substring(output, third + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))
