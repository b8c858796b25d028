"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the n-grams of all languages at once: a row of bits, one a language, stands at each of its places, an
n-gram has HASHES places, and the AND of their rows is the set of all languages that contain the n-gram (and of a few that seem to).
A text is looked up n-gram by n-gram; the popcount of each language's column, less what its share of false positives would give, decides.

N-grams are runs of one to four characters of lower-cased words, with the borders of words as characters of their own; digits, marks and
blanks are borders. A language contains an n-gram if it has it at least LEAST times in the texts that are learned from, and at no less than
1 / RATIO of the rate of the language that has it most: foreign words and quotes in a language's documents do not make them its own.

Languages are learned from at most about `most` documents and `most_bytes` bytes of whole texts of each language, taken by hashes of id and
text, so the filter's size is bounded too (MOST_PLACES rows). Only the shares of the sample (a row a language) and the filter reach the driver.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text where nothing is learned. A text none of
whose n-grams is known gets the language with the most documents, with score 0. Ties go to the language with more documents, then by code
point. Null ids count as the empty string in the split; documents without a language are predicted like others; very long texts are
read whole, in pieces; repeated rows and ids each give a row; an empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix

LONGEST, HASHES, LEAST, RATIO = 4, 2, 2, 8
#: Rows of the filter for each n-gram, and rows at most (8 bytes for every 64 languages).
PLACES, MOST_PLACES = 16, 1 << 21
UNKNOWN = "und"
PIECE = 1 << 20
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_LENGTHS = np.arange(LONGEST + 1, dtype=np.uint64) * _SEEDS[0]
_BASE = np.uint64(0x100000001B3)


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark that combines with one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


@functools.cache
def true_letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def flattened(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, offsets, lettered): the code points of the lower-cased texts, 0 for all but letters, each text after a 0 of its own and
    one more at the end; where each text begins; whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64)
    points = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    has = np.add.reduceat(true_letters()[points[:-1]], offsets[:-1], dtype=np.int64) > 0 if len(low) else np.zeros(0, bool)
    return np.where(letters()[points], points, 0), offsets, has


def grams(points: np.ndarray):
    """(hashes, starts) of all n-grams, a length at a time: runs of letters, the first and last character maybe a border.

    A hash tells lengths apart, so a word's border never takes the place of a letter. Texts do not share n-grams: between two lies one border, and
    no n-gram goes across it.
    """
    wide = points.astype(np.uint64)
    is_letter = points > 0
    rolled, inner = wide.copy(), np.ones(len(points), bool)
    for n in range(1, LONGEST + 1):
        m = len(points) - n + 1
        if m <= 0:
            return
        if n > 1:
            rolled = rolled[:m] * _BASE + wide[n - 1 :]
        if n > 2:
            inner = inner[:m] & is_letter[n - 2 : n - 2 + m]
        if n == 1:
            starts = np.flatnonzero(is_letter)
        elif n == 2:
            starts = np.flatnonzero(is_letter[:m] | is_letter[1:])
        else:
            starts = np.flatnonzero(inner[:m])
        yield mix(rolled[starts] + _LENGTHS[n]), starts


def pieces(points: np.ndarray):
    """(first, part) of the points in pieces that overlap by the longest n-gram, so that memory does not grow with a text."""
    for a in range(0, len(points), PIECE):
        yield a, min(PIECE, len(points) - a), points[a : a + PIECE + LONGEST - 1]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the n-grams of some texts."""
    points, _, _ = flattened(texts)
    hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, size, part in pieces(points):
        found = [h[s < size] for h, s in grams(part)]
        new, many = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hashes, at = np.unique(np.concatenate([hashes, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, many]), len(hashes)).astype(np.int64)
    return hashes, counts


def spots(hashes: np.ndarray, k: int, places: int) -> np.ndarray:
    """The k-th place of each n-gram in a filter of `places` rows (a power of two)."""
    return (mix(hashes ^ _SEEDS[k]) & np.uint64(places - 1)).astype(np.int64)


@dataclass
class Filter:
    """languages in order of their documents; rows[w] has the bits of languages 64 w to 64 w + 63 at each place."""

    languages: list[str]
    rows: np.ndarray

    def __post_init__(self):
        n, places = len(self.languages), self.rows.shape[1]
        full = [np.count_nonzero((self.rows[j // 64] >> np.uint64(j % 64)) & np.uint64(1)) / places for j in range(n)]
        self.false = np.array(full) ** HASHES  # how often a language seems to contain an n-gram that it does not

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of the languages that contain it."""
        out = self.rows[:, spots(hashes, 0, self.rows.shape[1])]
        for k in range(1, HASHES):
            out &= self.rows[:, spots(hashes, k, self.rows.shape[1])]
        return out

    def popcounts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, total, lettered): for each text and language the n-grams that the language seems to contain; all n-grams; letters."""
        points, offsets, has = flattened(texts)
        found, total = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        for first, size, part in pieces(points):
            for hashes, starts in grams(part):
                inside = starts < size
                hashes, starts = hashes[inside], starts[inside] + first
                if not len(starts):
                    continue
                rows = np.searchsorted(offsets, starts, "right") - 1
                heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                rows = rows[heads]
                # The last border belongs to no text; the 2-gram of a text's last border and the next text's first letter begins on the latter's border.
                rows = np.minimum(rows, len(texts) - 1)
                masks = self.containing(hashes)
                total[rows] += np.diff(np.append(heads, len(starts)))
                for j in range(len(self.languages)):
                    bits = ((masks[j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.uint8)
                    found[rows, j] += np.add.reduceat(bits, heads, dtype=np.int64)
        return found, total, has

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text. The score is the winner's corrected popcount over that of the two best."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found, total, has = self.popcounts(texts)
        true = np.maximum(found - total[:, None] * self.false, 0.0) / np.maximum(1 - self.false, 1e-9)
        best = true.argmax(1)
        top = np.sort(true, 1)[:, ::-1]
        both = top[:, :2].sum(1)
        score = np.where(both > 0, top[:, 0] / np.maximum(both, 1e-12), 0.0)
        return [(self.languages[b], float(s)) if h else (UNKNOWN, 0.0) for b, s, h in zip(best.tolist(), score.tolist(), has.tolist())]


def _counts(batches):
    """lang, gram and count of the n-grams of a batch."""
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        for lang in sorted(set(langs.tolist())):
            hashes, counts = counted([texts[i] for i in np.flatnonzero(langs == lang)])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def sample(docs: DataFrame, most: int, most_bytes: int) -> tuple[DataFrame, list[str]]:
    """lang and text of the documents that are learned from (docs: doc_id, lang, text), and the languages, those of most documents first."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    sizes = known.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row a language
    sizes.sort(key=lambda r: (-r["docs"], r["lang"]))
    if not sizes:
        return known.select("lang", "text"), []
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, most / r["docs"], most_bytes / max(1, r["bytes"])))])
    drawn = (F.xxhash64("doc_id", "text") / float(1 << 63) + 1) / 2  # evenly spread over 0 to 1
    return known.where(drawn <= share[F.col("lang")]).select("lang", "text"), [r["lang"] for r in sizes]


def fit(docs: DataFrame, most: int = 20_000, most_bytes: int = 32 << 20) -> Filter:
    """The filter of the languages of docs (doc_id, lang, text), without held-out documents."""
    rows, languages = sample(docs, most, most_bytes)
    if not languages:
        return Filter([], np.zeros((1, 1), np.uint64))
    counts = rows.mapInArrow(_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    number = F.create_map(*[F.lit(x) for j, lang in enumerate(languages) for x in (lang, j)])
    counts = counts.select(number[F.col("lang")].alias("j"), "gram", "n").persist()
    try:
        totals = {r["j"]: r["n"] for r in counts.groupBy("j").agg(F.sum("n").alias("n")).collect()}  # one row a language
        total = F.create_map(*[F.lit(x) for j, n in totals.items() for x in (j, float(n))])
        rated = counts.withColumn("rate", F.col("n") / total[F.col("j")])
        most_of = rated.groupBy("gram").agg(F.collect_list(F.struct("j", "n", "rate")).alias("l"), F.max("rate").alias("top"))  # at most one a language
        having = most_of.select("gram", F.filter("l", lambda x: (x["n"] >= LEAST) & (x["rate"] * RATIO >= F.col("top"))).alias("l")).where(F.size("l") > 0)
        n_grams = having.count()
        places = min(MOST_PLACES, 1 << max(6, int(n_grams * PLACES - 1).bit_length()))
        words = -(-len(languages) // 64)
        bits = having.select("gram", F.explode(F.transform("l", lambda x: x["j"])).alias("j")).select("gram", F.floor(F.col("j") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, j % 64)").alias("bit"))

        def placed(batches):
            for batch in batches:
                h = batch.column("gram").to_numpy().view(np.uint64)
                for k in range(HASHES):
                    yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(spots(h, k, places)), batch.column("bit")], names=["w", "place", "bits"])

        filled = bits.mapInArrow(placed, "w int, place bigint, bits bigint").groupBy("w", "place").agg(F.bit_or("bits").alias("bits"))
        table = filled.toArrow()  # at most MOST_PLACES rows for every 64 languages
    finally:
        counts.unpersist()
    out = np.zeros((words, places), np.uint64)
    out[table["w"].to_numpy(), table["place"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return Filter(languages, out)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred and score of docs (doc_id, text). The filter is broadcast: at most 16 MB for every 64 languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                told = shared.value.decide(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], names=["doc_id", "lang_pred", "score"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, most: int = 20_000, most_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document of docs (doc_id, lang, text)."""
    told = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "lang", "text"), most, most_bytes))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
