"""Toxicity: a convolutional text classifier in numpy.

Words are hashed twice into embedding tables (the sum of two rows; a word collides with another only if both rows do), filters of
several widths run over the words, each filter's strongest response in the text (max pooling) feeds a logistic unit. Trained by Adagrad on
a bounded sample of labelled rows; embeddings start at zero but for one dimension, which starts at the word's log odds in the
sample, so words never seen add nothing. A threshold is set for each language
on labelled rows kept out of training, and the score is moved so that 0.5 is the threshold. The language comes from the
text's function words, and a text with none of them has the threshold of all; labels, the language column, sources and ids are never inputs of a score.

Sample: at most `most` rows and `most_bytes` bytes of whole texts of each label, by the order of their ids' hashes (a documented bound of
the fit alone, and of what reaches the driver: every row of the table is scored, over its whole text). Null texts count as empty; empty texts get the score of no evidence; where only one
label is known every score is that label's share; labels without a document or value are ignored, a document with several labels counts
as toxic if one says so; very long texts are scored whole; repeated rows get equal scores; an empty table gives an empty one; only id and text of the
documents are read, so no other column can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import binary_parts, chunks, scan_words

# Function words by which a text's language is told, and the shape of the network.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as be at by this have from or an not which".split(),
    "de": "der die und das von zu den mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "le la les et des du une est que dans qui pour sur pas au avec ce il sont par plus".split(),
    "es": "el los las y del una es que por con para se lo como más pero sus al en su".split(),
}
ROWS, WIDE, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(scan_words(data, np.array([0, len(data)]), lower=True, marks=True)[0][0])


LANGUAGES = sorted(FUNCTION_WORDS)


def _speaks() -> np.ndarray:
    """Row of the first table -> 1 + the language whose function word it is, else 0."""
    out = np.zeros(ROWS, np.int8)
    for k, name in enumerate(LANGUAGES):
        for word in FUNCTION_WORDS[name]:
            out[_word_hash(word) & (ROWS - 1)] = k + 1
    return out


@dataclass
class Batch:
    """Words of several texts, each text followed by pads so that no filter reaches into the next."""

    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    language: np.ndarray


def prepare(data: np.ndarray, offsets: np.ndarray, speaks: np.ndarray) -> Batch:
    hashes, rows, _ = scan_words(data, offsets, lower=True, marks=True)
    n, pad = len(offsets) - 1, max(WIDTHS)
    size = np.bincount(rows, minlength=n)
    starts = np.concatenate([[0], np.cumsum(size + pad)])[:-1]
    place = np.arange(len(hashes)) + pad * rows
    total = len(hashes) + pad * n
    first, second = np.full(total, ROWS, np.int64), np.full(total, ROWS, np.int64)  # the row after the last is the pad
    first[place] = (hashes & np.uint64(ROWS - 1)).astype(np.int64)
    second[place] = ((hashes * _SECOND) >> np.uint64(46)).astype(np.int64)
    votes = np.bincount(rows * 8 + speaks[first[place]], minlength=8 * n).reshape(n, 8)[:, 1 : 1 + len(LANGUAGES)] if n else np.zeros((0, len(LANGUAGES)))
    return Batch(first, second, starts, np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1), len(LANGUAGES)) if n else np.zeros(0, np.int64))


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.one, self.two = np.zeros((ROWS + 1, WIDE), np.float32), np.zeros((ROWS + 1, WIDE), np.float32)
        deep = max(WIDTHS)
        # One matrix holds all filters: rows are (offset, dimension), and a filter of width w is zero beyond offset w.
        self.mask = np.concatenate([np.repeat(np.arange(deep)[:, None] < w, WIDE, axis=0).repeat(FILTERS, axis=1) for w in WIDTHS], axis=1)
        self.filters = (rng.normal(0, 0.3, (deep * WIDE, FILTERS * len(WIDTHS))) * self.mask).astype(np.float32)
        self.bias = np.full(FILTERS * len(WIDTHS), 0.05, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.rest = np.float32(-1.0)
        self.thresholds = np.zeros(len(LANGUAGES) + 1)  # the last: texts without a vote for any language

    def start(self, first: np.ndarray, second: np.ndarray, evidence: np.ndarray) -> None:
        """Half of each word's evidence goes into the first dimension of each of its rows, which the first filter reads."""
        self.one[first, 0] = evidence / 2
        self.two[second, 0] = evidence / 2
        self.filters[:, 0] = 0
        self.filters[0, 0] = self.out[0] = 1
        self.rest = np.float32(-2.5)

    def windows(self, b: Batch) -> np.ndarray:
        word = self.one[b.first] + self.two[b.second]
        deep = max(WIDTHS)
        padded = np.concatenate([word, np.zeros((deep - 1, WIDE), np.float32)])
        return np.concatenate([padded[d : d + len(word)] for d in range(deep)], axis=1)

    def logits(self, b: Batch) -> np.ndarray:
        if not len(b.starts):
            return np.zeros(0)
        response = self.windows(b) @ self.filters
        ends = np.append(b.starts[1:], len(b.first))
        for d in range(1, max(WIDTHS)):  # windows that begin at the last pads would reach into the next text
            response[ends - d] = -np.inf
        pooled = np.maximum.reduceat(response, b.starts, axis=0)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.rest

    def train(self, b: Batch, labels: np.ndarray, memory: dict, rate: float = 0.03) -> None:
        x = self.windows(b)
        response = x @ self.filters + self.bias
        ends = np.append(b.starts[1:], len(b.first)) - (max(WIDTHS) - 1)
        top = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(b.starts, ends)])  # text x filter
        columns = np.arange(response.shape[1])[None, :]
        pooled = np.maximum(response[top, columns], 0)
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.rest)))
        error = (p - labels) / len(labels)
        back = error[:, None] * self.out[None, :] * (pooled > 0)
        picked = x[top]  # text x filter x (offset, dimension)
        grad_filters = np.einsum("tf,tfk->kf", back, picked) * self.mask
        grad_words = (back[:, :, None] * self.filters.T[None]).reshape(*back.shape, max(WIDTHS), WIDE)
        at = np.minimum(top[:, :, None] + np.arange(max(WIDTHS)), len(b.first) - 1)
        used = np.abs(grad_words).sum(axis=-1) > 0
        for name, index in (("one", b.first), ("two", b.second)):
            rows = index[at[used]]
            unique, back_to = np.unique(rows, return_inverse=True)
            grad = np.zeros((len(unique), WIDE), np.float32)
            np.add.at(grad, back_to, grad_words[used])
            grad[unique == ROWS] = 0
            memory[name][unique] += grad**2
            getattr(self, name)[unique] -= rate * grad / (np.sqrt(memory[name][unique]) + 1e-6)
        for name, grad in (("filters", grad_filters), ("bias", back.sum(axis=0)), ("out", error @ pooled), ("rest", error.sum())):
            memory[name] = memory.get(name, 0) + grad**2
            setattr(self, name, (getattr(self, name) - rate * grad / (np.sqrt(memory[name]) + 1e-6)).astype(np.float32))


def word_evidence(parts: list[Batch], labels: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the first table, rows of the second, evidence) of the words that are not rare: log odds ratios of the shares of
    toxic and other texts with the word, shrunk where few texts have it."""
    codes = [np.unique(p.first * (ROWS << 1) + p.second) for p in parts]
    word, at = np.unique(np.concatenate(codes), return_inverse=True)
    y = np.repeat(labels, [len(c) for c in codes])
    bad, good = np.bincount(at[y == 1], minlength=len(word)), np.bincount(at[y == 0], minlength=len(word))
    odds = np.log((bad + 0.5) / ((labels == 1).sum() + 1)) - np.log((good + 0.5) / ((labels == 0).sum() + 1))
    first, second = word // (ROWS << 1), word % (ROWS << 1)
    use = ~rare[first] & (first < ROWS)
    return first[use], second[use], (odds * (bad + good) / (bad + good + 5))[use]


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors, in the middle of its gap (the widest gap where several have as few)."""
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    if not len(x) or y.all() or not y.any():
        return 0.0
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    gap = edges[1:] - edges[:-1]
    k = int(np.lexsort((-gap, errors))[0])
    return float((edges[k] + edges[k + 1]) / 2)


def fit(texts: list[bytes], labels: np.ndarray, kept_out: np.ndarray, steps: int = 100, batch: int = 32, seed: int = 5, least_texts: int = 4) -> Network | float:
    """The network trained on the rows not kept out, with thresholds by language on the others; one label: its share.

    There are three rounds over the rows, and more where so few rows make fewer than `steps` steps. Words of fewer than `least_texts` training texts stay at zero: they could only be learned by heart.
    """
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    speaks, net, rng = _speaks(), Network(seed), np.random.default_rng(seed)
    memory = {"one": np.zeros((ROWS + 1, WIDE), np.float32), "two": np.zeros((ROWS + 1, WIDE), np.float32)}

    def made(rows) -> Batch:
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])]).astype(np.int64)
        return prepare(np.frombuffer(b"".join(texts[i] for i in rows), np.uint8), offsets, speaks)

    rows = np.flatnonzero(~kept_out)
    seen = np.zeros(ROWS + 1, np.int64)
    for i in rows:
        seen[np.unique(made([i]).first)] += 1
    rare = seen < least_texts
    net.start(*word_evidence([made([i]) for i in rows], labels[rows], rare))
    for _ in range(max(3, -(-steps * batch // max(1, len(rows))))):
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            part = rows[k : k + batch]
            words = made(part)
            words.second[rare[words.first]] = ROWS
            words.first[rare[words.first]] = ROWS
            net.train(words, labels[part].astype(np.float32), memory)
    held = np.flatnonzero(kept_out) if kept_out.any() else rows
    parts = [made(held[k : k + 64]) for k in range(0, len(held), 64)]
    logits, language = np.concatenate([net.logits(p) for p in parts]), np.concatenate([p.language for p in parts])
    overall = net.thresholds[-1] = best_threshold(logits, labels[held])
    for k in range(len(LANGUAGES)):
        mine = language == k
        share = min(1.0, labels[held][mine].sum() / 50)  # few examples: lean on the threshold of all
        net.thresholds[k] = share * best_threshold(logits[mine], labels[held][mine]) + (1 - share) * overall
    return net


def sample(docs: DataFrame, labels: DataFrame, most: int = 3000, most_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """id, label, kept_out and text of at most `most` labelled rows of each label, none of them held out: the first by their ids'
    hashes whose whole texts together have at most `most_bytes` bytes a label."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("label")).where(~is_held_out(F.col("id")))
    chosen = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(most).unionByName(known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(most))
    found = chosen.join(docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").cast("binary").alias("text")), "id")
    lengths = found.select("id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).groupBy("id", "label").agg(F.sum("bytes").alias("bytes"))
    so_far = F.sum("bytes").over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))  # at most `most` rows a label
    fits = lengths.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("id")
    return found.join(fits, "id").select("id", "label", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0).alias("kept_out"), "text")


def score(docs: DataFrame, model: Network | float, text: str = "text") -> DataFrame:
    """Adds score (double) to the rows; the text column goes. The model is broadcast: its size is fixed (16 MB)."""
    keep = [c for c in docs.columns if c not in ("score", text)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net, speaks = shared.value, _speaks()
        for batch in batches:
            data, offsets = binary_parts(batch.column(batch.num_columns - 1))
            for a, b in chunks(offsets, 1 << 20):
                if isinstance(net, Network):
                    words = prepare(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], speaks)
                    scores = 1 / (1 + np.exp(-np.clip(net.logits(words) - net.thresholds[words.language], -30, 30).astype(np.float64)))
                else:
                    scores = np.full(b - a, net)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], pa.array(scores, pa.float64())], names=[*keep, "score"])

    from pyspark.sql import types as T

    return source.mapInArrow(run, T.StructType([*[source.schema[c] for c in keep], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, most: int = 3000, most_bytes: int = 32 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = sample(docs, labels, most, most_bytes, doc_id, text, label).toPandas().sort_values("id")
    model = fit([bytes(x) if x is not None else b"" for x in rows["text"]], rows["label"].to_numpy(np.int64), rows["kept_out"].to_numpy(bool))
    scored = score(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
