"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact intersection.

A document's set are its distinct n-word shingles (as hashes). Two sets link when 100 * |A and B| >= percent * |A or B|.

Candidates. Shingles are ordered by a corpus-wide sketch of their counts, rare ones first, then by hash. Two linked sets share
a shingle among the first |A| - ceil(t|A|) + 1 of each (the prefix filter), so every link lies in some tile: the sets whose
prefix holds one shingle. One exchange by shingle, sorted in its partitions, tells tiles of two sets or more; tiles with the
same members are one. In a tile only sets of nearby sizes meet.
Signatures. A set's bitmap holds the parity of its shingles' hashed places; its width follows the size band, and a wide
bitmap folds onto a narrower one. The number of differing bits bounds the symmetric difference from below, hence the
overlap from above; pairs whose bound is too small go.
Verification. What is left is decided by intersecting the sorted shingle arrays of the two whole texts.

Equal sets are one node from the start. A first pass tries each tile's nodes against the tile's least and greatest node only;
what links is contracted. Further passes take the tiles in which more than one component is left, compare their other nodes of
different components by their bitmaps, and send on a spanning forest of the components, best bounds first (then 8, 64, ...
edge-disjoint ones in tiles where a pair that was sent did not link), so that what leaves a tile grows with its nodes, not
with their pairs. Tiles of any size are cut into block pairs; none is capped. A tile is done when no pair is left that is
untried, passes its bounds and joins two components. So the links found span the components of all links; links within a
component already known need no proof.

Defined results: null and empty texts, and texts without a word, have an empty set, size 0, and link with nothing; texts of
fewer words than n have one shingle, the whole sequence; null ids are rows of their own whose component is the least
non-null id reachable, else null; repeated rows are equal sets; very long texts are read whole, and their sets are compared whole; other columns are dropped, so none can clash; an empty table gives an empty one.
Hashes have 48 bits for intersections and 64 for sets: the chance of a wrong decision is below 1e-6 a pair of 10,000 words each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_parts, chunks, free, giving_back, mix, persist, scan_words
from .graph import components, forest

_LOW = np.uint64((1 << 56) - 1)
#: Bits of the widest bitmap. Sets of more shingles keep this width: their bound is weaker, and more of them are intersected.
WIDEST = 1 << 16
#: Bytes of texts that a task shingles at once (its arrays take some hundred times as much; a longer text is shingled alone).
CHUNK = 1 << 18
#: Rows of a shingle in one partition of the token exchange; by the sketch's counts, more frequent ones are dealt over several.
SPLIT = 1 << 16


class Shingles:
    """Shingle sets of texts; `ranks` is the sketch's rank (0 to 255) of each bucket (or None: all alike)."""

    def __init__(self, words: int, ranks: np.ndarray | None = None):
        self.words, self.ranks = words, ranks
        self.mask = np.uint64(len(ranks) - 1) if ranks is not None else None

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, rows) of all shingles of the rows, with repeats."""
        hashes, rows, _ = scan_words(data, offsets, lower=True)
        k, total = self.words, len(hashes)
        if not total:
            return hashes, rows
        size = np.bincount(rows, minlength=len(offsets) - 1)
        short = (size > 0) & (size < k)
        joined = np.zeros(total, np.uint64)
        spread = np.uint64(0x9FB21C651E98DF25)
        for d in range(k):  # h = sum of word hashes times powers of an odd number: the order counts
            joined[: total - d] = joined[: total - d] * spread + hashes[d:]
        place = np.arange(total) - np.searchsorted(rows, rows)
        full = place + k <= size[rows]
        out, out_rows = mix(joined[full]), rows[full]
        if short.any():
            firsts = np.flatnonzero((place == 0) & short[rows])
            whole = np.empty(len(firsts), np.uint64)
            for i, at in enumerate(firsts):
                h = int(size[rows[at]])
                for x in hashes[at : at + size[rows[at]]].tolist():
                    h = (h * int(spread) + x) % (1 << 64)
                whole[i] = h
            out, out_rows = np.concatenate([out, mix(whole)]), np.concatenate([out_rows, rows[firsts]])
        return out, out_rows

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, ends): each row's distinct shingles in the order of the join, and where each row's stop."""
        hashes, rows = self.raw(data, offsets)
        keys = hashes & _LOW
        if self.ranks is not None:
            keys |= self.ranks[(hashes & self.mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[new], rows[new]
        return keys, np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))


def nodes_of(keys: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hash of every set, whatever the order of its keys; 0 for empty ones."""
    node, some = np.zeros(len(n), np.uint64), n > 0
    if len(keys):
        node[some] = mix(np.add.reduceat(mix(keys & _LOW), starts[some]) + n[some].astype(np.uint64))
    return node


def width_of(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n shingles: a power of two, two to four times n, from 64 to WIDEST."""
    return np.minimum(WIDEST, np.int64(2) << np.maximum(5, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64))


def bitmaps(keys: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each set's parity bitmap: the bit at mix(key) mod width is flipped once a shingle."""
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    width = np.where(n > 0, width_of(n), 0)
    base = np.cumsum(width) - width
    at = np.repeat(base, n) + (mix(keys & _LOW) & (np.repeat(width, n) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[b // 8 : (b + w) // 8] for b, w in zip(base.tolist(), width.tolist())]


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) on fewer words: halves are added modulo 2."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def enough(overlap, a, b, percent: int):
    """100 * overlap >= percent * (a + b - overlap)."""
    return (100 + percent) * overlap >= percent * (a + b)


def shingle_ranks(docs: DataFrame, words: int, buckets: int, text: str) -> np.ndarray:
    """A rank, eight steps to a doubling and at most 255, of how many shingles (repeats in a text included) fall into each bucket,
    over all documents. Fixed size: `buckets` bytes."""

    def run(batches):
        maker, total = Shingles(words), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = binary_parts(batch.column(0))
            for a, b in chunks(offsets, CHUNK):
                hashes, _ = maker.raw(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total += np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 20_000], pa.int32()), pa.array(total[at[i : i + 20_000]], pa.int64())], names=["bucket", "n"])

    table = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("t")).mapInArrow(giving_back(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.ones(buckets)
    out[table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    return np.minimum(255, np.round(8 * np.log2(out))).astype(np.uint8)


def signatures(docs: DataFrame, words: int, percent: int, ranks, doc_id: str, text: str) -> DataFrame:
    """doc_id, n and node (hash of the set) of every document; bitmap and prefix of the first with its set in a task (else null:
    a hot group of copies is one row a task). ranks: broadcast sketch."""
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))

    def run(batches):
        maker, seen = Shingles(words, ranks.value), set()
        for batch in batches:
            data, offsets = binary_parts(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                keys, ends = maker.sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                starts = np.concatenate([[0], ends[:-1]])
                n = ends - starts
                node = nodes_of(keys, starts, n)
                new = np.zeros(b - a, bool)
                for i, x in enumerate(node.tolist()):
                    if n[i] and x not in seen:
                        seen.add(x)
                        new[i] = True
                take = np.where(new, n - (percent * n + 99) // 100 + 1, 0)
                cuts = np.concatenate([[0], np.cumsum(take)])
                at = np.repeat(starts - cuts[:-1], take) + np.arange(cuts[-1])
                prefix = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(keys[at].view(np.int64)))
                bits = pa.array([x if first else None for x, first in zip(bitmaps(keys, ends), new.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(node.view(np.int64)), bits, prefix], names=["doc_id", "n", "node", "bitmap", "prefix"])

    return source.mapInArrow(giving_back(run), "doc_id bigint, n bigint, node bigint, bitmap binary, prefix array<bigint>")


TILES = "token bigint, node bigint, n bigint, mark bigint, m bigint, low bigint, low_n bigint, high bigint, high_n bigint"


def shared_tokens(rows: DataFrame) -> DataFrame:
    """Of token, part, node and n, dealt by token and part and sorted by both and node: the rows of tokens with two nodes or more (or of
    several parts), each node once, and after them a row with null node: mark (a hash of the members), m (their number), the least and
    the greatest node and their sizes. Holds one batch at a time, whatever a token's rows."""

    def run(batches):
        held = None  # the last token's, not ended: [token, part, last node, mark, m, low, low_n, high, high_n, whether its first row is out]
        for batch in batches:
            token, part, node, n = (np.array(batch.column(c)) for c in range(4))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1])
            if held is not None:
                new[0] = [token[0], part[0], node[0]] != held[:3]
            token, part, node, n = token[new], part[new], node[new], n[new]
            if not len(token):
                continue
            hashes = mix(node.view(np.uint64)).view(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))
            ends = np.append(edge[1:], len(token))
            goes_on = held is not None and [token[0], part[0]] == held[:2]
            size = ends - edge
            shown = np.repeat((size > 1) | (part[edge] >= 0), size)
            marks, ends_ = [], []  # the summaries of the tokens that end here
            early = []  # a held first row that turns out to be shared

            def close(x):
                if x[4] > 1 or x[1] >= 0:
                    ends_.append([x[0], *x[3:9]])

            if goes_on:
                if not held[9]:
                    early.append((held[0], held[5], held[6]))
                shown[: size[0]] = True
            elif held is not None:
                close(held)
            with np.errstate(over="ignore"):
                marks = np.add.reduceat(hashes, edge)
            first, last = edge, ends - 1
            for k in [0, len(edge) - 1] if len(edge) > 1 else [0]:
                x = [int(token[first[k]]), int(part[first[k]]), int(node[last[k]]), int(marks[k]), int(size[k]), int(node[first[k]]), int(n[first[k]]), int(node[last[k]]), int(n[last[k]]), bool(shown[first[k]])]
                if k == 0 and goes_on:
                    total = (x[3] + held[3] + (1 << 63)) % (1 << 64) - (1 << 63)
                    x = [*x[:3], total, x[4] + held[4], held[5], held[6], x[7], x[8], True]
                if k == len(edge) - 1:
                    held = x
                else:
                    close(x)
            middle = np.arange(1, len(edge) - 1)
            middle = middle[(size[middle] > 1) | (part[edge[middle]] >= 0)]
            tokens = np.concatenate([np.array([e[0] for e in early], np.int64), token[shown]])
            nodes_ = np.concatenate([np.array([e[1] for e in early], np.int64), node[shown]])
            sizes = np.concatenate([np.array([e[2] for e in early], np.int64), n[shown]])
            if len(tokens):
                blank = pa.nulls(len(tokens), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(nodes_), pa.array(sizes), *[blank] * 6], names=NAMES)
            columns = [np.concatenate([np.array([e[i] for e in ends_], np.int64), v]) for i, v in enumerate((token[edge[middle]], marks[middle], size[middle], node[first[middle]], n[first[middle]], node[last[middle]], n[last[middle]]))]
            yield from summaries(columns)
        if held is not None and (held[4] > 1 or held[1] >= 0):
            if not held[9]:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (held[0], held[5], held[6])] + [pa.nulls(1, pa.int64())] * 6, names=NAMES)
            yield from summaries([np.array([v], np.int64) for v in (held[0], *held[3:9])])

    def summaries(columns):
        if len(columns[0]):
            blank = pa.nulls(len(columns[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), blank, blank, *[pa.array(c) for c in columns[1:]]], names=NAMES)

    NAMES = [x.split()[0] for x in TILES.split(", ")]
    return rows.select("token", "part", "node", "n").mapInArrow(giving_back(run), TILES)


def bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """a and b of the pairs (a, b, na, nb, bits_a, bits_b) whose sizes and bitmaps allow a link."""

    def run(batches):
        for batch in batches:
            na, nb = (np.array(batch.column(i)) for i in (2, 3))
            fits = enough(np.minimum(na, nb), na, nb, percent)
            for i in np.flatnonzero(fits):
                x, y = (np.frombuffer(batch.column(c)[int(i)].as_py(), np.uint64)[None] for c in (4, 5))
                least = min(x.shape[1], y.shape[1])
                differ = int(np.bitwise_count(fold(x, least) ^ fold(y, least)).sum())
                fits[i] = enough((na[i] + nb[i] - differ) // 2, na[i], nb[i], percent)
            kept = pa.array(fits)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(giving_back(run), "a bigint, b bigint")


def members(keys: DataFrame, bits: int = 1 << 24) -> np.ndarray:
    """A bitmap of fixed size (`bits`, as 64-bit words) in which the place of every key's hash is set; keys: a column k."""
    words = keys.select(F.pmod(F.xxhash64("k"), F.lit(bits)).alias("p")).select(F.expr("cast(p div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    table = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[table["w"].to_numpy(np.int64)] = table["b"].to_numpy(np.int64).view(np.uint64)
    return out


def sets_of(nodes: DataFrame, docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """node and keys (its sorted shingles, six bytes each) of the nodes (node, min_doc), from their least documents' whole texts; rows of
    other nodes, and of one node several, may be among them.

    Texts are not shuffled: a bitmap of the wanted ids, of fixed size, lets each task of a scan shingle those alone. Where the wanted
    ids fill the bitmap more is shingled and written, but nothing is lost.
    """
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    wanted = docs.sparkSession.sparkContext.broadcast(members(nodes.select(key(F.col("min_doc")).alias("k"))))
    bits = len(wanted.value) * 64
    source = docs.select(F.pmod(F.xxhash64(key(F.col(f"`{doc_id}`").cast("bigint"))), F.lit(bits)).alias("place"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))

    def run(batches):
        maker, seen, have = Shingles(words), set(), wanted.value
        for batch in batches:
            place = np.array(batch.column(0))
            batch = batch.filter(pa.array((have[place // 64] >> (place % 64).astype(np.uint64) & np.uint64(1)).astype(bool)))
            if not batch.num_rows:
                continue
            data, offsets = binary_parts(batch.column(1))
            for a, b in chunks(offsets, CHUNK):
                keys, ends = maker.sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                starts = np.concatenate([[0], ends[:-1]])
                node = nodes_of(keys, starts, ends - starts)
                out = []
                for i in np.flatnonzero(ends > starts).tolist():
                    if (x := int(node[i])) not in seen:
                        seen.add(x)
                        low = np.sort(keys[starts[i] : ends[i]] & np.uint64((1 << 48) - 1))
                        out.append((i, low.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)[[i for i, _ in out]]), pa.array([k for _, k in out], pa.binary())], names=["node", "keys"])

    return source.mapInArrow(giving_back(run), "node bigint, keys binary")


def unpack(keys: bytes) -> np.ndarray:
    """The sorted shingles of sets_of()."""
    out = np.zeros((len(keys) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def intersection(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted arrays share."""
    if not len(x) or not len(y):
        return 0
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def linking(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b: nodes) whose sets link; sets: node, keys."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b").join(sets.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a").select("a", "b", "ka", "kb")

    def run(batches):
        last, x = None, None
        for batch in batches:
            link = np.zeros(batch.num_rows, bool)
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last:  # one center's pairs mostly stand together
                    last, x = a, unpack(batch.column(2)[i].as_py())
                y = unpack(batch.column(3)[i].as_py())
                link[i] = enough(intersection(x, y), len(x), len(y), percent)
            kept = pa.array(link)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return both.mapInArrow(giving_back(run), "a bigint, b bigint").distinct()


def differing(bits: dict[int, np.ndarray], place: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the bitmaps of rows x and y, on the narrower of the two widths. bits: width -> matrix of its rows."""
    out = np.zeros(len(x), np.int64)
    kinds = width[x] * (1 << 32) + width[y]
    for kind in np.unique(kinds):
        some = np.flatnonzero(kinds == kind)
        least = int(min(kind >> 32, kind & 0xFFFFFFFF))
        step = max(1, (1 << 19) // least)
        for k in range(0, len(some), step):
            part = some[k : k + step]
            left, right = (fold(bits[int(w)][place[rows[part]]], least) for w, rows in ((kind >> 32, x), (kind & 0xFFFFFFFF, y)))
            out[part] = np.bitwise_count(left ^ right).sum(axis=1)
    return out


def forests(x: np.ndarray, y: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, left): edges, named by their place (earlier ones are better), of `most` edge-disjoint spanning forests of n
    components, and those in none. x, y: the components of each edge.

    In each step every component takes its best edge to another one, and what they join is one component in the next.
    """
    rest, chosen = np.arange(len(x)), []
    for _ in range(most):
        label, live, mine = np.arange(n), rest, []
        while True:
            cx, cy = label[x[live]], label[y[live]]
            apart = cx != cy
            live, cx, cy = live[apart], cx[apart], cy[apart]
            if not len(live):
                break
            best = np.full(n, len(x))
            np.minimum.at(best, cx, live)
            np.minimum.at(best, cy, live)
            pick = np.unique(best[best < len(x)])
            mine.append(pick)
            names, roots = forest(label[x[pick]], label[y[pick]])
            new = np.arange(n)
            new[names] = roots
            label = new[label]
        chosen += mine
        rest = np.setdiff1d(rest, np.concatenate(mine), assume_unique=True)
        if not len(rest):
            break
    return np.concatenate(chosen), rest


def tile_links(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """a, b: of each tile, pairs of nodes of different components whose sizes and bitmaps allow a link: `most` spanning forests of
    its components, by the greatest bounds. token: the tiles in which there are more (a and b are null then).

    rows: token, i, j, own (the row's block), n, node, root, bitmap; all rows of a token, i and j in one partition, sorted by
    these and n. They hold two blocks of bounded size. Pairs are formed for all tiles of a batch together, by their distance
    in the order, as long as the later set is small enough to link.
    """

    def compare(part: pa.Table):
        token, i, j, own, n, node, root = (np.array(part.column(c)) for c in ("token", "i", "j", "own", "n", "node", "root"))
        tile = np.cumsum(np.concatenate([[0], ((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])).astype(np.int64)]))
        live, left, right, d = np.arange(len(n) - 1), [], [], 1
        while len(live):
            live = live[live + d < len(n)]
            later = live + d
            live = live[(tile[live] == tile[later]) & (n[live] * 100 >= percent * n[later])]  # n ascends: what fails now fails further on
            later = live + d
            meet = (root[live] != root[later]) & ((i[live] == j[live]) | (own[live] != own[later]))
            left.append(live[meet])
            right.append(later[meet])
            d += 1
        x, y = np.concatenate(left), np.concatenate(right)
        if not len(x):
            return
        raw = part.column("bitmap").to_pylist()
        width = np.array([len(r) // 8 for r in raw])
        used = np.zeros(len(n), bool)
        used[x] = used[y] = True
        place, bits = np.zeros(len(n), np.int64), {}
        for w in np.unique(width[used]):
            mine = np.flatnonzero(used & (width == w))
            place[mine] = np.arange(len(mine))
            bits[int(w)] = np.frombuffer(b"".join(raw[k] for k in mine), np.uint64).reshape(-1, w)
        bound = (n[x] + n[y] - differing(bits, place, width, x, y)) // 2
        fits = enough(bound, n[x], n[y], percent)
        x, y, bound = x[fits], y[fits], bound[fits]
        if not len(x):
            return
        order = np.lexsort((node[y], node[x], -bound / (n[x] + n[y] - bound)))
        x, y = x[order], y[order]
        pairs = np.stack([np.concatenate([tile[x], tile[y]]), np.concatenate([root[x], root[y]])])
        names, label = np.unique(pairs, axis=1, return_inverse=True)
        label = label.reshape(-1)
        chosen, rest = forests(label[: len(x)], label[len(x) :], names.shape[1], most)
        more = np.unique(token[x[rest]])
        x, y = x[chosen], y[chosen]
        a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        for k in range(0, len(a), 50_000):
            size = len(a[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000]), pa.nulls(size, pa.int64())], names=["a", "b", "token"])
        if len(more):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int64()), pa.array(more)], names=["a", "b", "token"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            last = [table.column(c)[-1].as_py() for c in ("token", "i", "j")]
            same = np.logical_and.reduce([np.array(table.column(c)) == v for c, v in zip(("token", "i", "j"), last)])
            cut = len(same) - int(same.sum())  # the last tile may go on
            if cut > 1:
                yield from compare(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and held.num_rows > 1:
            yield from compare(held.combine_chunks())

    return rows.select("token", "i", "j", "own", "n", "node", "root", "bitmap").mapInArrow(giving_back(run), "a bigint, b bigint, token bigint")


def dealt_blocks(here: DataFrame, block: int) -> DataFrame:
    """here (token, node, n, root) without the tiles of one root, dealt into block pairs (own, i, j). In a tile of more than `block`
    nodes those of its most frequent root are blocks of their own, which meet all other blocks but not each other."""
    each = here.groupBy("token", "root").agg(F.count("*").alias("c"))
    tiles = each.groupBy("token").agg(F.count("*").alias("roots"), F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top")).where("roots > 1")
    rows = here.join(tiles, "token").withColumn("main", (F.col("m") > block) & (F.col("root") == F.col("top.root")))
    others = F.when(F.col("m") > block, F.ceil((F.col("m") - F.col("top.c")) / block)).otherwise(1).cast("int")
    mains = F.when(F.col("m") > block, F.ceil(F.col("top.c") / block)).otherwise(0).cast("int")
    rows = rows.withColumns({"others": others, "mains": mains, "h": F.xxhash64("node")})
    own = F.when(F.col("main"), F.col("others") + F.pmod("h", "mains")).otherwise(F.pmod("h", "others")).cast("int")
    meets = F.when(F.col("main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    rows = rows.withColumns({"own": own, "other": F.explode(meets)})
    return rows.select("token", "node", "n", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def sketch_size(rows: int) -> int:
    """Buckets of the order's sketch: a power of two, one to eight documents, from 2**17 to 2**22 (a byte each is broadcast, and
    twelve each reach the driver: 50 MB at most)."""
    return 1 << min(22, max(17, (rows // 8).bit_length()))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    buckets: numbers of the sketch (a power of two; the default follows the number of rows). block: most rows of a tile's block.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(shingle_ranks(docs, words, buckets or sketch_size(docs.count()), text))
    signed = persist(signatures(docs, words, percent, ranks, doc_id, text), "signatures")
    filled = signed.where("n > 0")
    nodes = persist(filled.groupBy("node").agg(F.min("doc_id").alias("min_doc"), F.first("n").alias("n"), F.first("bitmap", ignorenulls=True).alias("bitmap")), "nodes")

    # A shingle whose bucket counts more than SPLIT is dealt by its nodes as well; part -1: all rows of the shingle are in one part.
    rows = filled.select("node", "n", F.explode("prefix").alias("token"))
    rank = F.shiftrightunsigned("token", 56)
    parts = F.when(rank > 8 * (SPLIT.bit_length() - 1), F.pow(F.lit(2.0), rank / 8 - (SPLIT.bit_length() - 1)).cast("int") + 1)
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), parts), F.lit(-1)).cast("int"))
    found = persist(shared_tokens(rows.repartition("token", "part").sortWithinPartitions("token", "part", "node")), "tokens")
    ends = found.where("node is null").groupBy("token").agg(
        F.sum(F.col("mark").cast("decimal(38,0)")).alias("mark"), F.sum("m").alias("m"), F.min(F.struct("low", "low_n")).alias("x"), F.max(F.struct("high", "high_n")).alias("y")
    ).where("m > 1")
    ends = ends.groupBy("m", F.expr("pmod(mark, 18446744073709551616)").alias("mark")).agg(F.min("token").alias("token"), F.first("x").alias("x"), F.first("y").alias("y"))
    ends = persist(ends.select("token", "m", "x", "y"), "ends")
    tiles = persist(found.where("node is not null").select("token", "node", "n").join(ends.select("token"), "token"), "tiles")
    free(found)

    links = tried = known = None

    def prove(pairs: DataFrame) -> None:
        """Verifies pairs that no pass has tried, and contracts what links."""
        nonlocal links, tried, known
        new = persist(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        wanted = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "min_doc"), "node")
        sets = persist(sets_of(wanted, docs, words, doc_id, text), "sets")
        proven = persist(linking(new, sets, percent), "links")
        free(sets)
        links, tried = (proven, new) if links is None else (links.unionByName(proven), tried.unionByName(new))
        before, known = known, persist(components(links), "known")
        if before is not None:
            free(before)

    # Stars: each tile's nodes against its least and its greatest node.
    spokes = tiles.join(ends, "token").select("node", "n", F.explode(F.array(F.struct(F.col("x.low").alias("c"), F.col("x.low_n").alias("cn")), F.struct(F.col("y.high").alias("c"), F.col("y.high_n").alias("cn")))).alias("e")).select("node", "n", "e.c", "e.cn")
    alike = 100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")
    stars = spokes.where((F.col("node") != F.col("c")) & alike).groupBy(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).agg(F.count("*")).select("a", "b")
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("bits_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bits_b"))
    prove(bounded(stars.join(left, "a").join(right, "b"), percent))
    # A center's pairs are decided: what is left are the other nodes of tiles of four nodes or more.
    inner = persist(tiles.join(ends.where("m > 3"), "token").where("node <> x.low and node <> y.high").select("token", "node", "n"), "inner")
    free(tiles, ends)

    most, again = 1, None
    while True:
        here = inner if again is None else inner.join(again, "token", "left_semi")
        here = persist(here.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        dealt = dealt_blocks(here, block).join(nodes.select("node", "bitmap"), "node")
        sent = persist(tile_links(dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "node"), percent, most), "sent")
        prove(sent.where("token is null").select("a", "b").distinct())
        free(here)
        before, again = again, persist(sent.where("token is not null").select("token").distinct(), "again")
        free(sent, *([before] if before is not None else []))
        if again.isEmpty():
            break
        most *= 8

    named = persist(nodes.select("node", "min_doc").join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    free(inner, nodes)
    least = named.groupBy("root").agg(F.min("min_doc").alias("component_id"))
    result = named.join(least, "root").select("node", "component_id")
    linked = signed.where("n > 0").select("doc_id", "n", "node").join(result, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(signed.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id")))
