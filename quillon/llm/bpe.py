"""Byte-level BPE: encoding with a vectorised pre-tokeniser, and decoding.

Pre-tokenisation uses no regular expression. Every code point gets a class from a table, classes and their neighbours
give a symbol, and each symbol is a function from the state before a character to the state after it. Composition of
such functions is associative; the closed set of all compositions is small, so a prefix scan over it is a table lookup
per character. Where a symbol opens a piece in its state, a slice begins. Slices feed a cached pair merger.

Nulls count as empty texts, empty texts have no ids, texts of any length are handled whole (a piece without a boundary
is merged with a heap in O(n log n)), repeated rows give repeated results, an empty table gives an empty table, and
columns of the input other than the text are kept as they are unless their names clash with the added ones (those are
replaced).
"""

from __future__ import annotations

import base64
import heapq
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import binary_parts, chunks, give_back

# States and symbols.
FREE, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, ONE_MORE, TWO_MORE = range(8)
NONE = 1 << 40
LETTER, NUMBER, OTHER, QUOTE_1, QUOTE_2, LAST_BLANK, LAST_SPACE, SPACE = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins at this character)."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FREE, False
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[symbol]
        return run, state not in (run, PREFIX)
    if symbol in (QUOTE_1, QUOTE_2):
        if state in (OTHERS, PREFIX):  # the quote belongs to a run of punctuation
            return OTHERS, False
        return (ONE_MORE if symbol == QUOTE_1 else TWO_MORE), True
    if symbol == LAST_BLANK:
        return PREFIX, True
    if symbol == LAST_SPACE:
        return FREE, True
    return SPACES, state != SPACES


def kinds_of_points() -> np.ndarray:
    """The kind of every code point by the tables that tiktoken itself has: an encoding of single bytes whose pattern is a class gives
    ids for the text's members of the class and none for the rest. Once a process."""
    import tiktoken

    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
        kinds[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return kinds


class Scanner:
    """Finds the pieces of texts; one instance per process."""

    def __init__(self):
        self.kinds = kinds_of_points()
        # Symbols 8..15 are 0..7 at the first character of a text: they forget the state before.
        functions = [tuple(_step(s, x)[0] for s in range(8)) for x in range(8)] + [(_step(FREE, x)[0],) * 8 for x in range(8)]
        self.opens = np.array([[_step(s, x)[1] for s in range(8)] for x in range(8)] + [[True] * 8] * 8, bool)
        known: dict[tuple, int] = {tuple(range(8)): 0}
        for f in functions:
            known.setdefault(f, len(known))
        queue, generators = list(known), list(dict.fromkeys(functions))
        while queue:
            f = queue.pop()
            for g in generators:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
        self.apply = np.array(list(known), np.uint8)
        self.of_symbol = np.array([known[f] for f in functions], np.uint16)
        self.then = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint16)

    def _scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive prefix compositions of the functions f, block by block, then over the blocks."""
        n, width = len(f), 64
        if n <= width:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.then[out[i - 1], f[i]]
            return out
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.uint16)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        for j in range(1, width):
            grid[j] = self.then[grid[j - 1], grid[j]]
        carried = self._scan(grid[-1])
        grid[:, 1:] = self.then[carried[None, :-1], grid[:, 1:]]
        return grid.T.reshape(-1)[:n]

    def starts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pieces begin in the code points of texts that begin at `firsts` (no empty texts)."""
        n = len(points)
        kinds = self.kinds[points]
        last = np.zeros(n + 2, bool)
        last[firsts[1:] - 1] = True
        last[n - 1 :] = True
        last = last[:-1]
        symbols = kinds.copy()
        space = kinds == SPACE
        before_text = np.zeros(n, bool)
        before_text[:-1] = ~space[1:]
        edge = space & before_text & ~last[:n]
        symbols[edge] = LAST_SPACE
        symbols[edge & (points == 0x20)] = LAST_BLANK
        quotes = np.flatnonzero((points == 0x27) & ~last[:n])
        if len(quotes):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            more = ~last[quotes + 1]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = more & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            symbols[quotes[single]] = QUOTE_1
            symbols[quotes[double]] = QUOTE_2
        symbols[firsts] += 8
        states = self.apply[self._scan(self.of_symbol[symbols]), FREE]
        before = np.zeros(n, np.uint8)
        before[1:] = states[:-1]
        return np.flatnonzero(self.opens[symbols, before])


class Merger(dict):
    """Piece -> its ids as little-endian 32-bit integers. learn() merges the new pieces of a batch together; the cache is
    emptied when it holds `most` pieces, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000):
        super().__init__()
        self.ranks, self.most = ranks, most
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for raw, rank in ranks.items():
            for cut in range(1, len(raw)):
                left, right = ranks.get(raw[:cut]), ranks.get(raw[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.joined = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's bytes, NONE where they are no token or a side is missing (-1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.joined[at], NONE)

    def merge_many(self, raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces of at most `width` bytes: in each round every piece joins its pair of least rank."""
        n = len(raws)
        size = np.fromiter(map(len, raws), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[np.arange(width + 1) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows, columns = np.arange(n), np.arange(width + 1)
        done = np.full((n, width + 1), -1, np.int64)
        while len(rows):
            at = ranks.argmin(axis=1)
            here = np.arange(len(rows))
            best = ranks[here, at]
            go = best < NONE
            if not go.all():
                done[rows[~go]] = ids[~go]
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                here = here[: len(rows)]
            if not len(rows):
                break
            moved = columns[None, :] + (columns[None, :] > at[:, None])
            ids = np.take_along_axis(ids, np.minimum(moved, width), axis=1)
            ids[:, -1] = -1
            ids[here, at] = best
            shifted = columns[None, :-1] + (columns[None, :-1] >= at[:, None])
            ranks = np.where(shifted < width, np.take_along_axis(ranks, np.minimum(shifted, width - 1), axis=1), NONE)
            ranks[here, np.minimum(at, width - 1)] = self.pair_ranks(best, ids[here, np.minimum(at + 1, width)])
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self.pair_ranks(ids[inner, at[inner] - 1], best[inner])
        return done, (done >= 0).sum(axis=1)

    def learn(self, pieces: set[str]) -> None:
        """Caches the pieces of at most 64 bytes that are not cached."""
        new = [x for x in pieces if x not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(pieces)
        raws = [x.encode() for x in new]
        for low, high in ((0, 8), (8, 16), (16, 64)):
            group = [i for i, raw in enumerate(raws) if low < len(raw) <= high]
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                ids, counts = self.merge_many([raws[i] for i in part], high)
                packed, ends = ids[ids >= 0].astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, a, b in zip(part, [0, *ends], ends):
                    self[new[i]] = packed[a:b]

    def __missing__(self, piece: str) -> bytes:
        """A piece of more than 64 bytes; it is not kept."""
        raw = piece.encode()
        one = self.ranks.get(raw)
        return np.array([one] if one is not None else self.merge(raw), "<u4").tobytes()

    def merge(self, raw: bytes) -> list[int]:
        """Joins the adjacent pair of least rank, leftmost first, until no pair has a rank."""
        n, ranks = len(raw), self.ranks
        after, ahead, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has grown or gone since
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                ahead[after[i]] = i
                if (r := ranks.get(raw[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (p := ahead[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[raw[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Ranks with their scanner, merger and decoding table."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.scanner, self.merger = Scanner(), Merger(self.ranks)
        size = max(self.ranks.values()) + 1
        self.length, self.known = np.zeros(size, np.int64), np.zeros(size, bool)
        for raw, i in self.ranks.items():
            self.length[i], self.known[i] = len(raw), True
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed."""
        out = [b""] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        whole = "".join(texts[i] for i in full)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(texts[i]) for i in full])
        firsts = np.concatenate([[0], ends[:-1]])
        at = self.scanner.starts(points, firsts)
        cut = np.searchsorted(at, firsts).tolist() + [len(at)]
        bounds = at.tolist() + [len(whole)]
        pieces = [whole[s:e] for s, e in zip(bounds, bounds[1:])]
        self.merger.learn(set(pieces))
        packed = list(map(self.merger.__getitem__, pieces))
        for k, i in enumerate(full):
            out[i] = b"".join(packed[cut[k] : cut[k + 1]])
        return out

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes end in the text's bytes."""
        return np.cumsum(self.length[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens: one gather from the vocabulary's bytes."""
        if not len(ids):
            return b""
        if ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id that the vocabulary lacks")
        size = self.length[ids]
        end = np.cumsum(size)
        return self.blob[np.repeat(self.offset[ids] - (end - size), size) + np.arange(end[-1])].tobytes()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, vocabulary: str, text: str = "text", decode_back: bool = False) -> DataFrame:
    """Adds ids (packed little-endian unsigned 32-bit integers) and token_ends (packed likewise: where each token ends in the
    text's UTF-8 bytes, so that a span of tokens decodes to a known span of bytes); with decode_back also decoded, the bytes
    that the ids alone decode to. vocabulary: path of a rank file that every executor can open (bounded: it is the tokenizer)."""
    added = [("ids", "binary"), ("token_ends", "binary")] + [("decoded", "binary")] * decode_back
    names = {k for k, _ in added}
    keep = [c for c in df.columns if c not in names and c != text]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(k, T.BinaryType()) for k, _ in added])

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, offsets = binary_parts(column)
            for a, b in chunks(offsets):
                part = batch.slice(a, b - a)
                texts = [x.decode("utf-8", "replace") if x else "" for x in part.column(part.num_columns - 1).to_pylist()]
                packed = own.encode(texts)
                arrays = [np.frombuffer(x, "<u4") for x in packed]
                out = [packed, [own.ends(x).astype("<u4").tobytes() for x in arrays]]
                if decode_back:
                    out.append([own.decode(x) for x in arrays])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(x, pa.binary()) for x in out]], names=[*keep, *[k for k, _ in added]])
        own.merger.clear()  # a worker may serve other stages next
        give_back()

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds decoded (binary), the bytes of packed ids; null ids decode to no bytes. Raises on an id without a token."""
    keep = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])
    source = df.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            raw = batch.column(keep.index(ids)).to_pylist()
            out = [own.decode(np.frombuffer(x or b"", "<u4")) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return source.mapInArrow(run, schema)
