"""Memories that are asked while they fill: entries and questions of a stream in one order, live or replayed.

A memory holds traces (an entry's words, its uses and its last use), the traces of each word, and edges between traces. A question is answered by
the traces that share its words, each word weighing ln(1 + entries / entries with it), times the trace's importance; a trace linked
to one of them comes along. With feedback an answer changes what the next one reads: its traces are used, and edges between them grow.

The same steps run over a sorted batch (replayed) and in a stream (live), where each table of a memory is a map state, of which a trigger
reads and writes only the keys it touches, rows wait in a list state until the watermark has passed, and an event timer wakes them. So
a restart from a checkpoint goes on where it was, and replaying the log gives the same rows.

What an answer depends on is all that went before in its stream: a stream is worked off in order, by one task at a time; streams are dealt out.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Answers: the best traces, and the least edge by which another comes along; edges of new traces by the share of common words.
BEST, LEAST_EDGE, LEAST_OVERLAP, STRONGER = 2, 0.15, 0.2, 0.25
DAY = 86_400_000_000
ROWS = "stream bigint, id bigint, at bigint, asks boolean, words array<string>"
ANSWERS = "stream bigint, id bigint, entries bigint, answer string"


class Table:
    """A table of a memory: a cache over a map state (key -> JSON), or a plain dictionary. written: the keys that the state lacks."""

    def __init__(self, state=None):
        self.state, self.cache, self.written = state, {}, set()

    def get(self, key: str, default=None):
        if key not in self.cache:
            found = self.state.getValue((key,)) if self.state is not None and self.state.containsKey((key,)) else None
            self.cache[key] = json.loads(found[0]) if found else None
        value = self.cache[key]
        return default if value is None else value

    def put(self, key: str, value) -> None:
        self.cache[key] = value
        self.written.add(key)

    def flush(self) -> None:
        for key in sorted(self.written):
            self.state.updateValue((key,), (json.dumps(self.cache[key]),))
        self.written.clear()


class Memory:
    """traces: id -> [words, uses, last use]; places: word -> ids; edges: id -> {id: weight}; total: how many entries."""

    def __init__(self, traces: Table, places: Table, edges: Table, feedback: bool):
        self.traces, self.places, self.edges, self.feedback = traces, places, edges, feedback

    def total(self) -> int:
        return self.traces.get("", 0)

    def enter(self, key: int, at: int, words: list[str]) -> None:
        words = sorted(set(words))
        if self.feedback:
            for other in sorted({i for w in words for i in self.places.get(w, [])}):
                theirs = self.traces.get(str(other))[0]
                both = len(set(words) & set(theirs))
                if both >= LEAST_OVERLAP * (len(words) + len(theirs) - both):
                    self.link(key, other, both / (len(words) + len(theirs) - both))
        for w in words:
            self.places.put(w, [*self.places.get(w, []), key])
        self.traces.put(str(key), [words, 0, at])
        self.traces.put("", self.total() + 1)

    def link(self, a: int, b: int, weight: float) -> None:
        for x, y in ((a, b), (b, a)):
            near = dict(self.edges.get(str(x), {}))
            near[str(y)] = round(min(1.0, weight), 6)
            self.edges.put(str(x), near)

    def importance(self, key: int, at: int) -> float:
        _, uses, last = self.traces.get(str(key))
        return min(3.0, max(0.25, 1 + 0.5 * uses - 0.5 * (at - last) / (30 * DAY)))

    def ask(self, at: int, words: list[str]) -> list[int]:
        scores: dict[int, float] = {}
        for w in sorted(set(words)):
            having = self.places.get(w, [])
            for key in having:
                scores[key] = scores.get(key, 0.0) + math.log(1 + self.total() / len(having))
        ranked = sorted(scores, key=lambda k: (-round(scores[k] * (self.importance(k, at) if self.feedback else 1.0), 6), k))
        shown = ranked[:BEST]
        if self.feedback:
            near = [(w, int(j)) for i in shown for j, w in self.edges.get(str(i), {}).items() if int(j) not in shown and w >= LEAST_EDGE]
            if near:
                shown.append(min(near, key=lambda x: (-x[0], x[1]))[1])
            for i in shown:
                words_, uses, _ = self.traces.get(str(i))
                self.traces.put(str(i), [words_, uses + 1, at])
            for i in shown:
                for j in shown:
                    if i < j:
                        self.link(i, j, self.edges.get(str(i), {}).get(str(j), 0.0) + STRONGER)
        return shown

    def step(self, rows: Iterable[tuple[int, int, bool, list[str]]], stream: int) -> list[tuple[int, int, int, str]]:
        """The answers of rows (id, at, asks, words) in order; a question sees the entries strictly before it."""
        out = []
        for key, at, asks, words in rows:
            if asks:
                out.append((stream, key, self.total(), ",".join(map(str, self.ask(at, words)))))
            else:
                self.enter(key, at, words)
        return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["stream", "id", "entries", "answer"]).astype({"stream": "int64", "id": "int64", "entries": "int64", "answer": "object"})


def replayed(rows: DataFrame, feedback: bool) -> DataFrame:
    """stream, id, entries and answer (ids, comma-joined) of every question. rows: stream, id, at (microseconds), asks and words.

    Rows of a stream are taken by time, questions before entries of the same time, then by id. Null words count as none; rows without a stream, an id or
    a time are left out, as they have no place in the order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, memory = None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.stream != stream:
                    stream, memory = r.stream, Memory(Table(), Table(), Table(), feedback)
                out += memory.step([(int(r.id), int(r.at), bool(r.asks), list(r.words))], int(stream))
            yield _frame(out)

    known = rows.where("stream is not null and id is not null and at is not null").select("stream", "id", "at", F.coalesce("asks", F.lit(False)).alias("asks"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    return known.repartition("stream").sortWithinPartitions("stream", "at", F.col("asks").desc(), "id").mapInPandas(run, ANSWERS)


def live(rows: DataFrame, feedback: bool, delay: str = "0 seconds") -> DataFrame:
    """The answers of a streaming table of the same rows with a timestamp `ts`: each when the watermark has passed its question.

    The state store must hold several variables (RocksDB's provider). The states are traces, places, edges (maps) and waiting (a list).
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Live(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.tables = [handle.getMapState(name, "key string", "value string") for name in ("traces", "places", "edges")]
            self.waiting = handle.getListState("waiting", "id bigint, at bigint, asks boolean, words array<string>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            came = []
            for pdf in rows:
                came += [(int(r.id), int(r.at), bool(r.asks), list(r.words)) for r in pdf.itertuples(index=False)]
            self.waiting.appendList(came)
            for at in {r[1] // 1000 + 1 for r in came}:  # timers have milliseconds: all of the same one are in
                self.handle.registerTimer(at)
            yield _frame([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
            waiting = [(int(r[0]), int(r[1]), bool(r[2]), list(r[3])) for r in (self.waiting.get() if self.waiting.exists() else [])]
            due, rest = [r for r in waiting if r[1] < upto], [r for r in waiting if r[1] >= upto]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            tables = [Table(s) for s in self.tables]
            out = Memory(*tables, feedback).step(sorted(due, key=lambda r: (r[1], not r[2], r[0])), int(key[0]))
            for t in tables:
                t.flush()
            yield _frame(out)

        def close(self) -> None:
            pass

    known = rows.where("stream is not null and id is not null and ts is not null").select("stream", "id", F.unix_micros("ts").alias("at"), F.coalesce("asks", F.lit(False)).alias("asks"), F.coalesce("words", F.array().cast("array<string>")).alias("words"), "ts")
    return known.withWatermark("ts", delay).groupBy("stream").transformWithStateInPandas(Live(), ANSWERS, "append", "EventTime")
