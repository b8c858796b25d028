"""Structured Streaming: event-time windows, ordered ingest and the online retention gate."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def tumbling(events: DataFrame, ts: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """window_start, keys, n and total of `value`; on a stream, rows later than `late` are dropped by the watermark."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, late: str | None = None) -> DataFrame:
    """Runs of events of a key without a pause of `gap`: keys, session_start, session_end (the last event) and n."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    grouped = rows.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.max(ts).alias("session_end"))
    return grouped.select(*keys, F.col("session_window.start").alias("session_start"), "session_end", "n")


def late_rows(records: DataFrame, stream: str, order: str, ts: str) -> DataFrame:
    """Rows that come before an earlier one of their stream in time: an ordered ingest refuses the stream that has any."""
    reach = F.max(ts).over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("__reach", reach).where(F.col(ts) < F.col("__reach")).drop("__reach")


class Gate:
    """The store of one stream: holds floor(rate * words seen) words, gives up the row of least weight (oldest first among equals).

    Weights may change while a row is held (a re-mention). All held rows of a topic gain the same, so a topic has one sum of gains and a row what it
    weighs beyond that: its place among the rows of its topic never changes, and a held row has one entry. Gains are summed exactly.
    """

    def __init__(self, rate: float):
        self.rate, self.seen, self.held, self.size, self.gains = rate, 0, 0, {}, {}
        self.rows, self.firsts = {}, []  # by topic, a heap of (weight beyond the gains, row); a heap of (weight, row, topic) with each topic's first, and outdated ones

    def _first(self, topic: int | None) -> None:
        """Notes the least row of a topic; outdated notes are dropped before they outnumber the topics."""
        own, row = self.rows[topic][0]
        heapq.heappush(self.firsts, (own + self.gains[topic], row, topic))
        if len(self.firsts) > 2 * len(self.rows) + 16:
            self.firsts = [(h[0][0] + self.gains[t], h[0][1], t) for t, h in self.rows.items()]
            heapq.heapify(self.firsts)

    def _add(self, seq: int, words: int, weight: float, topic: int | None) -> None:
        self.size[seq] = words
        heapq.heappush(self.rows.setdefault(topic, []), (weight - self.gains.setdefault(topic, 0), seq))
        self._first(topic)

    def put(self, seq: int, words: int, weight: float, topic: int | None = None) -> list[int]:
        """Takes a row in; returns the rows given up. With a topic, held rows of the same topic gain the new row's weight."""
        self.seen += words
        self.held += words
        if topic is not None:
            weight = int(weight) if weight == int(weight) else Fraction(weight)
            self.gains[topic] = self.gains.get(topic, 0) + weight
        self._add(seq, words, weight, topic)
        gone = []
        while self.held > int(self.rate * self.seen + 1e-9):
            w, out, t = heapq.heappop(self.firsts)
            rows = self.rows.get(t)
            if not rows or rows[0][1] != out or rows[0][0] + self.gains[t] != w:
                continue
            heapq.heappop(rows)
            if rows:
                self._first(t)
            else:
                del self.rows[t], self.gains[t]
            self.held -= self.size.pop(out)
            gone.append(out)
        return gone

    def dump(self) -> tuple:
        weight = {seq: float(own + self.gains[t]) for t, rows in self.rows.items() for own, seq in rows}
        held = sorted(self.size)
        return (self.seen, self.held, [weight[s] for s in held], held, [self.size[s] for s in held])

    @classmethod
    def load(cls, rate: float, state: tuple) -> "Gate":
        out = cls(rate)
        out.seen, out.held = state[0], state[1]
        for weight, seq, words in zip(state[2], state[3], state[4]):
            out._add(seq, words, weight, None)
        return out


#: Weights of the retention policies, from a row's age rank, words, value and draw. "mention" adds to what it holds of a topic when the topic
#: comes again (column topic); "oracle" keeps what will be needed (column needed) before all else.
POLICIES = {
    "recent": lambda r: float(r.seq), "first": lambda r: -float(r.seq), "long": lambda r: float(r.words), "short": lambda r: -float(r.words),
    "value": lambda r: float(r.value), "low_value": lambda r: -float(r.value), "random": lambda r: float(r.draw), "dense": lambda r: float(r.value) / max(1, r.words),
    "mention": lambda r: float(r.value), "oracle": lambda r: float(r.needed), "all": None,
}

KEPT = "stream bigint, seq bigint, words bigint"


def retained(rows: DataFrame, policy: str, rate: float) -> DataFrame:
    """stream, seq and words of the rows that the gate still holds after the last row of each stream.

    rows: stream, seq, words, value, draw (and topic or needed). The gate's state depends on order; streams come sorted, batch by batch, and
    a task holds the store of the one stream that it reads: a share `rate` of its words, not the stream.
    """
    if policy == "all":
        return rows.select(F.col("stream").cast("bigint").alias("stream"), F.col("seq").cast("bigint").alias("seq"), F.col("words").cast("bigint").alias("words"))
    weigh = POLICIES[policy]

    def left(stream: int, gate: Gate) -> pd.DataFrame:
        kept = sorted(gate.size.items())
        return pd.DataFrame({"stream": [stream] * len(kept), "seq": [k for k, _ in kept], "words": [v for _, v in kept]}).astype("int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, gate = None, None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.stream != last:
                    if gate is not None:
                        yield left(last, gate)
                    last, gate = int(r.stream), Gate(rate)
                gate.put(int(r.seq), int(r.words), weigh(r), int(r.topic) if policy == "mention" else None)
        if gate is not None:
            yield left(last, gate)

    return rows.repartition("stream").sortWithinPartitions("stream", "seq").mapInPandas(run, KEPT)


def importance(uses: DataFrame, entry: str, at: str, now) -> DataFrame:
    """entry, uses, last_used and importance: 1 + 0.5 for each use less 0.5 for each 30 days since the last, between 0 and 5."""
    each = uses.groupBy(entry).agg(F.count("*").alias("uses"), F.max(at).alias("last_used"))
    age = F.datediff(now, F.col("last_used").cast("date"))
    return each.withColumn("importance", F.round(F.greatest(F.lit(0.0), F.least(F.lit(5.0), 1 + 0.5 * F.col("uses") - 0.5 * age / 30)), 6))


def learned_shells(examples: DataFrame, text: str, value: str) -> DataFrame:
    """prefix and suffix: what stands before and after the value in each example, once; an example without its value teaches nothing."""
    at = f"locate(`{value}`, `{text}`)"
    shells = examples.where(f"{at} > 0 and length(`{value}`) > 0").select(F.expr(f"left(`{text}`, {at} - 1)").alias("prefix"), F.expr(f"substring(`{text}`, {at} + length(`{value}`))").alias("suffix"))
    return shells.where("length(prefix) + length(suffix) > 0").distinct()


def replayed(sources: DataFrame, shells: DataFrame, key: str, text: str) -> DataFrame:
    """key and value: what a learned shell finds in a later text; null where several shells find different values (ambiguous). Texts without a
    shell give no row. Texts meet shells on the first word of both, not each with each."""
    first = lambda c: F.regexp_extract(c, r"^(\S+)\s", 1)
    s = shells.withColumn("__w", first(F.col("prefix")))
    t = sources.select(key, F.col(text).alias("__t")).withColumn("__w", first(F.col("__t")))
    n = F.length("__t") - F.length("prefix") - F.length("suffix")
    met = t.join(s, "__w").where(F.col("__t").startswith(F.col("prefix")) & F.col("__t").endswith(F.col("suffix")) & (n > 0))
    found = met.select(key, F.substring(F.col("__t"), F.length("prefix") + 1, n).alias("v"))
    return found.groupBy(key).agg(F.when(F.countDistinct("v") == 1, F.min("v")).alias("value"))


def mood(rows: DataFrame, group: str, order: str, stimulus: str, keep: float) -> DataFrame:
    """group and mood: the last of an autoregression, mood = keep * mood + stimulus, folded in order over each group's short list."""
    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(stimulus).cast("double").alias("x")))).alias("l"))
    return listed.select(group, F.round(F.aggregate("l", F.lit(0.0), lambda acc, r: acc * keep + r["x"]), 6).alias("mood"))


STATE = "seen bigint, held bigint, weights array<double>, seqs array<bigint>, sizes array<bigint>"


def retention_stream(rows: DataFrame, policy: str, rate: float) -> DataFrame:
    """The gate on a stream: each trigger gives stream, seq and evicted_by of the rows given up; state is the gate of each stream."""
    weigh = POLICIES[policy]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        gate = Gate.load(rate, state.get) if state.exists else Gate(rate)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            out += [(int(key[0]), s, int(r.seq)) for s in gate.put(int(r.seq), int(r.words), weigh(r))]
        state.update(gate.dump())
        yield pd.DataFrame(out, columns=["stream", "seq", "evicted_by"]).astype("int64")

    return rows.groupBy("stream").applyInPandasWithState(run, "stream bigint, seq bigint, evicted_by bigint", STATE, "append", "NoTimeout")


def prefix_counts(records: DataFrame, queries: DataFrame, stream: str, ts: str, asked: str, key: str) -> DataFrame:
    """stream, query key and records strictly before each query: records and queries put in one order per stream."""
    a = records.select(stream, F.col(ts).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(queries.schema[key].dataType).alias(key), F.lit(1).alias("__one"))
    b = queries.select(stream, F.col(asked).alias("__t"), F.lit(0).alias("__side"), key, F.lit(0).alias("__one"))
    w = Window.partitionBy(stream).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("records", F.sum("__one").over(w)).where("__side = 0").select(stream, key, "records")
