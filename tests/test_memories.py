"""Memories asked while they fill: replayed and live, with a restart between triggers, against a loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.streaming import memories

HOUR = 3_600_000_000


def made(seed, n=60, streams=3):
    rng = random.Random(seed)
    rows = []
    for s in range(streams):
        for i in range(n):
            rows.append((s, s * 1000 + i, (rng.randrange(0, 40 * n) * HOUR), rng.random() < 0.3, rng.sample("abcdefgh", rng.randint(0, 4))))
    return rows


def loop(rows, feedback):
    """The same rules, told from all that went before each time."""
    out = {}
    for stream in {r[0] for r in rows}:
        entries, uses, last, edges = {}, {}, {}, {}
        for _, key, at, asks, words in sorted((r for r in rows if r[0] == stream), key=lambda r: (r[2], not r[3], r[1])):
            words = set(words or [])
            if not asks:
                for other, theirs in entries.items():
                    if words & theirs and feedback and len(words & theirs) >= 0.2 * len(words | theirs):
                        edges[frozenset((key, other))] = round(len(words & theirs) / len(words | theirs), 6)
                entries[key], uses[key], last[key] = words, 0, at
                continue
            df = {w: sum(w in e for e in entries.values()) for w in words}
            score = {k: sum(math.log(1 + len(entries) / df[w]) for w in sorted(words & e)) for k, e in entries.items() if words & e}
            if feedback:
                score = {k: s * min(3.0, max(0.25, 1 + 0.5 * uses[k] - 0.5 * (at - last[k]) / (30 * 24 * HOUR))) for k, s in score.items()}
            shown = sorted(score, key=lambda k: (-round(score[k], 6), k))[:2]
            if feedback:
                near = sorted((-w, next(iter(e - {i}))) for i in shown for e, w in edges.items() if i in e and w >= 0.15 and not e <= set(shown))
                shown += [near[0][1]] if near else []
                for i in shown:
                    uses[i], last[i] = uses[i] + 1, at
                for i in shown:
                    for j in shown:
                        if i < j:
                            edges[frozenset((i, j))] = round(min(1.0, edges.get(frozenset((i, j)), 0.0) + 0.25), 6)
            out[key] = (len(entries), ",".join(map(str, shown)))
    return out


def told(rows):
    return {r["id"]: (r["entries"], r["answer"]) for r in rows}


@pytest.mark.parametrize("feedback", [False, True])
def test_replay_is_the_loop(spark, feedback):
    rows = made(1)
    got = told(memories.replayed(spark.createDataFrame(rows, memories.ROWS), feedback).collect())
    assert got == loop(rows, feedback) and len({a for _, a in got.values()}) > 10
    odd = [(1, 1, 5, False, None), (1, 2, 6, True, ["a"]), (None, 3, 7, True, ["a"]), (1, 4, 8, None, ["a"]), (1, 5, 9, True, ["a", "a"])]
    assert told(memories.replayed(spark.createDataFrame(odd, memories.ROWS), feedback).collect()) == {2: (1, ""), 5: (2, "4")}
    assert memories.replayed(spark.createDataFrame([], memories.ROWS), feedback).count() == 0


def test_live_with_a_restart_is_the_replay(spark, tmp_path):
    rows = made(2, n=25, streams=2)
    rows.sort(key=lambda r: r[2])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "stream bigint, id bigint, at bigint, asks boolean, words array<string>, ts timestamp"
    put = lambda part, name: spark.createDataFrame(part, memories.ROWS).withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # noqa: E731, ARG005

    def trigger():
        query = (
            memories.live(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), True).writeStream.format("parquet").option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    third = len(rows) // 3
    put(rows[:third], "a")
    trigger()
    early = spark.read.schema(memories.ANSWERS).parquet(f"{tmp_path}/out").count()
    put(rows[third : 2 * third][::-1], "b")  # within a trigger the order of arrival does not matter
    trigger()  # started anew from the checkpoint
    put([*rows[2 * third :], (99, 1, rows[-1][2] + 1000 * HOUR, False, [])], "c")
    trigger()
    got = told(spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == told(memories.replayed(spark.createDataFrame(rows, memories.ROWS), True).collect()) and 0 < early < len(got)
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "traces").load()
    entries = [r for r in rows if not r[3]]
    assert kept.count() == len(entries) + len({r[0] for r in entries})  # a trace an entry, and a count a stream
