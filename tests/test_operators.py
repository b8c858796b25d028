"""Operators that SQL does not express, and edges, against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import clock, text as tx
from quillon.operators import evidence, facts, inference, integrity, packing, policies
from quillon.sources import logs
from quillon.streaming.streams import Gate, retained, retention_stream


def test_skip_fill_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(g, r, 100 * g + r, rng.randint(1, 40)) for g in range(5) for r in range(12)]
    got = {x["g"]: (x["taken"], x["spent"]) for x in packing.skip_fill(spark.createDataFrame(rows, "g int, rank int, id int, cost int"), "g", "rank", "id", "cost", 60).collect()}
    for g in range(5):
        spent, taken = 0, []
        for _, _, i, c in [x for x in rows if x[0] == g]:
            if spent + c <= 60:
                spent, taken = spent + c, [*taken, i]
        assert got[g] == (taken, spent)


@pytest.mark.parametrize("budget", [0, 1, 7, 50, 333, 10_000])
def test_fair_share_against_water_filling(spark, budget):
    sizes = [30, 5, 5, 90, 1, 0, 44]
    got = {r["o"]: r["share"] for r in packing.fair_share(spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "g int, o int, s int"), "g", "o", "s", budget).collect()}
    share = [0] * len(sizes)
    left = budget
    while left and any(a < b for a, b in zip(share, sizes)):  # one unit each, in order
        for i, s in enumerate(sizes):
            if left and share[i] < s:
                share[i], left = share[i] + 1, left - 1
    assert [got[i] for i in range(len(sizes))] == share


@pytest.mark.parametrize("policy", ["recent", "long", "random"])
def test_gate_replays_alike_in_batch_and_stream(spark, tmp_path, policy):
    rng = random.Random(2)
    rows = [(s, i, rng.randint(1, 30), rng.randint(0, 9), rng.randint(0, 1 << 40)) for s in range(3) for i in range(40)]
    kind = "stream bigint, seq bigint, words bigint, value bigint, draw bigint"
    df = spark.createDataFrame(rows, kind)
    kept = {(r["stream"], r["seq"]) for r in retained(df, policy, 0.3).collect()}
    for part in range(4):
        df.where((F.col("seq") >= 10 * part) & (F.col("seq") < 10 * part + 10)).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{tmp_path}/in")
    run = retention_stream(stream, policy, 0.3).writeStream.format("memory").queryName(f"gone_{policy}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    gone = {(r["stream"], r["seq"]) for r in spark.table(f"gone_{policy}").collect()}
    assert gone | kept == {(r[0], r[1]) for r in rows} and not gone & kept


def test_gate_never_holds_more_than_its_share():
    gate, rng = Gate(0.25), random.Random(3)
    for i in range(200):
        gate.put(i, rng.randint(1, 20), rng.random())
        assert gate.held <= int(0.25 * gate.seen + 1e-9) and gate.held == sum(gate.size.values())


def test_logs(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('﻿{"id": "a", "kind": "note"}\n\n{"id": "b", "kind": 3}\n{"id": "c", "ki')
    rows, bad = logs.read_jsonl(spark, str(path), logs.EVENT)
    assert sorted(r["id"] for r in rows.collect()) == ["a", "b"] and [r["line"] for r in bad.collect()] == ['{"id": "c", "ki']
    assert logs.read_torn(spark, str(path), logs.EVENT).count() == 2
    path.write_text('{"id": "a"}\n{"id": \n{"id": "b"}\n')
    with pytest.raises(ValueError):
        logs.read_torn(spark, str(path), logs.EVENT)


def test_hash_chain(spark):
    rows = logs.chain(["x", "y", "z"])
    kind = "seq int, previous string, sha256 string, event string"
    assert logs.broken_links(spark.createDataFrame(rows, kind), "seq").count() == 0
    rows[1]["event"] = "forged"
    assert [r["seq"] for r in logs.broken_links(spark.createDataFrame(rows, kind), "seq").collect()] == [1]


def test_ledger(spark):
    rows = [(1, None, None, "r", 2.0), (2, "reserve", "i", "r", 5.0), (2, "settle", "i", "r", 4.0), (2, "reserve", "j", "r", 1.5)]
    got = logs.ledger_balance(spark.createDataFrame(rows, "v int, event string, id string, run_id string, usd double"), ["run_id"]).first()
    assert (got["settled"], got["open"]) == (6.0, 1.5)
    with pytest.raises(Exception):
        logs.ledger_balance(spark.createDataFrame([(2, "odd", "i", "r", 1.0)], "v int, event string, id string, run_id string, usd double"), ["run_id"]).collect()


def test_three_valued_conditions(spark):
    row = spark.createDataFrame([(1.0, None)], "a double, b double")
    ask = lambda c: row.select(policies.condition(c).alias("x")).first()["x"]
    assert ask({"any": [{"gt": ["a", 0]}, {"gt": ["b", 0]}]}) is True
    assert ask({"all": [{"gt": ["a", 0]}, {"gt": ["b", 0]}]}) is None
    assert ask({"not": {"all": [{"lt": ["a", 0]}, {"gt": ["b", 0]}]}}) is True
    with pytest.raises(ValueError):
        policies.metadata_filter({"a": {"like": "x"}})


def test_clock(spark):
    rows = spark.createDataFrame([("2024",), ("2024-03",), ("2024-03-05T10:00:00+02:00",), ("no",)], "s string")
    assert [r[0] for r in rows.select(clock.canonical(F.col("s"))).collect()] == ["2024-01-01T00:00:00", "2024-03-01T00:00:00", "2024-03-05T08:00:00", None]
    asked = spark.createDataFrame([("what happened yesterday",), ("about 2 weeks ago",), ("between 2024-01-02 and 2024-01-09",), ("what",)], "q string").select(clock.window_in_words(F.col("q"), F.lit("2024-02-20").cast("date")).alias("w"))
    got = [(str(r["w"]["low"]), str(r["w"]["high"])) if r["w"] else None for r in asked.collect()]
    assert got == [("2024-02-19", "2024-02-19"), ("2024-02-03", "2024-02-09"), ("2024-01-02", "2024-01-09"), None]


def test_text(spark):
    rows = spark.createDataFrame([("Żółć  Café ﬁn!",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.normalise("t")).collect()] == ["zołc cafe fin", None]
    words = spark.createDataFrame([("cities",), ("glass",), ("dogs",)], "t string")
    assert [r[0] for r in words.select(tx.plural_folded(F.col("t"))).collect()] == ["city", "glass", "dog"]


def test_bootstrap_holds_the_mean(spark):
    rows = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(np.random.default_rng(1).normal(3, 1, 200))], "g string, o int, v double")
    got = inference.bootstrap(rows, "g", "o", "v", 400).first()
    assert got["low"] < got["mean"] < got["high"] and got["high"] - got["low"] < 0.4
    assert got == inference.bootstrap(rows, "g", "o", "v", 400).first()


def test_expired_winner_revives_nothing(spark):
    rows = spark.createDataFrame([("c", 1, 1, None), ("c", 2, 5, 8)], "chain string, id int, valid_from int, valid_until int")
    assert facts.valid_at(rows, F.lit(9), ["chain"], ["valid_from", "id"]).count() == 0
    assert facts.valid_at(rows, F.lit(8), ["chain"], ["valid_from", "id"], end_inclusive=True).first()["id"] == 2
    assert facts.valid_at(rows, F.lit(4), ["chain"], ["valid_from", "id"]).first()["id"] == 1


def test_rules_on_empty_and_cyclic_logs(spark):
    kind = "id string, supersedes string, seq int"
    assert integrity.duplicates(spark.createDataFrame([], kind), "id").count() == 0
    assert [r["id"] for r in integrity.supersession_cycles(spark.createDataFrame([("a", "b", 1), ("b", "a", 2)], kind), "id", "supersedes", "seq").collect()] == ["a"]


def test_json_leaves(spark):
    row = spark.createDataFrame([(1, json.dumps({"a": {"b": [1, "x"]}, "c": None}))], "k int, j string")
    assert {(r["path"], r["value"]) for r in logs.json_leaves(row, "k", "j").collect()} == {("a.b[0]", "1"), ("a.b[1]", "x"), ("c", None)}


def test_fair_share_gives_the_rest_to_larger_pieces_only(spark):
    """Pieces of just the level take no turn of what does not divide."""
    rows = [(1, 1, 3), (1, 2, 9), (2, 1, 3), (2, 2, 3), (2, 3, 3), (2, 4, 9)]
    df = spark.createDataFrame(rows, "g int, r int, n int")
    got = lambda g, budget: [x["share"] for x in packing.fair_share(df.where(f"g = {g}"), "g", "r", "n", budget).orderBy("r").collect()]
    assert got(1, 7) == [3, 4] and got(2, 15) == [3, 3, 3, 6]


def test_words_of_negation_beside_letters_beyond_ascii(spark):
    said = spark.createDataFrame([("éno",), ("ano",), ("canntß n'té",), ("no",)], "t string")
    assert [r[0] for r in said.select(tx.is_negated(F.col("t"))).collect()] == [True, False, True, True]


def test_capitals_beyond_ascii(spark):
    df = spark.createDataFrame([("Xe Erßie da", "Erßie"), ("İx Οδός ab", "AB")], "t string, s string")
    rows = evidence.grounded(df.withColumn("s", tx.upper_each(F.col("s"))), "t", "s").select("actual", "grounded").collect()
    assert [tuple(r) for r in rows] == [("Erßie", True), ("ab", True)]


def test_plans_take_a_step_once_a_class(spark):
    """Starts at the same node share what follows, over the limit of branches or without one."""
    facts = [(f"c{i}", "in", "n0") for i in range(30)] + [(f"s{i:03}", "at", "n0") for i in range(40)]
    df, starts = spark.createDataFrame(facts, "subject string, predicate string, object string"), spark.createDataFrame([(f"c{i}",) for i in range(31)], "start string")
    steps = [("in", "out"), ("at", "in")]
    got = {r["start"]: (r["status"], r["answers"]) for r in evidence.execute_plan(df, starts, steps, branch_limit=None).collect()}
    assert got["c30"] == ("none", "") and {got[f"c{i}"] for i in range(30)} == {("ambiguous", ",".join(f"s{i:03}" for i in range(40)))}
    limited = {r["start"]: (r["status"], r["answers"]) for r in evidence.execute_plan(df, starts, steps, branch_limit=39).collect()}
    assert limited["c3"] == ("branch_limit", "") and limited["c30"] == ("none", "")
