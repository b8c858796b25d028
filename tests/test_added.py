"""Operators without SQL, and edges of those with it, against plain Python."""

import collections
import glob
import hashlib
import hmac
import itertools
import math
import os
import random
import shutil
import tracemalloc
import time


import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import numeric, parse, text as tx
from quillon.operators import audit, controls, evidence, inference, measures, packing, probe, ranking, samples
from quillon.sources import index, worlds
from quillon.streaming import streams


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def loop_store(rows, policy, rate):
    """The retention gate as a list that is searched anew for the least row each time."""
    held, seen = [], 0
    weigh = {"recent": lambda r: r[1], "first": lambda r: -r[1], "long": lambda r: r[2], "short": lambda r: -r[2], "value": lambda r: r[3], "low_value": lambda r: -r[3], "random": lambda r: r[4], "dense": lambda r: r[3] / max(1, r[2]), "mention": lambda r: r[3], "oracle": lambda r: r[6]}[policy]
    for r in rows:
        seen += r[2]
        if policy == "mention":
            for h in held:
                if h[1][5] == r[5]:
                    h[0] += weigh(r)
        held.append([float(weigh(r)), r])
        while sum(h[1][2] for h in held) > int(rate * seen + 1e-9):
            held.remove(min(held, key=lambda h: (h[0], h[1][1])))
    return {(h[1][0], h[1][1]) for h in held}


@pytest.mark.parametrize("policy", [p for p in streams.POLICIES if p != "all"])
def test_every_retention_policy_against_a_loop(spark, policy):
    rng = random.Random(policy)
    rows = [(s, i, rng.randint(1, 30), rng.randint(0, 9), rng.randint(0, 1 << 40), rng.randint(0, 4), rng.randint(0, 1)) for s in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "stream bigint, seq bigint, words bigint, value bigint, draw bigint, topic bigint, needed int")
    got = {(r["stream"], r["seq"]) for r in streams.retained(df, policy, 0.3).collect()}
    assert got == set().union(*(loop_store([r for r in rows if r[0] == s], policy, 0.3) for s in range(3)))


def test_mentions_grow_a_store_by_its_rows_and_not_by_their_pairs():
    gate, rng, rows = streams.Gate(0.9), random.Random(5), []
    tracemalloc.start()
    for i in range(3000):
        rows.append((0, i, rng.randint(1, 9), rng.randint(0, 9), 0, i % 2, 0))
        gate.put(i, rows[-1][2], float(rows[-1][3]), rows[-1][5])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # a note for each row of the topic and mention would take more than 100 MB
    assert len(gate.size) > 1500 and sum(map(len, gate.rows.values())) == len(gate.size)
    gate, rows = streams.Gate(0.4), [(0, i, rng.randint(1, 9), rng.randint(-2, 9) / 4, 0, rng.randint(0, 12), 0) for i in range(300)]
    for r in rows:
        gate.put(r[1], r[2], r[3], r[5])
    assert {(0, s) for s in gate.size} == loop_store(rows, "mention", 0.4)


def test_event_time_windows_drop_late_rows_on_a_stream(spark, tmp_path):
    kind = "ts timestamp, k string, value double"
    for part, minutes in enumerate(([0, 5, 20], [61, 2], [240], [241], [3, 242])):  # 2 is late but within its time, 3 is too late
        rows = spark.createDataFrame([(m, "a", 1.0) for m in minutes], "m int, k string, value double").select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("m"))).alias("ts"), "k", "value")
        rows.coalesce(1).write.mode("append").json(f"{tmp_path}/in{part}")
        for f in glob.glob(f"{tmp_path}/in{part}/*.json"):
            (tmp_path / "all").mkdir(exist_ok=True)
            shutil.copy(f, f"{tmp_path}/all/{part}.json")
            os.utime(f"{tmp_path}/all/{part}.json", (1_700_000_000 + 60 * part,) * 2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/all")
    for name, made in (("tumble", streams.tumbling(stream, "ts", "1 hour", "k", late="30 minutes")), ("slide", streams.sliding(stream, "ts", "1 hour", "30 minutes", "k", late="30 minutes")), ("session", streams.sessions(stream, "ts", "30 minutes", "k", late="30 minutes"))):
        run = made.writeStream.format("memory").queryName(f"w_{name}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c_{name}").trigger(availableNow=True).start()
        run.awaitTermination()
    got = {r["window_start"].hour: r["n"] for r in spark.table("w_tumble").collect()}
    assert got == {0: 4, 1: 1}
    assert sum(r["n"] for r in spark.table("w_slide").collect()) == 2 * 5
    assert sorted(r["n"] for r in spark.table("w_session").collect()) == [1, 4]


def test_windows_of_text_against_a_loop(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "ż" * 3000, "x" * 5000] + ["".join(rng.choice("ab é漢😀\n") for _ in range(rng.randint(1, 4000))) for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k bigint, t string")
    got = collections.defaultdict(list)
    for r in controls.text_windows(rows, "k", "t", 300, 40).orderBy("k", "window").collect():
        got[r["k"]].append(r)
    for k, t in enumerate(texts):
        if not t:
            assert k not in got
            continue
        raw, reach = t.encode(), 0
        for i, r in enumerate(got[k]):
            assert r["window"] == i and r["text"] == t[r["char_start"] : r["char_end"]] == raw[r["byte_start"] : r["byte_end"]].decode()
            assert len(r["text"].encode()) <= 300 and r["char_start"] <= reach < r["char_end"] and (i == 0 or reach - r["char_start"] <= 40)
            if r["char_end"] < len(t) and any(m in r["text"][-(len(r["text"]) // 4) :] for m in " \n"):
                assert r["text"][-1] in " \n" or not any(m in r["text"][3 * len(r["text"]) // 4 :] for m in " \n")
            reach = r["char_end"]
        assert reach == len(t)


def test_vocabulary_scan_against_a_loop(spark):
    aliases = {"new york": "nyc", "york": "york", "ny": "nyc"}
    texts = ["New York and york, NY nyx", None, "newyork york-ny"]
    got = {(r["k"], r["start"], r["end"], r["value"]) for r in controls.vocabulary_scan(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", aliases).collect()}
    want = set()
    for k, t in enumerate(texts):
        i, low = 0, (t or "").lower()
        while i < len(low):
            fits = [a for a in aliases if low.startswith(a, i) and (i == 0 or not (low[i - 1].isalnum() or low[i - 1] == "_")) and (i + len(a) == len(low) or not (low[i + len(a)].isalnum() or low[i + len(a)] == "_"))]
            if fits:
                best = max(fits, key=len)
                want.add((k, i, i + len(best), aliases[best]))
                i += len(best)
            else:
                i += 1
    assert got == want


@pytest.mark.parametrize("k", [1, 3, 10])
def test_best_by_bounds_is_the_best(spark, k):
    rng = random.Random(k)
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(40)], weights=[1 / (j + 1) for j in range(40)], k=rng.randint(1, 60)))) for i in range(300)], "d bigint, text string")
    asked = spark.createDataFrame([(q, f"w{j}") for q in range(12) for j in rng.sample(range(45), rng.randint(1, 9))], "q int, term string")
    posts = index.postings(docs, "d")
    rows = lambda df: sorted((r["q"], r["rank"], r["d"], r["score"]) for r in df.collect())
    assert rows(ranking.bm25_top(asked, posts, "q", "d", k)) == rows(ranking.top(ranking.bm25(asked, posts, "q", "d"), k, "q", "d"))
    assert rows(ranking.jaccard_top(asked, posts, "q", "d", k)) == rows(ranking.top(ranking.jaccard(asked, posts, "q", "d"), k, "q", "d"))
    weighted = asked.withColumn("tf", F.lit(1))
    assert rows(ranking.tfidf_top(weighted, posts, "q", "d", k)) == rows(ranking.top(ranking.tfidf_cosine(weighted, posts, "q", "d"), k, "q", "d"))
    assert rows(ranking.idf_coverage_top(asked, posts, "q", "d", k)) == rows(ranking.top(ranking.idf_coverage(asked, posts, "q", "d"), k, "q", "d"))


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(20)]), rng.randint(1, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {r["k"]: r["s"] for r in measures.running(df, "o", {"s": F.col("v")}, tie="k").collect()}
    total, want = 0, {}
    for k, _, v in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        total += v
        want[k] = total
    assert got == want
    down = {r["o"]: r["s"] for r in measures.running(df.where("o is not null"), "o", {"s": F.col("v")}, descending=True).collect()}
    assert all(s == sum(v for _, o2, v in rows if o2 is not None and o2 >= o) for o, s in down.items())
    assert measures.running(df.limit(0), "o", {"s": F.col("v")}).count() == 0


def test_resampling_against_loops(spark):
    def u(seed, draw, unit):  # a digest serves eight draws
        digest = hashlib.sha256(f"{seed}|{draw // 8}|{unit}".encode()).hexdigest()
        return int(digest[8 * (draw % 8) : 8 * (draw % 8) + 8], 16) / 2**32

    times = lambda x: sum(x >= t for t in inference.POISSON)
    values = [float(i * i % 17) for i in range(40)]
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, o int, v double")
    for block in (1, 5):
        means = []
        for d in range(50):
            w = [times(u(7, d, i)) for i in range(40)]
            num = sum(t * sum(values[i : i + block]) for i, t in enumerate(w))
            den = sum(t * len(values[i : i + block]) for i, t in enumerate(w))
            means.append(num / den)
        got = inference.bootstrap(rows, "g", "o", "v", 50, block=block).first()
        assert (got["low"], got["high"]) == tuple(pytest.approx(np.quantile(means, q), abs=1e-6) for q in (0.025, 0.975))
    assert abs(np.mean([times(x / 100_000) for x in range(100_000)]) - 1) < 1e-3
    none = spark.createDataFrame([(1, 1.0, 1.0)], "unit int, a double, b double")
    assert inference.sign_flips(none, "unit", 20).first().asDict() == {"diff": 0.0, "p": 1.0}


def test_exact_intervals_and_power(spark):
    def tail(k, n, p):
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))

    rows = spark.createDataFrame([(0, 10), (3, 20), (20, 20), (7, 9), (0, 0)], "k int, n int").select("k", "n", inference.clopper_pearson(F.col("k"), F.col("n")).alias("i"))
    for r in rows.collect():
        k, n = r["k"], r["n"]
        if n == 0:
            assert r["i"] is None
            continue
        assert r["i"]["low"] == 0 if k == 0 else 1 - tail(k - 1, n, r["i"]["low"]) == pytest.approx(0.025, abs=1e-4)
        assert r["i"]["high"] == 1 if k == n else tail(k, n, r["i"]["high"]) == pytest.approx(0.025, abs=1e-4)
    assert inference.least_discordant() == 6 and inference.sign_test_power(5, 0.9) == 0
    assert inference.sign_test_power(6, 1.0) == 1 and inference.sign_test_power(20, 0.5) <= 0.05 < inference.sign_test_power(20, 0.8)


def test_seals(spark):
    rows = spark.createDataFrame([(f"case-{i}",) for i in range(60)], "id string")
    key = b"k" * 80
    got = {r["id"]: r["side"] for r in audit.sealed(rows, "id", key).collect()}
    assert got == {i: "test" if hmac.new(key, i.encode(), hashlib.sha256).digest()[-1] & 1 else "dev" for i in got} == audit.sealed_side(key, list(got))
    published = audit.commitment(audit.sealed(rows, "id", key), "id", "side", key)
    assert audit.revealed(rows.repartition(5), "id", key, published).count() == 60
    with pytest.raises(ValueError):
        audit.revealed(rows, "id", b"other", published)
    with pytest.raises(ValueError):
        audit.revealed(rows.limit(59), "id", key, published)


@pytest.mark.parametrize(("text", "want"), [("twenty-three and 1,234.5 minus -4", [23.0, 1234.5, -4.0]), ("no number", []), ("Nineteen, forty", [19.0, 40.0]), (None, None), ("2027-03-14 at 18:00", []), ("twice, once and 3 pm", [2.0, 1.0]), ("March 5, 2024: 7 of 12", [7.0, 12.0]), ("half past six is 1", [1.0])])
def test_numbers(spark, text, want):
    assert one(spark, parse.numbers, text) == want


@pytest.mark.parametrize(("text", "want"), [("at 14:05", 845), ("2:05 PM", 845), ("12 am", 0), ("12:30 p.m.", 750), ("25:00", None), ("13 pm", None), ("noon", 720), ("then", None), (None, None)])
def test_clock_times(spark, text, want):
    assert one(spark, parse.minutes, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("at 14:05 and 2 pm", [845, 840]), ("Half past six, quarter to 7 pm, 10 minutes past two", [390, 1125, 130]), ("twenty-five to one", [35]), ("ten to 12 am", [1430]), ("25:00 or 13 pm", []), ("noon, then midnight", [720, 0]), ("on May 5, 2024", []), ("", []), (None, None)],
)
def test_all_clock_times(spark, text, want):
    assert one(spark, parse.clock_times, text) == want


@pytest.mark.parametrize(("text", "want"), [("on 2024-02-29", "2024-02-29"), ("2023-02-29", None), ("March 5th, 2024", "2024-03-05"), ("5 march 2024", "2024-03-05"), ("soon", None)])
def test_dates(spark, text, want):
    got = one(spark, parse.date_of, text)
    assert (str(got) if got else None) == want


def test_letters_and_yes_no(spark):
    assert [one(spark, parse.letter, t) for t in ("B", "(c)", "Answer: D.", "A or B", "banana", None)] == ["B", "C", "D", None, None, None]
    assert [one(spark, parse.yes_no, t) for t in ("Yes.", "no", "yes and no", "perhaps", "not right at all")] == [True, False, None, None, None]
    f = one(spark, parse.answer_fields, "It is red\nCONF: 80%")
    assert (f["answer"], f["confidence"]) == ("It is red", 80)
    assert one(spark, parse.answer_fields, "plain conf: 300")["confidence"] is None


def test_markdown(spark):
    text = "# One\n\nA line\nof text\n\n## Two\n- item\n- other\n1. third\n\nLast"
    units = [(u["kind"], u["body"]) for u in one(spark, parse.markdown_units, text)]
    assert units == [("heading", "# One"), ("paragraph", "A line\nof text"), ("heading", "## Two"), ("item", "- item"), ("item", "- other"), ("item", "1. third"), ("paragraph", "Last")]
    path = spark.createDataFrame([(text,)], "x string").select(parse.markdown_units(F.col("x")).alias("u")).select(parse.heading_path(F.col("u"), F.lit(5)).alias("p"), parse.heading_path(F.col("u"), F.lit(1)).alias("q")).first()
    assert path["p"] == ["One", "Two"] and path["q"] == []


def test_stems(spark):
    stems = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "hoping": "hope", "falling": "fall",
             "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "hopefulness": "hope", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "as": "as"}
    plurals = {"glass": "glass", "this": "this", "ferries": "ferry", "news": "news", "children": "child", "boxes": "box", "churches": "church", "biases": "bias", "dogs": "dog", "bus": "bus", "gas": "gas", "s": "s", "heroes": "hero", "wolves": "wolf", "table": "table"}
    of = lambda words, fn: {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", fn(F.col("w"))).collect()}
    assert of(stems, tx.stem) == stems
    assert of(plurals, tx.plural_folded) == plurals
    assert spark.createDataFrame([(None,)], "w string").select(tx.stem(F.col("w")), tx.plural_folded(F.col("w"))).first() == (None, None)


def test_text_bits(spark):
    assert one(spark, lambda c: tx.unicode_tokens(c, 2), "Żółw 漢字 drei") == ["żółw", "漢字"]
    assert one(spark, tx.letters_only, "a1ż 2b") == ["a", "ż", "b"] and one(spark, lambda c: tx.stemmed(c, ("the",)), "the dogs") == ["dog"]
    row = spark.createDataFrame([(1, "b")], "b int, a string").select(tx.fingerprint("a", "b").alias("f")).first()
    assert row["f"] == hashlib.sha256(b'{"a":"b","b":1}').hexdigest()
    v = one(spark, lambda c: ranking.hashed_embedding(tx.ascii_tokens(c), 8), "a b")
    assert len(v) == 8 and sum(v) == 2.5


def test_greedy_match_and_leaders(spark):
    rng = random.Random(5)
    words = lambda: rng.sample("abcdefgh", rng.randint(1, 5))
    gold = [(c, f"g{i}", words()) for c in range(4) for i in range(4)]
    pred = [(c, f"p{i}", words()) for c in range(4) for i in range(4)]
    kind = "c int, n string, t array<string>"
    got = {(r["c"], r["gold"], r["predicted"]) for r in audit.greedy_match(spark.createDataFrame(gold, kind), spark.createDataFrame(pred, kind), "c", "n", "t").collect()}
    want = set()
    for c in range(4):
        pairs = sorted((-round(len(set(a) & set(b)) / len(set(a) | set(b)), 6), g, p) for (x, g, a), (y, p, b) in itertools.product(gold, pred) if x == y == c and set(a) & set(b))
        used = set()
        for _, g, p in pairs:
            if not {g, p} & used:
                used |= {g, p}
                want.add((c, g, p))
    assert got == want
    rows = [(c, i, words()) for c in range(3) for i in range(8)]
    found = {(r["c"], r["i"]): r["leader"] for r in samples.leaders(spark.createDataFrame(rows, "c int, i int, t array<string>"), "c", "i", "i", "t", 0.6).collect()}
    for c in range(3):
        heads = []
        for _, i, t in [r for r in rows if r[0] == c]:
            best = max(((len(set(t) & set(h)) / math.sqrt(len(t) * len(h)), -k, j) for k, (j, h) in enumerate(heads)), default=None)
            leader = best[2] if best and best[0] >= 0.6 else i
            if leader == i:
                heads.append((i, t))
            assert found[c, str(i)] == str(leader)


def test_plans(spark):
    facts = spark.createDataFrame([("a", "x", "b"), ("a", "x", "c"), ("b", "y", "d"), ("c", "y", "d"), ("d", "x", "a")], "subject string, predicate string, object string")
    starts = spark.createDataFrame([("a",), ("z",)], "start string")
    got = {r["start"]: (r["status"], r["answers"]) for r in evidence.execute_plan(facts, starts, [("x", "out"), ("y", "out")]).collect()}
    assert got == {"a": ("found", "d"), "z": ("none", "")}
    assert evidence.execute_plan(facts, starts, [("x", "out")], branch_limit=1).where("start = 'a'").first()["status"] == "branch_limit"
    with pytest.raises(ValueError):
        evidence.execute_plan(facts, starts, [])
    plans = {(r["plan"], r["truncated"]) for r in evidence.plans_from(facts, starts, most=2).collect()}
    assert plans == {("x", False), ("x>y", False)}


def test_context_bundle(spark):
    kind = "g int, r int, t string"
    states, hits = spark.createDataFrame([(1, 1, "a" * 30), (1, 2, "b" * 30)], kind), spark.createDataFrame([(1, 1, "c" * 50), (1, 2, "d" * 50)], kind)
    got = [(r["section"], r["t"][0]) for r in packing.context_bundle(states, hits, "g", "r", "t", 100).orderBy("section", "r").collect()]
    assert got == [("hits", "c"), ("state", "a")]


def test_formatters(spark):
    with pytest.raises(ValueError):
        packing.register_formatter("outline", None)


def test_worlds(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    worlds.write_world({"t": df}, f"file://{tmp_path}/w")
    assert sorted(r["k"] for r in worlds.read_world(spark, f"file://{tmp_path}/w")["t"].collect()) == [1, 2]
    df.limit(1).write.mode("append").json(f"file://{tmp_path}/w/t")
    with pytest.raises(ValueError):
        worlds.read_world(spark, f"file://{tmp_path}/w")
    worlds.write_csv(df, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["k", "v"]
    a, b = (worlds.synthetic_streams(spark, [1, 2, 3], 20).orderBy("seed", "seq").collect() for _ in range(2))
    assert a == b and len(a) == 60 and all(x["ts"] < y["ts"] for x, y in zip(a, a[1:]) if x["seed"] == y["seed"])
    assert worlds.lcg(1, "a", 3) == worlds.lcg(1, "a", 3) != worlds.lcg(1, "b", 3)


def test_retries():
    answers, slept = iter([(429, {"Retry-After": "3"}, b""), (503, {}, b""), (200, {}, b"ok")]), []
    assert worlds.fetch("u", lambda _: next(answers), sleep=slept.append) == b"ok" and slept == [3.0, 2.0]
    with pytest.raises(ValueError):
        worlds.fetch("u", lambda _: (404, {}, b""))
    with pytest.raises(TimeoutError):
        worlds.fetch("u", lambda _: (500, {}, b""), attempts=2, sleep=slept.append)


def test_pointers():
    value = {"a": [1, {"b/c": 2}]}
    assert worlds.get_pointer(value, "/a/1/b~1c") == 2 and worlds.set_pointer(value, "/a/0", 9) == {"a": [9, {"b/c": 2}]}
    assert worlds.set_pointer(value, "/a/-", 5)["a"][-1] == 5 and worlds.set_pointer(value, "", 1) == 1 and value["a"][0] == 1
    with pytest.raises(KeyError):
        worlds.get_pointer(value, "/x")


def test_scorer_edges(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    ask = lambda answer: spark.range(1).select(audit.scored(F.lit(answer), F.lit("new york"), arr("nyc"), arr("york"), arr("new york", "york", "nyc", "paris")).alias("s")).first()["s"]
    assert ask("In New York!")["correct"] and ask("NYC, perhaps")["error"] == "hedged" and ask("York")["error"] == "near_miss"
    assert ask("paris")["error"] == "wrong" and ask("paris or york")["error"] == "several" and ask(None)["error"] == "unmatched" and ask("I don't know")["error"] == "abstained"


def test_violations_between(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert audit.violations_between(a, a.repartition(2)).first().asDict() == {"only_first": 0, "only_second": 0}
    assert audit.violations_between(a, a.distinct()).first().asDict() == {"only_first": 1, "only_second": 0}


def test_shifted(spark):
    rows = spark.createDataFrame([("g", i, i * 10) for i in range(4)], "g string, o int, v int")
    assert [r["v"] for r in samples.shifted(rows, "g", "o", "v", 1).orderBy("o").collect()] == [None, 0, 10, 20]




def test_logistic_probe_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))).astype(int)
    rows = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "i int, a double, b double, y int")
    got = probe.logistic_fit(rows, [F.col("a"), F.col("b")], F.col("y"), ridge=0.5)
    full, w = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(4000):  # plain descent
        w += 0.01 * (full.T @ (y - 1 / (1 + np.exp(-full @ w))) - 0.5 * np.array([0, 1, 1]) * w)
    assert got == pytest.approx(w, abs=1e-4)
    leaks = probe.leak_probe(rows, [F.col("a"), F.col("b")], F.col("y"), F.col("i") % 2).collect()
    assert len(leaks) == 2 and all(r["auroc"] > 0.8 for r in leaks)
    assert probe.logistic_fit(rows.limit(0), [F.col("a")], F.col("y")).tolist() == [0, 0]


def test_numeric(spark):
    rows = spark.createDataFrame([(0.5,), (0.975,), (0.0,), (None,)], "p double").select(numeric.normal_quantile("p").alias("z"), numeric.quantised(F.lit(-0.0000001)).alias("q")).collect()
    assert rows[0]["z"] == 0 and rows[1]["z"] == pytest.approx(1.959964, abs=1e-6) and rows[2]["z"] is None and rows[3]["z"] is None
    assert math.copysign(1, rows[0]["q"]) == 1
    assert spark.range(1, 6).select(F.sum(numeric.zipf(F.col("id"), 5))).first()[0] == pytest.approx(1)


def test_deadlines(spark):
    assert probe.within_time(spark.range(3), 60)[0] == "ok"
    slow = spark.range(4).select(F.udf(lambda x: time.sleep(15), "int")("id").alias("x"))
    assert probe.within_time(slow, 1.0) == ("timeout", [])


def test_searches_go_on_until_nothing_is_unseen(spark):
    """Each text shares a word with the next; two queries that walk the same way search each text once."""
    texts = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(7)], "doc_id bigint, text string")
    ix, asked = index.index_of(index.postings(texts, "doc_id"), "doc_id"), []

    def search(terms):
        asked.extend(terms.select("term").collect())
        return ranking.bm25_top(terms, ix, "item_id", "doc_id", 3)

    first = spark.createDataFrame([(q, d, 1) for q, d in ((1, 0), (2, 0), (3, 5))], "item_id bigint, doc_id bigint, rank int")
    walk = [(q, d, d) for q in (1, 2) for d in range(7)] + [(3, 5, 0), (3, 4, 1), *((3, d, 5 - d) for d in (3, 2, 1, 0))]
    assert sorted(map(tuple, probe.iterative_search(first, search, texts, "item_id", "doc_id").collect())) == sorted(walk)
    assert len(asked) == 14
    assert sorted(map(tuple, probe.iterative_search(first, search, texts, "item_id", "doc_id", rounds=2).collect())) == sorted(w for w in walk if w[2] <= 2)


def test_the_iterative_search_has_no_set_number_of_rounds(spark, monkeypatch):
    from quillon.plans import added

    given = {}
    monkeypatch.setattr(added, "lexical", lambda *a: (None, None))
    monkeypatch.setattr(added, "_top5", lambda *a: None)
    monkeypatch.setattr(probe, "iterative_search", lambda *a, rounds=None, **more: given.update(rounds=rounds, **more))
    added.iterative_search(spark, "/root/testdata/sf0.001")
    assert given == {"rounds": None}


def test_json_arrays_are_lines_of_few_files(spark, tmp_path):
    """However many keys there are; a key of very many rows has several arrays, and none of its rows is lost."""
    rows = [(k % 500, k, f"a\n{k}" if k % 7 else None, k / 3) for k in range(2000)] + [(None, 2000, "null", None), (7, None, None, float("inf"))] + [(500, k, "hot", 0.1) for k in range(3000, 4000)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_type string, value double").repartition(3)
    worlds.write_json_arrays(df, f"{tmp_path}/arrays", "user_id", "rows", most=100)
    files = glob.glob(f"{tmp_path}/arrays/part-*")
    sizes = [r[0] for r in spark.read.schema("rows array<string>").json(f"{tmp_path}/arrays").select(F.size("rows")).collect()]
    assert len(files) <= 4 and len(sizes) == 511 and max(sizes) <= 120
    found = worlds.read_json_array(spark, f"{tmp_path}/arrays", "rows array<struct<event_id:bigint,event_type:string,value:double>>", "rows", lines=True).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((r[1:] for r in rows), key=repr)


def test_the_array_scan_writes_no_file_a_user(spark, tmp_path):
    from quillon.plans import added

    spark.createDataFrame([(k, k % 300, "x", 1.0) for k in range(600)], "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = added.json_array_scan(spark, str(tmp_path))
    assert len(found.inputFiles()) <= 4 and found.count() == 600
