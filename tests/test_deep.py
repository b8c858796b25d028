"""Matching, decile samples, exact draws, windows of texts and the inverted file against loops and exact answers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, controls, packing, ranking, vectors, windows


def test_matching_with_a_hot_node_and_ties(spark):
    rng = random.Random(8)
    gold = [("c", i, ["hot"] + rng.sample("abcdef", 2)) for i in range(30)] + [("d", 1, ["x"])]
    pred = [("c", 100 + i, ["hot"] + rng.sample("abcdef", 2)) for i in range(40)] + [("e", 2, ["x"])]
    kind = "case string, n bigint, t array<string>"
    got = {(r["gold"], r["predicted"], r["overlap"]) for r in audit.greedy_match(spark.createDataFrame(gold, kind), spark.createDataFrame(pred, kind), "case", "n", "t").collect()}
    pairs = sorted((-round(len(set(a) & set(b)) / len(set(a) | set(b)), 6), g, p) for c, g, a in gold for e, p, b in pred if c == e)
    used_g, used_p, want = set(), set(), set()
    for o, g, p in pairs:
        if g not in used_g and p not in used_p:
            used_g.add(g)
            used_p.add(p)
            want.add((g, p, -o))
    assert got == want and len(want) == 30
    assert audit.greedy_match(spark.createDataFrame([], kind), spark.createDataFrame(pred, kind), "case", "n", "t").count() == 0


def test_shortfall_moves_to_the_nearest():
    assert packing.moved_shortfall([5, 5, 5, 5], [2, 9, 6, 5]) == [2, 8, 5, 5]
    assert packing.moved_shortfall([4, 4, 4], [4, 0, 9]) == [4, 0, 8]
    assert packing.moved_shortfall([3, 3], [1, 1]) == [1, 1]
    rng = random.Random(2)
    for _ in range(200):
        wanted, supply = [rng.randint(0, 6) for _ in range(6)], [rng.randint(0, 12) for _ in range(6)]
        got = packing.moved_shortfall(wanted, supply)
        assert sum(got) == min(sum(wanted), sum(supply)) and all(g <= s for g, s in zip(got, supply))


def test_every_prefix_of_a_decile_sample_is_spread(spark):
    rows = spark.createDataFrame([(i, (i * 7919) % 1000 if i % 50 else None) for i in range(1000)], "k bigint, v bigint")
    got = packing.decile_sample(rows, "k", "v", 73).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 74)) and len({r["k"] for r in got}) == 73
    quota = [7 + (b < 3) for b in range(10)]
    for n in range(1, 74):
        counts = [sum(r["bin"] == b for r in got[:n]) for b in range(10)]
        assert all(abs(c - n * q / 73) < 1.01 for c, q in zip(counts, quota))
    order = sorted(r["v"] for r in rows.collect() if r["v"] is not None)
    cut = [order[len(order) * b // 10] for b in range(10)]
    assert all(r["v"] >= cut[r["bin"]] for r in got)
    assert packing.decile_sample(rows.limit(0), "k", "v", 5).count() == 0 and packing.decile_sample(rows.limit(3), "k", "v", 5).count() <= 3


def test_draws_are_binomial(spark):
    from math import comb

    rows = [(g, int(random.Random(i * 31 + len(g)).random() < (0.2 if g == "a" else 0.6))) for g in ("a", "bb", "ccc") for i in range(40)] + [(None, 1)]
    got = controls.dispersion_p(spark.createDataFrame(rows, "g string, y int"), "g", "y", draws=99).first()
    sizes = {g: [y for x, y in rows if x == g] for g in ("a", "bb", "ccc")}
    p = sum(map(sum, sizes.values())) / sum(map(len, sizes.values()))

    def quantile(n, u):
        total, k = 0.0, 0
        while k < n:
            total += comb(n, k) * p**k * (1 - p) ** (n - k)
            if total > u:
                break
            k += 1
        return k

    stat = lambda ks: sum((k - 40 * p) ** 2 / (40 * p * (1 - p)) for k in ks)
    seen = stat(sum(v) for v in sizes.values())
    extreme = sum(stat(quantile(40, int(hashlib.sha256(f"29|{d}|{g}".encode()).hexdigest()[:8], 16) / 2**32) for g in sizes) >= seen - 1e-9 for d in range(99))
    assert got["groups"] == 3 and got["p"] == pytest.approx((1 + extreme) / 100) and got["d"] == pytest.approx(seen / 2, abs=1e-6)


def test_a_changed_source_loses_its_windows_and_no_other(spark, tmp_path):
    rng = random.Random(6)
    texts = {d: " ".join(rng.choice(["alpha", "beta", "gamma", "délta", "line\n", "zeta"]) for _ in range(rng.randint(50, 400))) for d in range(12)}
    texts[3], texts[4] = None, ""
    rows = [(d, t, "x") for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc bigint, text string, window_id string")
    found = windows.window_index(docs, "doc", size=200, overlap=20)
    asked = spark.createDataFrame([(1, "alpha"), (1, "délta"), (2, "zeta"), (3, "nowhere")], "q bigint, term string")
    hits = windows.search_windows(asked, found, docs, "q", 4).collect()
    parts = {(r["doc"], r["window"]): r for r in controls.text_windows(docs, "doc", "text", 200, 20).collect()}
    assert {r["q"] for r in hits} == {1, 2} and all(r["shown"] == parts[r["doc"], r["window"]]["text"] == texts[r["doc"]][r["char_start"] : r["char_end"]] for r in hits)
    bags = spark.createDataFrame([(d * windows.MOST + w, r["text"]) for (d, w), r in parts.items()], "w bigint, text string")
    every = ranking.bm25_top(asked, ranking.postings(bags, "w"), "q", "w", 4).collect()
    assert sorted((r["q"], r["rank"], r["doc"] * windows.MOST + r["window"]) for r in hits) == sorted((r["q"], r["rank"], r["w"]) for r in every)
    changed = hits[0]["doc"]
    now = docs.withColumn("text", F.when(F.col("doc") == changed, F.concat("text", F.lit("."))).otherwise(F.col("text"))).where(F.col("doc") != hits[-1]["doc"])
    again = {(r["q"], r["rank"]): (r["doc"], r["shown"]) for r in windows.search_windows(asked, found, now, "q", 4).collect()}
    assert set(again) == {(r["q"], r["rank"]) for r in hits}
    for r in hits:
        assert again[r["q"], r["rank"]] == (r["doc"], None if r["doc"] in (changed, hits[-1]["doc"]) else r["shown"])


def test_inverted_file_finds_nine_in_ten(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    heads = rng.normal(size=(30, 24))
    rows = [(int(i), [float(x) for x in heads[i % 30] + 0.6 * rng.normal(size=24)]) for i in range(3000)] + [(5000, None), (5001, [0.0] * 24), (5002, [])]
    table = spark.createDataFrame(rows, "k bigint, v array<double>")
    asked = table.where("k % 20 = 0")
    exact = ranking.dense_top(asked, table, "k", "v", 5).collect()
    found = vectors.inverted_file(table, "k", "v", lists=27, part=64)
    assert found.probes < 27
    got = vectors.inverted_top(asked, found, "k", "v", 5).collect()
    assert found.rows.count() == 3000 and found.rows.select("part").distinct().count() > 1
    truth = {(r["query"], r["doc"]) for r in exact}
    assert len(truth & {(r["query"], r["doc"]) for r in got}) >= 0.9 * len(truth)
    scores = {(r["query"], r["doc"]): r["score"] for r in exact}
    assert all(r["score"] == pytest.approx(scores[r["query"], r["doc"]], abs=2e-6) for r in got if (r["query"], r["doc"]) in scores)
    every = vectors.inverted_top(asked, found, "k", "v", 5, probes=27, wider=40).collect()
    assert {(r["query"], r["doc"]) for r in every} == truth
    assert vectors.inverted_top(asked, vectors.inverted_file(table.limit(0), "k", "v", 3), "k", "v", 5).count() == 0


def test_gold_finds_passages_of_any_length(spark, tmp_path):
    from quillon.plans.tables import gold

    docs = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a quick brown foxes"), (3, "jumps"), (4, None), (5, "xquick brown foxy jumps over the lazy dogs")]
    items = [(1, "quick brown fox"), (2, "jumps"), (3, "quick brown fox jumps over the lazy dog"), (4, "brown foxy jumps over the l"), (5, "lazy do"), (6, "nothing at all here")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["item_id"], r["doc_id"]) for r in gold(spark, str(tmp_path)).collect()}
    assert got == {(i, d) for i, p in items for d, t in docs if t and p in t}


def test_noise_is_solved_for_each_channel_and_any_observation(spark):
    from quillon.functions import numeric

    rows = spark.createDataFrame([(i, f"c{i % 2}", float((i * 37) % 101) * (1 + i % 2)) for i in range(2000)] + [(9999, "c0", None)], "k bigint, channel string, x double")
    e = numeric.hashed_normal("t", F.col("k"))
    clipped = lambda x, noise, sigma: F.greatest(F.lit(0.0), F.least(F.lit(200.0), F.round(x + sigma * noise)))
    for observe, target in ((lambda x, noise, sigma: x + sigma * noise, 0.6), (clipped, 0.9)):
        got = controls.solved_noise(rows, "channel", "x", e, target, observe, high=200.0).collect()
        assert len(got) == 2 and all(r["correlation"] == pytest.approx(target, abs=1e-6 if observe is not clipped else 2e-3) for r in got)
        again = rows.where("x is not null").join(spark.createDataFrame([(r["channel"], r["sigma"]) for r in got], "channel string, s double"), "channel").groupBy("channel").agg(F.corr("x", observe(F.col("x"), e, F.col("s"))).alias("c"))
        assert all(r["c"] == pytest.approx(target, abs=2e-3) for r in again.collect())


def test_left_out_recall_is_that_of_each_fold_alone(spark):
    from quillon.operators import graphs

    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(160)}
    edges = spark.createDataFrame([(a, b, rng.randint(1, 5)) for a, b in pairs], "a bigint, b bigint, support bigint")
    fold = {(r["a"], r["b"]): (r["support"], r["fold"]) for r in graphs.fold_edges(edges, 4).collect()}
    want = {}
    for f in range(4):
        near = {}
        for (a, b), (s, g) in fold.items():
            if g != f:
                near.setdefault(a, {})[b] = s
                near.setdefault(b, {})[a] = s
        held = [p for (a, b), (_, g) in fold.items() if g == f for p in ((a, b), (b, a))]
        hits = 0
        for a, b in held:
            scores = {}
            for c, s in near.get(a, {}).items():
                for y, t in near.get(c, {}).items():
                    if y != a and y not in near.get(a, {}):
                        scores[y] = scores.get(y, 0) + s * t
            hits += b in sorted(scores, key=lambda y: (-scores[y], y))[:3]
        want[f] = (len(held), hits)
    got = {r["fold"]: (r["held"], r["hits"]) for r in graphs.left_out_recall(edges, 4, 3).collect()}
    assert got == want and sum(h for _, h in want.values()) > 0


@pytest.mark.parametrize(("x", "dof", "p"), [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0), (2.0, 4, 0.735759), (37.0, 7, 4.6e-6), (500.0, 5, 0.0)])
def test_chi_square_chances(spark, x, dof, p):
    from quillon.functions import numeric

    got = spark.createDataFrame([(x, dof)], "x double, d int").select(numeric.chi_square_p(F.col("x"), F.col("d"))).first()[0]
    assert got == pytest.approx(p, abs=2e-6)


def test_aliases_are_leftmost_longest_and_ambiguous_ones_have_no_entity(spark):
    from quillon.operators import evidence

    rng = random.Random(12)
    aliases = [(1, "a b"), (2, "a b c"), (3, "b"), (4, "c d"), (5, "c d"), (6, "e"), (6, "e"), (None, "a"), (7, None)]
    texts = [(i, [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]) for i in range(60)] + [(99, None)]
    got = evidence.resolved_aliases(spark.createDataFrame(texts, "k bigint, t array<string>"), spark.createDataFrame(aliases, "e bigint, alias string"), "k", "t", "alias", "e").collect()
    known = {"a b": {1}, "a b c": {2}, "b": {3}, "c d": {4, 5}, "e": {6}}
    want = set()
    for k, t in texts:
        at = 0
        while at < len(t or []):
            for n in (3, 2, 1):
                phrase = " ".join(t[at : at + n])
                if at + n <= len(t) and phrase in known:
                    want.add((k, at + 1, n, phrase, min(known[phrase]) if len(known[phrase]) == 1 else None, len(known[phrase])))
                    at += n - 1
                    break
            at += 1
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


def test_world_records_show_no_source_without_provenance(spark):
    from quillon.sources import worlds

    observed = spark.createDataFrame([(1, "t", 5, "c"), (2, None, 6, "c")], "k bigint, text string, at bigint, channel string")
    specs = spark.createDataFrame([(1, "s"), (3, "x"), (3, "x")], "k bigint, source string")
    assert [r["source"] for r in worlds.records(observed, specs, "k", provenance=False).collect()] == ["", ""]
    assert sorted((r["id"], r["source"], r["heartbeat"]) for r in worlds.records(observed, specs.where("k < 3"), "k", spark.createDataFrame([(2, 0.5)], "k bigint, value double")).collect()) == [(1, "s", None), (2, "", 0.5)]
    assert worlds.spec_audit(observed, specs, "k").first().asDict() == {"unspecified": 1, "unobserved": 1, "repeated": 1}
