"""The written index: pruned partitions, bounds, statistics of what a query may see."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.operators import ranking
from quillon.sources import index


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(0, 40))) for _ in range(3000)]
    texts[7], texts[8] = None, ""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    ix = index.read_index(spark, index.build_index(docs, "doc", f"file://{tmp_path_factory.mktemp('ix')}"), "doc")
    queries = {q: rng.choices(words, weights, k=rng.randint(1, 6)) for q in range(25)}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "q bigint, term string")
    return texts, queries, docs, ix, asked


def brute(texts, queries, cutoff=lambda q: 10**9):
    out = {}
    for q, terms in queries.items():
        bags = {d: Counter((t or "").split()) for d, t in enumerate(texts) if t and d < cutoff(q)}
        n = len(bags)
        avg = sum(sum(b.values()) for b in bags.values()) / n if n else 1
        df = Counter(t for b in bags.values() for t in b)
        scores = {}
        for d, b in bags.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / avg)) for t in set(terms) if b[t])
            if round(s, 6) > 0:
                scores[d] = round(s, 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]
    return out


def told(rows):
    out = {}
    for r in rows.orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append((r["doc"], pytest.approx(r["score"], abs=2e-6)))
    return out


@pytest.mark.parametrize("at_once", [None, 0])
def test_top_is_that_of_all_scores(corpus, at_once):
    texts, queries, docs, ix, asked = corpus
    want = {q: v for q, v in brute(texts, queries).items() if v}
    got = told(ranking.bm25_top(asked, ix, "q", "doc", 5, at_once=at_once))
    assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}
    for top, every in ((ranking.tfidf_top, ranking.tfidf_cosine), (ranking.jaccard_top, ranking.jaccard), (ranking.idf_coverage_top, ranking.idf_coverage)):
        terms = asked.groupBy("q", "term").agg(F.count("*").alias("tf"))
        whole = ranking.top(every(terms, index.index_of(index.postings(docs, "doc"), "doc"), "q", "doc"), 5, "q", "doc")
        rows = lambda df: sorted((r["q"], r["rank"], r["doc"], round(r["score"], 5)) for r in df.collect())
        assert rows(top(terms, ix, "q", "doc", 5, at_once=at_once)) == rows(whole)


@pytest.mark.parametrize("at_once", [None, 0])
def test_visible_statistics_are_those_of_the_prefix(corpus, at_once):
    texts, queries, docs, ix, asked = corpus
    cutoff = lambda q: [0, 1, 9, 50, 1000, 2999, 3000, 99999][q % 8]
    timed = asked.withColumn("cutoff", F.element_at(F.array(*map(F.lit, [0, 1, 9, 50, 1000, 2999, 3000, 99999])), (F.col("q") % 8 + 1).cast("int")))
    want = {q: v for q, v in brute(texts, queries, cutoff).items() if v}
    got = told(ranking.visible_bm25_top(timed, ix, "q", "doc", 5, segments=7, at_once=at_once))
    assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}
    assert all(r["doc"] < cutoff(r["q"]) for r in ranking.visible_bm25_top(timed, ix, "q", "doc", 5).collect())


def test_plans_read_the_partitions_of_their_terms(corpus):
    *_, ix, asked = corpus
    one = asked.where("q = 0").limit(1)
    plan = ranking.bm25_top(one, ix, "q", "doc", 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    files = lambda terms: len(ix.asked(terms).inputFiles())
    assert ix.buckets == index.LEAST_BUCKETS and 0 < len(ix.asked(one).select(F.input_file_name()).distinct().collect()) == 1 <= files(asked)


def test_a_tiny_and_an_empty_table(spark, tmp_path):
    for rows in ([], [(1, None), (2, "")], [(1, "a b a")]):
        docs = spark.createDataFrame(rows, "doc bigint, text string")
        ix = index.read_index(spark, index.build_index(docs, "doc", f"file://{tmp_path}/t{len(rows)}"), "doc")
        asked = spark.createDataFrame([(1, "a"), (1, "zz")], "q bigint, term string")
        assert ranking.bm25_top(asked, ix, "q", "doc", 5).count() == (1 if len(rows) == 1 else 0)
        assert ranking.visible_bm25_top(asked.withColumn("cutoff", F.lit(5)), ix, "q", "doc", 5).count() == (1 if len(rows) == 1 else 0)


def test_blocks_move_once_and_pairs_never(corpus):
    """A block goes to its range of documents, whichever queries ask for it; scores are summed there."""
    _, _, _, ix, asked = corpus
    for scored in (ranking.bm25(asked, ix, "q", "doc"), ranking.jaccard(asked, ix, "q", "doc"), ranking.idf_coverage(asked, ix, "q", "doc")):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(range" in plan and "hashpartitioning(q#" not in plan


def test_fields_are_summed_where_their_document_is(spark, corpus, tmp_path_factory):
    texts, _, docs, ix, asked = corpus
    heads = docs.select("doc", F.expr("substring(text, 1, 12)").alias("text"))
    other = index.read_index(spark, index.build_index(heads, "doc", f"file://{tmp_path_factory.mktemp('heads')}", ranges=ix.ranges), "doc")
    body, head = (ranking.bm25(asked, x, "q", "doc").withColumnRenamed("score", n) for x, n in ((ix, "b"), (other, "h")))
    whole = body.join(head, ["q", "doc"], "full").select("q", "doc", F.round(4 * F.coalesce("h", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    got = ranking.bm25_fields_top(asked, [(other, 4.0), (ix, 1.0)], "q", "doc", 5)
    assert told(got) == told(ranking.top(whole, 5, "q", "doc"))


def test_terms_and_documents_meet_the_postings_held_or_exchanged_alike(spark, corpus, tmp_path, monkeypatch):
    docs = corpus[2].where("doc < 60")
    rows = lambda name: sorted(map(tuple, index.read_index(spark, index.build_index(docs, "doc", f"file://{tmp_path}/{name}"), "doc").posts.select("doc", "term", "tf", "dl", "df", "dn", F.round("unit", 9)).collect()))
    held = rows("held")
    monkeypatch.setattr(index, "HELD", 0)
    assert held and rows("exchanged") == held


def test_the_build_moves_texts_and_blocks_but_no_postings(spark, corpus, tmp_path):
    docs, ix = corpus[2], corpus[3]

    def moved():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = moved()
    index.build_index(docs, "doc", f"file://{tmp_path}")
    assert moved() - before < ix.posts.count() / 2


def test_postings_of_odd_texts_and_keys(spark, tmp_path):
    """Texts that touch, are empty or null, hold other scripts or capitals of theirs that become a-z; keys that are null or stand in several rows."""
    texts = ["ab", "cd", "", "İx Klm Straße", None, "a-b_c\tA\n9", "é", "zz9", "ab AB aB", "\U0001f600a\U0001f600"]
    rows = [(f"k{i % 7}" if i % 5 else None, t) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc string, text string").repartition(3)
    want = sorted((str(r["doc"]), r["term"], r["tf"]) for r in index.postings(docs, "doc").collect())
    for k, tokens in enumerate((index.ascii_tokens, lambda text: index.ascii_tokens(text))):
        ix = index.read_index(spark, index.build_index(docs, "doc", f"file://{tmp_path}/{k}", tokens=tokens, ranges=3), "doc")
        got = ix.posts.collect()
        assert sorted((str(r["doc"]), r["term"], r["tf"]) for r in got) == want
        lengths = Counter()
        for doc, _, tf in want:
            lengths[doc] += tf
        assert all(r["dl"] == lengths[str(r["doc"])] and r["dn"] == sum(d == str(r["doc"]) for d, _, _ in want) for r in got)
        assert {(str(r["doc"]), r["dl"]) for r in ix.docs.collect()} == set(lengths.items())


def test_token_grams_are_equal_where_tokens_are(spark):
    texts = ["a bb c dd e", "A-bb c, dd E f", "", None, "a bb c dd", "x a bb c dd e f g", "ab b c dd e", "e dd c bb a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string").repartition(1)
    found = {}
    for r in index.token_grams(docs, "doc", 5).collect():
        found.setdefault(r["gram"], []).append(r["doc"])
    assert sorted(sorted(v) for v in found.values()) == [[0, 1, 5], [1, 5], [5], [5], [6], [7]]
    assert sorted(r["doc"] for r in index.token_grams(docs, "doc", 5, at=1).collect()) == [1, 5]
    assert index.token_grams(docs.where("doc = 3"), "doc", 5).count() == 0


def test_passages_are_found_without_exchanging_texts(spark, tmp_path):
    """Also where a passage begins and ends inside tokens, and where it is short."""
    from quillon.plans.tables import gold

    words = "one two three four five six seven eight nine ten".split()
    spark.createDataFrame([(k, f"d{k} " + " ".join(words[k % 3 :]) + " end") for k in range(300)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    passages = ["wo three four five six seven eig", "one two three four five six seven", "three four fi", "nine", "seven six five four three two one zero"]
    spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = gold(spark, str(tmp_path))
    texts = [f"d{k} " + " ".join(words[k % 3 :]) + " end" for k in range(300)]
    assert sorted(map(tuple, found.collect())) == [(i, k) for i, p in enumerate(passages) for k in range(300) if p in texts[k]]
    assert "hashpartitioning(doc_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_belongs_to_a_document_is_written_once(corpus):
    """Not beside each of its postings: blocks hold places and occurrences, and a range's row its documents' keys, lengths and norms."""
    texts, _, _, ix, _ = corpus
    assert [name for name, kind in ix.blocks.dtypes if kind.startswith("array")] == ["at", "tf"]
    assert ix.rows.count() == ix.ranges and ix.rows.agg(F.sum(F.size("keys"))).first()[0] == sum(bool(t) for t in texts) == ix.n
    held = {r["doc"]: r["length"] for r in ix.posts.groupBy("doc").agg(F.sum(F.col("unit") ** 2).alias("length")).collect()}
    assert len(held) == ix.n and all(abs(v - 1) < 1e-9 for v in held.values())


@pytest.mark.parametrize("at_once", [None, 0])
def test_scores_of_many_queries_are_summed_in_their_range(corpus, monkeypatch, at_once):
    """No pair of a query and a document is a row before the best of a range are known, and more queries than go together are dealt in parts."""
    texts, queries, docs, ix, asked = corpus
    plan = ranking.bm25_top(asked, ix, "q", "doc", 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan and "arrays_zip" not in plan
    whole = told(ranking.top(ranking.bm25(asked, ix, "q", "doc", cap=1.5), 7, "q", "doc"))
    monkeypatch.setattr(ranking, "TOGETHER", 4)
    assert whole and told(ranking.bm25_top(asked, ix, "q", "doc", 7, cap=1.5, at_once=at_once)) == whole


def test_ties_and_documents_of_other_kinds(spark, tmp_path):
    """Copies rank by id, also where their range has more of them than are asked for; keys are strings, and a query asks twice or for nothing."""
    docs = spark.createDataFrame([(f"d{k:02d}", "a b" if k % 3 else "a a c") for k in range(40)], "doc string, text string")
    ix = index.read_index(spark, index.build_index(docs, "doc", f"file://{tmp_path}", ranges=3), "doc")
    asked = spark.createDataFrame([("x", "b"), ("x", "b"), ("y", "zz"), ("z", "a")], "q string, term string")
    got = ranking.bm25_top(asked, ix, "q", "doc", 4)
    assert sorted((r["q"], r["rank"], r["doc"]) for r in got.collect()) == [("x", 1, "d01"), ("x", 2, "d02"), ("x", 3, "d04"), ("x", 4, "d05"), ("z", 1, "d00"), ("z", 2, "d03"), ("z", 3, "d06"), ("z", 4, "d09")]


def test_fire_set_ranks_once(spark):
    from quillon.plans import catalogue

    plan = catalogue.QUERIES["fire_set"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "bucket" not in plan


def test_parts_of_the_build_follow_the_data(spark, corpus, tmp_path, monkeypatch):
    """What a task of the build reads does not grow with the table where a session has few shuffle partitions."""
    monkeypatch.setattr(index, "POSTINGS", 1024)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        ix = index.read_index(spark, index.build_index(corpus[2], "doc", f"file://{tmp_path}", ranges=24), "doc")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    files = {r[0].rsplit("/", 1)[1].split("-")[1] for r in ix.blocks.select(F.input_file_name()).distinct().collect()}
    assert len(files) > 1 and ix.posts.count() == corpus[3].posts.count()


@pytest.mark.parametrize("at_once", [None, 0])
def test_documents_leave_a_written_index_by_marks(corpus, at_once):
    """As an index of those left, also after a second removal, and no posting is a row of its own for it."""
    _, _, docs, ix, asked = corpus
    once = ranking.without(ix, docs.where("doc % 5 = 0").select("doc").unionByName(docs.sparkSession.createDataFrame([(5,), (10**6,)], "doc bigint")), "doc")
    left = ranking.without(once, docs.where("doc % 7 = 0").select("doc"), "doc")
    whole = index.index_of(index.postings(docs.where("doc % 5 <> 0 and doc % 7 <> 0"), "doc"), "doc")
    assert left.blocks is not None and left.rows is ix.rows
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for part, names in (("docs", ["doc", "dl", "dn"]), ("terms", ["term", "df"]), ("stats", ["n", "avgdl"]), ("posts", ["doc", "term", "tf", "dl", "df", "dn", "unit"])):
        assert rows(getattr(left, part).select(names)) == rows(getattr(whole, part).select(names)), part
    terms = asked.groupBy("q", "term").agg(F.count("*").alias("tf"))
    rounded = lambda df: sorted((r["q"], r["rank"], round(r["score"], 5)) for r in df.collect())
    for best, every in ((ranking.bm25_top, ranking.bm25), (ranking.tfidf_top, ranking.tfidf_cosine), (ranking.jaccard_top, ranking.jaccard), (ranking.idf_coverage_top, ranking.idf_coverage)):
        assert rounded(best(terms, left, "q", "doc", 5, at_once=at_once)) == rounded(ranking.top(every(terms, whole, "q", "doc"), 5, "q", "doc")), best
    plan = ranking.bm25_top(asked, left, "q", "doc", 5, at_once=at_once)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(at" not in plan
    nothing = ranking.without(ix, docs.select("doc"), "doc")
    assert nothing.n == 0 and ranking.bm25_top(asked, nothing, "q", "doc", 5).count() == 0
