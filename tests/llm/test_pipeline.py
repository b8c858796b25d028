"""The corpus pipeline, stage by stage, against brute force on a small fixture."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline

from .test_ops import brute_components, counts_of


def test_stages(spark, tmp_path):
    words = lambda seed, n: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 500, n))
    base = words(1, 60)
    texts = [base, base, base.replace("w1", "w2", 1), words(2, 40), "too short", None, words(3, 50) + ' token = "0123456789abcdef0123"', words(4, 30), " ".join(["again and again the same"] * 9)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "byte-level BPE"]
    run = lambda k, df: corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path))

    kept = run(0, spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = [i for i, t in enumerate(texts) if (c := counts_of(t or ""))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == docs.columns

    unique = run(1, kept)
    groups = brute_components([texts[i] for i in want], 5, 80)
    assert sorted(r["doc_id"] for r in unique.collect()) == [want[k] for k, (_, root) in groups.items() if root == k]

    clean = run(2, unique).collect()
    assert all("0123456789abcdef0123" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean)
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in unique.collect()}

    mixed = run(3, run(2, unique))
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(final) == mixed.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) // 4 for r in final)


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, repeated rows and further columns: a row is a document."""
    text = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 500, 40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (6, None), (7, text(5))]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 1, 2) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, copies int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    here = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, here, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 7
    unique = corpus_pipeline.near_duplicates(spark, here, str(tmp_path))
    assert sorted(r["text"] or "" for r in unique.collect()) == sorted([text(k) for k in range(1, 6)] + [""])
    mixed = corpus_pipeline.mix(spark, here, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() == 7  # one source: its target is its size
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, here.limit(0), str(tmp_path)).count() == 0


def test_row_numbers_do_not_depend_on_partitions(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(5).write.parquet(f"{tmp_path}/rows")
    seen = []
    for size, least in (("1k", "16"), ("128m", "1"), ("7k", "3")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        try:
            rows = corpus_pipeline._numbered(spark.read.parquet(f"{tmp_path}/rows")).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.minPartitionNum")
        seen.append({r["doc_id"]: r["__row"] for r in rows})
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) == 4000
    made = corpus_pipeline._numbered(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id bigint, text string"))
    assert len({r["__row"] for r in made.collect()}) == 2 and made.columns == ["doc_id", "text", "__row"]
