"""The memory store: appends under a lock, rules, views, search with expansion and snippets, the protocol and the tool surface."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillon import memory
from quillon.sources import index


@pytest.fixture
def store(spark, tmp_path):
    glossary = spark.createDataFrame([("kot", "cat")], "token string, term string")
    s = memory.MemoryStore(spark, str(tmp_path / "log"), glossary=glossary)
    s.add("finding", "Cats sleep", "A cat sleeps most of the day", id="PM-20240101-00000001", source_refs=["s"], confidence="high")
    s.add("decision", "Feed twice", "Feeding happens twice", id="PM-20240101-00000002", confidence="low")
    return s


def test_appends_follow_the_rules(store):
    with pytest.raises(ValueError, match="missing-provenance"):
        store.add("finding", "t", "b", confidence="low")
    with pytest.raises(ValueError, match="exists"):
        store.add("decision", "t", "b", id="PM-20240101-00000001", confidence="low")
    with pytest.raises(ValueError, match="unknown fields"):
        store.add("decision", "t", "b", colour="red")
    with pytest.raises(ValueError, match="not in the log"):
        store.supersede("PM-20240101-0000ffff", "decision", "t", "b", "why", confidence="low")
    new = store.supersede("PM-20240101-00000002", "decision", "Feed thrice", "Three meals", "data", "correction", confidence="high")
    with pytest.raises(ValueError, match="superseded already"):
        store.supersede("PM-20240101-00000002", "decision", "t", "b", "why", confidence="low")
    assert store.get("PM-20240101-00000002")["is_active"] is False and store.get(new["id"])["is_active"] and store.get("PM-20240101-0000ffff") is None
    assert {r["id"] for r in store.active().collect()} == {"PM-20240101-00000001", new["id"]}
    assert store.verify().count() == 0 and store.status() == {"events": 3, "kinds": 2, "active": 2}
    assert [r["id"] for r in store.timeline(1).collect()] == [new["id"]] and store.timeline(500, "finding").count() == 1


def test_search_and_context(store):
    found = store.search("Kot?").collect()
    assert [r["title"] for r in found] == ["Cats sleep"] and "[cat]" in found[0]["snippet"] and found[0]["expanded"]
    assert store.search("Kot", expand=False).count() == 0 and store.search("...").count() == 0
    assert store.search("twice cat", kinds=("decision",)).first()["title"] == "Feed twice"
    assert store.context("cat") == "Cats sleep\nA cat sleeps most of the day"
    folder = store.rebuild()
    assert store.rebuild() == folder  # fresh
    store.add("decision", "Another cat", "More", confidence="low")
    assert store.rebuild() != folder and store.search("another").count() == 1


def test_a_broken_embedder_degrades(spark, tmp_path, store):
    def embed(texts):
        return [[1.0 if "cat" in t.lower() else 0.1, 0.5] for t in texts]

    store.embedder = embed
    assert not store.search("cat").first()["degraded"] and store.search("cat").first()["title"] == "Cats sleep"

    def broken(texts):
        raise RuntimeError("no model")

    store.embedder = broken
    assert store.search("cat").first()["degraded"]


def test_locks(tmp_path):
    path, seen = tmp_path / "x.lock", []

    def write(k):
        with memory.Lock(path):
            seen.append(k)
            time.sleep(0.01)
            seen.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(a == b for a, b in zip(seen[::2], seen[1::2])) and not path.exists()
    path.write_text("someone")
    with pytest.raises(TimeoutError), memory.Lock(path, patience=0.1):
        pass
    os.utime(path, (1, 1))
    with memory.Lock(path):  # a stale lock is broken
        pass


def test_public_and_document_text(spark):
    rows = spark.createDataFrame([("t", " ", "b", "x")], "title string, summary string, body string, gold string")
    assert memory.public(rows).columns == ["title", "summary", "body"]
    assert rows.select(memory.document_text("title", "summary", "body").alias("d")).first()["d"] == "t\nb"


def test_protocol(spark):
    records = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c")], "seq bigint, ts bigint, text string")
    questions = spark.createDataFrame([(7, 20), (8, 25), (9, 5)], "id bigint, asked bigint")
    system = memory.Recent()
    assert memory.validated(system, records, questions) == []
    system.ingest(records)
    assert {r["id"]: r["answer"] for r in system.query(questions).collect()} == {7: "a", 8: "b", 9: None}

    class Ahead(memory.Recent):
        def query(self, questions):
            last = self.records.agg(F.max("text").alias("answer")) if self.records is not None else None
            return questions.select("id").crossJoin(last) if last is not None else questions.select("id", F.lit(None).cast("string").alias("answer"))

    assert "an answer uses later records" in memory.validated(Ahead(), records, questions)
    assert memory.validated(system, records.withColumn("ts", -F.col("ts")), questions) == ["records are not in order"]


def test_tools_and_command_line(store, capsys):
    assert memory.call_tool(store, "status", {})["events"] == 2
    assert memory.call_tool(store, "timeline", {"limit": 1})[0]["id"].startswith("PM-")
    with pytest.raises(ValueError):
        memory.call_tool(store, "drop", {})


def test_snapshots_are_immutable(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    one = index.snapshot(rows, f"file://{tmp_path}", "k")
    assert index.snapshot(rows.repartition(3), f"file://{tmp_path}", "k") == one != index.snapshot(rows.limit(1), f"file://{tmp_path}", "k")


def test_stale_indexes_are_seen(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "a b"), (2, "b c")], "k int, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    folder = index.build_index(docs, "k", f"file://{tmp_path}/ix")
    assert index.staleness(spark, folder, docs) == "fresh" and index.staleness(spark, folder + "x", docs) == "missing"
    spark.createDataFrame([(3, "c d")], "k int, text string").write.mode("append").parquet(path)
    assert index.staleness(spark, folder, spark.read.parquet(path)) == "stale"
    assert json.dumps(index.read_index(spark, folder, "k").stats.first().asDict()) == '{"n": 2, "avgdl": 2.0}'
