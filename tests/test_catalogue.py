"""Every query of the catalogue against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import numpy as np
import pytest

from quillon.plans import added, audits, catalogue, deep, evidence, packs, studies  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(value):
    if value is None or str(value) in ("<NA>", "nan", "NaT"):
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, float, np.integer, np.floating)) or type(value).__name__ == "Decimal":
        return round(float(value), 9) + 0.0
    return value


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows_of(ours), rows_of(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(v == pytest.approx(w, abs=1.1e-6) if isinstance(v, float) and isinstance(w, float) else v == w for v, w in zip(x, y)), (x, y)


def test_retention_with_mentions_against_a_loop(spark, duck):
    from .test_added import loop_store

    stream = "CAST('0x' || substr(sha256(coalesce(source, 'none')), 1, 8) AS BIGINT)"
    rows = duck.execute(f"SELECT {stream}, doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')), doc_id * 37 % 101, 0, doc_id % 7, 0 FROM documents WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    want = set().union(*(loop_store([r for r in rows if r[0] == s], "mention", 0.2) for s in {r[0] for r in rows}))
    assert {(r["stream"], r["seq"]) for r in catalogue.QUERIES["retention_mention"](spark, DATA).collect()} == want


def test_vocabulary_scan_against_a_loop(spark, duck):
    import re

    aliases = {"the": "article", "of the": "of", "und": "and", "que": "that", "es": "is"}
    want = set()
    for doc, text in duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall():
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text)]
        i = 0
        while i < len(words):
            two = text[words[i][0] : words[i + 1][1]].lower() if i + 1 < len(words) else ""
            if two in aliases:
                want.add((doc, words[i][0], words[i + 1][1], aliases[two]))
                i += 2
                continue
            if words[i][2] in aliases:
                want.add((doc, words[i][0], words[i][1], aliases[words[i][2]]))
            i += 1
    assert {tuple(r) for r in catalogue.QUERIES["vocabulary_scan"](spark, DATA).collect()} == want


def test_leak_probe_is_a_chance(spark):
    rows = catalogue.QUERIES["leak_probe"](spark, DATA).collect()
    assert sorted(r["fold"] for r in rows) == [0, 1, 2] and all(0 <= r["auroc"] <= 1 for r in rows)


def test_every_query_has_sql_or_a_test_here():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == {"retention_mention", "vocabulary_scan", "leak_probe", "arm_memory", "window_search", "cosine_topk_inverted"}
