"""Language identification, fill-in-the-middle and the prefix trie against brute force, with nulls, empty and long texts, ties, repeated
rows, empty tables and other columns of clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillon.llm import langid, middle, trie

ODD = [None, "", " ", "\n", "\n\n", "a", "a\n", "é\n漢字😀\nz", "no <P> cut\nhere", "x" * 3000 + "\n" + "y", "tail\r\n\r\nend"]


def docs_of(spark, rows):
    """doc_id, text, lang and columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, content string, n int")


# --- 11: language identification ---

WORDS = {"aa": "bano bani benu kala kela kolu".split(), "bb": "trix strum blent krast norg drusp".split(), "cc": "шум дом лес рука нога".split()}


def lang_rows(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 30))), lang) for i in range(n) for lang in [rng.choice(["aa", "aa", "bb", "cc"])]]


def test_language_is_told_on_held_out_rows_and_odd_texts_have_defined_results(spark):
    rows = lang_rows(300) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 +-* 7", "cc"), (1003, "bano kela", None), (None, "trix drusp", None), (1003, "bano kela", None), (1004, "ქართული", None)]
    out = langid.identify(docs_of(spark, rows))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    told = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in out.collect()]
    assert len(told) == len(rows) and all(0 <= t[3] <= 1 for t in told)
    want = {r[0]: r[2] for r in rows[:300]}
    for i, held, pred, _ in told:
        assert held == (zlib.crc32(str("" if i is None else i).encode()) % 3 == 1)
        if i is not None and i < 300:
            assert pred == want[i]
    last = [t for t in told if t[0] is None or t[0] >= 1000]
    assert sorted((str(t[0]), t[2]) for t in last) == [("1000", "und"), ("1001", "und"), ("1002", "und"), ("1003", "aa"), ("1003", "aa"), ("1004", "aa"), ("None", "bb")]
    assert [t[3] for t in last if t[0] in (1000, 1001, 1002, 1004)] == [0.0] * 4


def test_nothing_to_learn_from(spark):
    assert langid.identify(docs_of(spark, [])).count() == 0
    rows = langid.identify(docs_of(spark, [(1, "some words", None), (2, None, None)])).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in rows} == {(1, "und", 0.0), (2, "und", 0.0)}


def brute_grams(text):
    out = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = "\0" + word + "\0"
        out += [padded[i : i + n] for n in range(2, 5) for i in range(len(padded) - n + 1)] + list(word)
    return out


def test_grams_are_those_of_words_with_borders():
    text = "Bano kela, x2y"
    points, offsets, has = langid.flattened([text])
    got = sorted(s for _, starts in langid.grams(points) for s in starts.tolist())
    # A border between two words serves both: the windows are told apart by where they begin.
    assert len(got) == len(brute_grams(text)) and has.tolist() == [True] and offsets.tolist() == [0, len(text) + 1]
    hashes, counts = langid.counted([text])
    assert counts.sum() == len(brute_grams(text)) and len(hashes) == len(set(brute_grams(text)))


def test_popcounts_are_those_of_sets_but_for_false_positives(spark):
    model = langid.fit(docs_of(spark, lang_rows(200)))
    learned = [r for r in lang_rows(200) if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    counts = {lang: {} for lang in WORDS}
    for _, text, lang in learned:
        for g in brute_grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    rate = lambda lang, g: counts[lang].get(g, 0) / totals[lang]
    having = {lang: {g for g, n in counts[lang].items() if n >= langid.LEAST and rate(lang, g) * langid.RATIO >= max(rate(o, g) for o in counts)} for lang in counts}
    texts = ["bano trix шум", "norg kolu", None, "zzz qqq"]
    found, total, _ = model.popcounts(texts)
    for i, t in enumerate(texts):
        grams = brute_grams(t or "")
        assert total[i] == len(grams)
        for j, lang in enumerate(model.languages):
            exact = sum(g in having[lang] for g in grams)
            assert exact <= found[i, j] <= exact + max(1, 0.2 * len(grams))  # never fewer: a filter forgets nothing


def test_more_than_64_languages_take_more_words():
    names = [f"l{j}" for j in range(70)]
    rows = np.zeros((2, 1 << 12), np.uint64)
    for j, word in ((3, "abcd"), (69, "wxyz")):
        for k in range(langid.HASHES):
            hashes, _ = langid.counted([word])
            rows[j // 64, langid.spots(hashes, k, rows.shape[1])] |= np.uint64(1) << np.uint64(j % 64)
    model = langid.Filter(names, rows)
    assert [t[0] for t in model.decide(["abcd abcd", "WXYZ"])] == ["l3", "l69"]


def test_long_texts_are_read_in_pieces(monkeypatch, spark):
    model = langid.fit(docs_of(spark, lang_rows(100)))
    texts = [" ".join(WORDS["bb"] * 40), "", None, " ".join(WORDS["aa"] * 70)]
    whole, hashes = model.popcounts(texts), langid.counted(texts)
    monkeypatch.setattr(langid, "PIECE", 17)
    assert all((a == b).all() for a, b in zip(whole, model.popcounts(texts)))
    assert all((a == b).all() for a, b in zip(hashes, langid.counted(texts)))


# --- 12: fill in the middle ---


def test_packed_lists_give_each_number_back():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 8, 9, 64, 500):
        for most in (n, 3 * n, 1000 * n):
            numbers = np.array(sorted(rng.choices(range(most + 1), k=n)), np.int64)
            packed = middle.pack(numbers, int(numbers[-1]))
            assert [middle.select(i, *packed) for i in range(n)] == numbers.tolist()
            assert len(packed[1]) + len(packed[2]) <= n * (2 + max(0, np.log2(max(1, most / n)))) / 8 + 3


def brute_cut(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, q = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{q}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{q}<M>{m}"


def test_cuts_are_those_of_units_and_texts_come_back(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é\n\n😀<P") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["same\ntext\n"] * 150
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "null id\nhere", "en"), (5, "a", None), (5, "a", None)]
    out = middle.transform(docs_of(spark, rows), carry=("lang",))
    got = out.select("doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output", middle.restored(out["form"], out["output"]).alias("back")).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(i, lang, *brute_cut(i, t), t or "") for i, t, lang in rows]
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_the_index_has_a_row_for_each_text_and_hot_texts_are_joined_in_parts(spark, monkeypatch):
    rows = [(i, "hot\ntext", "en") for i in range(200)] + [(1000 + i, f"own {i}\n", "en") for i in range(50)]
    index = {r["content"].hex(): r for r in map(lambda r: r.asDict(), middle.text_index(docs_of(spark, rows)).collect())}
    assert len(index) == 51 and sorted(r["copies"] for r in index.values()) == [1] * 50 + [200]
    assert set(index) == {hashlib.sha256(t.encode()).hexdigest() for _, t, _ in rows}
    assert middle.transform(docs_of(spark, rows)).count() == 250
    assert middle.transform(docs_of(spark, [])).count() == 0
    assert middle.transform(docs_of(spark, rows), rate=0).where("form <> 'plain'").count() == 0


# --- 13: the prefix trie ---


def brute_trie(convs):
    """convs: conv_id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        childless = lambda n: not any(len(x) == len(n) + 1 and x[: len(n)] == n for x in members)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(n) == len(node) + 1 for n in below), sum(childless(n) for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    plain = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = plain.get(c - c % 100, [])[:h] + turns[h:]
    return plain, out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 2)
    rng = random.Random(seed)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["user", None, ""]), rng.choice(["x", "yé", None, "", "longer text"])) for c in list(range(0, 60)) + [150, 151, 205, 100, 300, 301] for t in range(rng.randint(1, 6)) if c != 100 or t < 2]
    rows += [(None, 0, "user", "lost"), (7, 0, "user", "x"), (7, 0, "user", "x")] + [(400 + i, 0, "user", "hot") for i in range(1, 60)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, node string, depth int")
    key = lambda r: tuple(str(x) for x in r)
    plain, grafted = rebuilt(rows)
    got = trie.grafted_trie(table).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_trie(grafted)))
    assert sorted(map(key, trie.prefix_trie(trie.whole(trie.placed(table))).collect())) == sorted(map(key, brute_trie(plain)))


def test_empty_trie(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie.grafted_trie(table).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert trie.grafted_trie(lost).count() == 0
