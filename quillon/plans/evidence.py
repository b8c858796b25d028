"""Queries over evidence: lookups, visibility, anchors, addresses, plans over facts, candidate pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions import parse, text as tx
from quillon.operators import evidence as ev, facts as fx, ranking
from quillon.plans.catalogue import _TWO_LISTS, BM25_SQL, CHAIN, NOON, ORDER, RANKED_SQL, _log, _now, _two_lists, _top5, cosine_topk_earlier, query
from quillon.plans.tables import FACTS_SQL, GOLD_SQL, TOKENS_SQL, facts, gold, lexical, table

_CHAINED = f"(SELECT *, lead(id) OVER (PARTITION BY user_id, event_type ORDER BY valid_from, id) AS nxt, lead(valid_from) OVER (PARTITION BY user_id, event_type ORDER BY valid_from, id) AS valid_to FROM ({FACTS_SQL}))"
_TOP5 = f"{TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=5)})"


@query(f"SELECT id, value, nxt IS NULL AS is_active FROM {_CHAINED} WHERE id IN (SELECT event_id FROM events WHERE event_type = 'signup')")
def point_lookup(spark, sf):
    asked = table(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"))
    return ev.lookup(_log(spark, sf), asked, "id", "supersedes").select("id", "value", "is_active")


@query(f"SELECT c.event_id, count(f.id) AS candidates FROM (SELECT * FROM events WHERE event_type = 'purchase') c LEFT JOIN {_CHAINED} f ON f.user_id = c.user_id AND f.valid_from < c.ts AND (f.valid_to IS NULL OR f.valid_to > c.ts) GROUP BY 1")
def candidate_visibility(spark, sf):
    calls = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.visible_counts(calls, fx.with_successor(facts(spark, sf), CHAIN, ORDER), "user_id", "event_id", "ts", "valid_from", "valid_to")


@query(f"WITH {_TOP5} SELECT item_id, doc_id, rank FROM r WHERE doc_id IN (SELECT doc_id FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) USING (doc_id) WHERE coalesce(q, 1) = 1 AND n_chars >= 200)")
def trusted_valid_filter(spark, sf):
    trust = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    records = table(spark, sf, "documents").select("doc_id", "n_chars").join(trust, "doc_id", "left")
    return ev.trusted_valid(_top5(spark, sf), records, "doc_id", F.coalesce("q", F.lit(1)) == 1, F.col("n_chars") >= 200).select("item_id", "doc_id", "rank")


@query(f"WITH {_TOP5} SELECT item_id, doc_id, rank FROM r WHERE item_id % 4 <> doc_id % 4 AND CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 <> 0")
def leakage_filter(spark, sf):
    held = table(spark, sf, "documents").where(tx.fold_of(F.col("doc_id"), 5) == 0).select("doc_id")
    return ev.without_held_out(_top5(spark, sf), held, "doc_id", F.col("item_id") % 4 == F.col("doc_id") % 4).select("item_id", "doc_id", "rank")


@query("WITH n AS (SELECT DISTINCT lower(name) AS name FROM (SELECT regexp_extract(text, '^[A-Za-z]+') AS name FROM benchmark UNION ALL SELECT regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+') FROM benchmark) WHERE name <> ''), t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), p AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, unnest(t) AS name FROM t UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t)) JOIN n USING (name)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS i FROM p) SELECT doc_id, string_agg(name, ',' ORDER BY i) AS anchors FROM r WHERE i <= 16 GROUP BY 1")
def anchor_match(spark, sf):
    first = lambda p: table(spark, sf, "benchmark").select(F.regexp_extract("text", p, 0).alias("name")).where("name <> ''")
    return ev.anchors(table(spark, sf, "documents"), first("^[A-Za-z]+").unionByName(first("^[A-Za-z]+ [A-Za-z]+")), "doc_id", "name")


_PRIVATE = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {k}" for k, p in ev.PRIVATE.items())


@query(f"SELECT * FROM (SELECT doc_id, {_PRIVATE} FROM documents) WHERE {' OR '.join(f'{k} > 0' for k in ev.PRIVATE)}")
def privacy_scan(spark, sf):
    return ev.private_parts(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH {_TOP5}, q AS (SELECT item_id, list(term) AS q FROM qt GROUP BY 1), x AS (SELECT item_id, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t, q FROM r JOIN documents USING (doc_id) JOIN q USING (item_id) WHERE rank = 1), y AS (SELECT *, list_transform(range(1, greatest(len(t) - 24 + 1, 1) + 1), lambda i: len(list_filter(t[i:i + 23], lambda w: list_contains(q, w)))) AS n FROM x), z AS (SELECT *, list_position(n, list_max(n)) AS i FROM y) SELECT item_id, doc_id, array_to_string(list_transform(t[i:i + 23], lambda w: CASE WHEN list_contains(q, w) THEN '[' || w || ']' ELSE w END), ' ') AS snippet, CAST(list_max(n) AS BIGINT) AS hits FROM z")
def snippet_extraction(spark, sf):
    terms = lexical(spark, sf)[0].groupBy("item_id").agg(F.collect_set("term").alias("q"))
    pairs = _top5(spark, sf).where("rank = 1").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(terms, "item_id")
    return ev.snippets(pairs, "item_id", "doc_id", "text", "q")


@query("SELECT item_id, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda x: '\"' || x || '\"'), ' OR ') END AS asked FROM (SELECT item_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS t FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a FROM benchmark))")
def match_query(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", ev.match_query(F.col("text")).alias("asked"))


@query(f"WITH {TOKENS_SQL}, g AS (SELECT DISTINCT term AS token, term || 's' AS term FROM df WHERE df >= 2), m AS (SELECT item_id, g.term, true AS added FROM qt JOIN g ON g.token = qt.term UNION ALL SELECT item_id, term, false FROM qt) SELECT item_id, term, bool_and(added) AS added FROM m GROUP BY 1, 2")
def glossary_expansion(spark, sf):
    asked, index = lexical(spark, sf)
    glossary = index.terms.where("df >= 2").select(F.col("term").alias("token"), F.concat("term", F.lit("s")).alias("term"))
    return ev.expanded(asked, glossary, "item_id")


_SKIP = "t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), f AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(t) AS term FROM t UNION ALL SELECT item_id, t[i] || ' ' || t[i + d] FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS i FROM t), range(1, 3) x(d) WHERE i + d <= len(t)) GROUP BY ALL)"


@query(f"WITH {_SKIP}, df AS (SELECT term, count(*) AS df FROM f GROUP BY 1), n AS (SELECT count(DISTINCT item_id) AS n FROM f), w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM f JOIN df USING (term), n), l AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1), s AS (SELECT a.item_id, b.item_id AS other, round(sum(a.w * b.w) / any_value(x.l * y.l), 6) AS score FROM w a JOIN w b ON a.term = b.term AND a.item_id <> b.item_id JOIN l x ON x.item_id = a.item_id JOIN l y ON y.item_id = b.item_id GROUP BY ALL) SELECT item_id, other, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other) AS k FROM s) WHERE k = 1")
def skip_bigram_similarity(spark, sf):
    grams = ev.skip_bigrams(table(spark, sf, "benchmark"), "item_id", "text")
    scored = ranking.tfidf_cosine(grams, grams.withColumnRenamed("item_id", "other"), "item_id", "other").where("item_id <> other")
    return ranking.top(scored, 1, "item_id", "other").select("item_id", "other", "score")


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN regexp_matches(lower(text), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{s}{chr(39)}' for s, p in parse.SLOTS)} ELSE 'none' END AS slot FROM documents WHERE text IS NOT NULL")
def slot_inference(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", parse.slot(F.col("text")).alias("slot"))


@query(f"SELECT user_id, event_type, id, place, n > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY recorded DESC, id DESC) AS place, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM ({FACTS_SQL}) WHERE recorded <= TIMESTAMP '{NOON}') WHERE place <= 5")
def address_recall(spark, sf):
    return ev.recalled(facts(spark, sf), "user_id", ["event_type"], "recorded", "id", _now(), 5).select("user_id", "event_type", "id", "place", "truncated")


@query(f"SELECT DISTINCT user_id, event_type FROM ({FACTS_SQL}) WHERE recorded <= TIMESTAMP '{NOON}'")
def visible_catalog(spark, sf):
    return ev.catalog(facts(spark, sf), "user_id", "event_type", "recorded", _now())


@query(f"WITH {GOLD_SQL}, p AS (SELECT item_id, doc_id, d.text, CASE WHEN item_id % 3 = 0 THEN substr(b.text, 1, 20) WHEN item_id % 3 = 1 THEN upper(substr(b.text, 1, 20)) ELSE 'no such words 0' END AS span FROM gold JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)) SELECT item_id, doc_id, CASE WHEN instr(text, span) > 0 THEN span WHEN instr(lower(text), lower(span)) > 0 THEN substr(text, instr(lower(text), lower(span)), length(span)) END AS actual, instr(lower(text), lower(span)) > 0 AS grounded FROM p")
def grounded_metadata(spark, sf):
    head = F.substring("passage", 1, 20)
    span = F.when(F.col("item_id") % 3 == 0, head).when(F.col("item_id") % 3 == 1, tx.upper_each(head)).otherwise("no such words 0")
    rows = gold(spark, sf).join(table(spark, sf, "benchmark").withColumnRenamed("text", "passage"), "item_id").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return ev.grounded(rows.withColumn("span", span), "text", "span").select("item_id", "doc_id", "actual", "grounded")


def _graph(spark, sf) -> DataFrame:
    """Orders, customers, nations and regions as facts (subject, predicate, object)."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edge = lambda t, a, p, b: table(spark, sf, t).select(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"))
    parts = [edge("orders", name("o", "o_orderkey"), "placed_by", name("c", "o_custkey")), edge("customer", name("c", "c_custkey"), "lives_in", name("n", "c_nationkey")), edge("supplier", name("s", "s_suppkey"), "based_in", name("n", "s_nationkey")), edge("nation", name("n", "n_nationkey"), "part_of", name("r", "n_regionkey"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_GRAPH_SQL = "g AS (SELECT 'o' || o_orderkey AS s, 'placed_by' AS p, 'c' || o_custkey AS o FROM orders UNION ALL SELECT 'c' || c_custkey, 'lives_in', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'based_in', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation)"


@query(f"WITH {_GRAPH_SQL}, a AS (SELECT DISTINCT x.o AS start, z.s AS a FROM (SELECT DISTINCT o FROM g WHERE p = 'lives_in') x JOIN g z ON z.p = 'based_in' AND z.o = x.o), st AS (SELECT DISTINCT 'c' || c_custkey AS start FROM customer), r AS (SELECT st.start, b.a FROM st LEFT JOIN g ON g.s = st.start AND g.p = 'lives_in' LEFT JOIN a b ON b.start = g.o) SELECT start, CASE count(DISTINCT a) WHEN 0 THEN 'none' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(string_agg(DISTINCT a, ',' ORDER BY a), '') AS answers FROM r GROUP BY 1")
def plan_execution(spark, sf):
    """Which suppliers are based where a customer lives: out along lives_in, in along based_in."""
    starts = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    return ev.execute_plan(_graph(spark, sf), starts, [("lives_in", "out"), ("based_in", "in")], branch_limit=None)


@query("""WITH RECURSIVE f AS (SELECT 'o' || o_orderkey AS subject, 'placed_by' AS predicate, 'c' || o_custkey AS object FROM orders UNION SELECT 'c' || c_custkey, 'lives_in', 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'based_in', 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation),
p AS (SELECT subject AS start, object AS at_, [subject, object] AS seen, predicate AS plan, 1 AS hops FROM f UNION ALL SELECT start, f.object, list_append(seen, f.object), plan || '>' || predicate, hops + 1 FROM p JOIN f ON f.subject = p.at_ WHERE hops < 6 AND NOT list_contains(seen, f.object))
SELECT DISTINCT start, plan, false AS truncated FROM p""")
def plan_enumeration(spark, sf):
    """The plans that lead somewhere from each order, customer, supplier and nation."""
    graph = _graph(spark, sf)
    return ev.plans_from(graph, graph.select(F.col("subject").alias("start")).distinct())


_NEXT = f"n AS (SELECT id AS src, nxt AS dst FROM {_CHAINED})"


@query(f"WITH RECURSIVE {_NEXT}, c AS (SELECT src AS start, src AS last, 0 AS hops FROM n UNION ALL SELECT start, n.dst, hops + 1 FROM c JOIN n ON n.src = c.last WHERE n.dst IS NOT NULL AND hops < 4) SELECT start, max_by(last, hops) AS last, CAST(max(hops) AS INTEGER) AS hops FROM c GROUP BY 1")
def follow_latest(spark, sf):
    chained = fx.with_successor(facts(spark, sf), CHAIN, ORDER)
    return ev.follow_latest(chained.where("successor is not null").select(F.col("id").alias("at"), F.col("successor").alias("next")), chained.select(F.col("id").alias("start")), 4)


@query(f"WITH h AS (SELECT id, user_id, nxt IS NULL AS latest, lag(nxt IS NULL) OVER (PARTITION BY user_id ORDER BY valid_from, id) AS before, value FROM {_CHAINED}) SELECT id, CASE WHEN user_id = 0 THEN 'NO_ANCHOR' WHEN before IS NULL THEN 'UNREACHABLE' WHEN before AND latest THEN 'CONSISTENT' WHEN NOT latest THEN 'SUPERSEDED_FINAL_HOP' ELSE 'SUPERSEDED_INTERMEDIATE_HOP' END AS class FROM h")
def path_consistency(spark, sf):
    """Paths of two hops, from a user's event to the next one; whether each is the latest of its chain."""
    rows = fx.with_successor(facts(spark, sf), CHAIN, ORDER).withColumn("latest", F.col("successor").isNull())
    rows = rows.withColumn("before", F.lag("latest").over(Window.partitionBy("user_id").orderBy("valid_from", "id")))
    return rows.select("id", ev.path_class(F.col("before").isNotNull(), F.array(F.coalesce("before", F.lit(False)), "latest"), F.col("user_id") != 0).alias("class"))


_HOP2 = f"{_TOP5}, q2 AS (SELECT DISTINCT item_id, term FROM r JOIN posts USING (doc_id) WHERE rank = 1), s2 AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q2 JOIN posts USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL), h2 AS ({RANKED_SQL.format(k=10).replace('FROM scored', 'FROM s2')}), u AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rank, doc_id) AS i FROM h2 WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.item_id = h2.item_id AND r.doc_id = h2.doc_id))"


@query(f"WITH {_HOP2} SELECT item_id, doc_id, rank, 1 AS hop FROM r UNION ALL SELECT item_id, u.doc_id, m + 1, 2 FROM u JOIN (SELECT item_id, max(rank) AS m FROM r GROUP BY 1) USING (item_id) WHERE i = 1")
def second_hop(spark, sf):
    index = lexical(spark, sf)[1]
    search = lambda terms: ranking.bm25_top(terms, index, "item_id", "doc_id", 10)
    return ev.second_hop(_top5(spark, sf), search, table(spark, sf, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query(f"WITH {_TOP5} SELECT item_id, lang, string_agg(DISTINCT source, ',' ORDER BY source) AS entities FROM r JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2")
def sibling_enumeration(spark, sf):
    context = _top5(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").where("source is not null")
    return ev.siblings(context, "item_id", "lang", "source")


_ANCHORED = f"{TOKENS_SQL}, an AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY df, term) AS i FROM qt JOIN df USING (term)) WHERE i <= 2), li AS (SELECT item_id, term AS anchor, 1 AS list, row_number() OVER (PARTITION BY item_id, term ORDER BY tf DESC, doc_id) AS rank, doc_id FROM an JOIN posts USING (term) UNION ALL SELECT item_id, term, 2, row_number() OVER (PARTITION BY item_id, term ORDER BY doc_id DESC), doc_id FROM an JOIN posts USING (term))"


@query(f"WITH {_ANCHORED}, w AS (SELECT *, row_number() OVER (PARTITION BY item_id, anchor ORDER BY rank, list, doc_id) AS p FROM li WHERE rank <= 4), o AS (SELECT item_id, doc_id, min(struct_pack(p := p, a := anchor)) AS spot FROM w GROUP BY 1, 2) SELECT item_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY spot, doc_id) AS place FROM o) WHERE place <= 16")
def interleaved_candidates(spark, sf):
    asked, index = lexical(spark, sf)
    rarest = Window.partitionBy("item_id").orderBy("df", "term")
    anchors = asked.join(index.terms, "term").withColumn("i", F.row_number().over(rarest)).where("i <= 2").select("item_id", F.col("term").alias("anchor"))
    hits = anchors.join(index.of(anchors.select(F.col("anchor").alias("term"))).select(F.col("term").alias("anchor"), "doc_id", "tf"), "anchor")
    by = lambda n, *order: hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "anchor").orderBy(*order))).where("rank <= 4").select("item_id", "anchor", F.lit(n).alias("list"), "rank", "doc_id")
    return ev.interleaved(by(1, F.col("tf").desc(), "doc_id").unionByName(by(2, F.col("doc_id").desc())), "item_id", "anchor", "doc_id")


@query(f"WITH {_TWO_LISTS}, p AS (SELECT item_id, doc_id, 'bm25' AS m FROM a WHERE rank <= 5 UNION ALL SELECT item_id, doc_id, 'jaccard' FROM b WHERE rank <= 5) SELECT item_id, doc_id, string_agg(DISTINCT m, ',' ORDER BY m) AS methods, count(DISTINCT m) < 2 AS decisive FROM p GROUP BY 1, 2")
def decisive_pool(spark, sf):
    bm25, jaccard = _two_lists(spark, sf)
    return ev.pool({"bm25": bm25, "jaccard": jaccard}, "item_id", "doc_id", 5)


@query("SELECT CAST(0 AS BIGINT) AS violations, 5 * (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0 AND vec_id >= 5) AS checked")
def causality_audit(spark, sf):
    ranked = cosine_topk_earlier(spark, sf)
    found = ev.look_ahead(ranked, "query", "doc").agg(F.count("*").alias("violations"))
    return found.crossJoin(ranked.where("query >= 5").agg(F.count("*").alias("checked")))  # one row each
