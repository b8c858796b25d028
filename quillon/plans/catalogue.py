"""Name -> query and name -> SQL over the driver tables; each name is one operator or a small family of SURVEY §2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.functions import clock, text as tx
from quillon.operators import facts as fx, graphs, inference, integrity, measures, novelty, packing, policies, ranking
from quillon.plans.tables import CHAIN, FACTS_SQL, GOLD_SQL, ORDER, TOKENS_SQL, facts, gold, lexical, table
from quillon.sources.index import cut
from quillon.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def seconds(c) -> "F.Column":
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


# --- Ranking -------------------------------------------------------------------------------------------------------

RANKED_SQL = "SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k}"
BM25_SQL = "scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * {dl} / avgdl))), 6) AS score FROM qt JOIN posts USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')} {RANKED_SQL.format(k=5)}")
def bm25_topk(spark, sf):
    asked, posts = lexical(spark, sf)
    return ranking.bm25_top(asked, posts, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


def _top5(spark, sf):
    """bm25_topk, written: a few rows a query, which several branches of a plan read and tables meet without being exchanged."""
    return cut(bm25_topk(spark, sf), "top5")


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='least(dl, 3 * avgdl)')}, r AS ({RANKED_SQL.format(k=5)}), m AS (SELECT item_id, sum(idf) AS top10 FROM (SELECT item_id, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), term) AS i FROM qt LEFT JOIN df USING (term), st) WHERE i <= 10 GROUP BY 1) SELECT item_id, doc_id, rank, round(score / (2.2 * top10), 6) AS strength, round(score / (2.2 * top10), 6) >= 0.3 AS passes FROM r JOIN m USING (item_id)")
def bm25_capped_gate(spark, sf):
    """BM25 with lengths capped at three times the mean, over the most that the ten rarest terms could give; a gate at 0.3."""
    asked, posts = lexical(spark, sf)
    top = ranking.bm25_top(asked, posts, "item_id", "doc_id", 5, cap=3.0)
    df = F.coalesce("df", F.lit(0))
    weighted = ranking._one_row(asked.join(ranking.frequencies(posts), "term", "left"), ranking.statistics(posts, "doc_id")).select("item_id", F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)).alias("idf"), F.row_number().over(Window.partitionBy("item_id").orderBy(df, "term")).alias("i"))
    mass = weighted.where("i <= 10").groupBy("item_id").agg(F.sum("idf").alias("top10"))
    strength = F.round(F.col("score") / (2.2 * F.col("top10")), 6)
    return top.join(mass, "item_id").select("item_id", "doc_id", "rank", strength.alias("strength"), (strength >= 0.3).alias("passes"))


@query(f"WITH {TOKENS_SQL}, w AS (SELECT item_id, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf FROM qt LEFT JOIN df USING (term), st), mass AS (SELECT item_id, sum(idf) AS mass FROM w GROUP BY 1), scored AS (SELECT item_id, doc_id, round(sum(idf) / any_value(mass), 6) AS score FROM w JOIN posts USING (term) JOIN mass USING (item_id) GROUP BY ALL) {RANKED_SQL.format(k=5)}")
def idf_coverage(spark, sf):
    asked, posts = lexical(spark, sf)
    return ranking.idf_coverage_top(asked, posts, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


@query(f"WITH {TOKENS_SQL}, qtf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL), q AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS qw FROM qtf JOIN df USING (term), st), d AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS dw FROM posts JOIN df USING (term), st), qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qn FROM q GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum(dw * dw)) AS dn FROM d GROUP BY 1), scored AS (SELECT item_id, doc_id, round(sum(qw * dw) / any_value(qn * dn), 6) AS score FROM q JOIN d USING (term) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY ALL) {RANKED_SQL.format(k=5)}")
def tfidf_cosine(spark, sf):
    _, posts = lexical(spark, sf)
    asked = ranking.postings(table(spark, sf, "benchmark"), "item_id")
    return ranking.tfidf_top(asked, posts, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


JACCARD_SQL = "jn AS (SELECT item_id, doc_id, count(*) AS inter FROM qt JOIN posts USING (term) GROUP BY ALL), qs AS (SELECT item_id, count(*) AS qn FROM qt GROUP BY 1), ds AS (SELECT doc_id, count(*) AS dn FROM posts GROUP BY 1)"


@query(f"WITH {TOKENS_SQL}, {JACCARD_SQL}, scored AS (SELECT item_id, doc_id, round(inter / (qn + dn - inter), 6) AS score FROM jn JOIN qs USING (item_id) JOIN ds USING (doc_id)) {RANKED_SQL.format(k=5)}")
def jaccard_topk(spark, sf):
    asked, posts = lexical(spark, sf)
    return ranking.jaccard_top(asked, posts, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


_TWO_LISTS = f"{TOKENS_SQL}, {JACCARD_SQL}, {BM25_SQL.format(dl='dl')}, a AS ({RANKED_SQL.format(k=20)}), js AS (SELECT item_id, doc_id, round(inter / (qn + dn - inter), 6) AS score FROM jn JOIN qs USING (item_id) JOIN ds USING (doc_id)), b AS ({RANKED_SQL.format(k=20).replace('FROM scored', 'FROM js')})"


def _two_lists(spark, sf):
    asked, posts = lexical(spark, sf)
    return ranking.bm25_top(asked, posts, "item_id", "doc_id", 20), ranking.jaccard_top(asked, posts, "item_id", "doc_id", 20)


@query(f"WITH {_TWO_LISTS}, f AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank FROM a UNION ALL SELECT item_id, doc_id, rank FROM b) GROUP BY ALL) {RANKED_SQL.format(k=10).replace('FROM scored', 'FROM f')}")
def rrf_fusion(spark, sf):
    fused = ranking.reciprocal_rank_fusion(list(_two_lists(spark, sf)), "item_id", "doc_id")
    return ranking.top(fused, 10, "item_id", "doc_id").select("item_id", "doc_id", "score", "rank")


@query(f"WITH {_TWO_LISTS}, x AS (SELECT item_id, list(doc_id) AS l, min_by(doc_id, rank) AS t FROM a GROUP BY 1), y AS (SELECT item_id, list(doc_id) AS l, min_by(doc_id, rank) AS t FROM b GROUP BY 1), z AS (SELECT item_id, round(len(list_intersect(x.l, y.l)) / (len(x.l) + len(y.l) - len(list_intersect(x.l, y.l))), 6) AS jaccard, x.t = y.t AS same_top FROM x JOIN y USING (item_id)) SELECT *, jaccard >= 0.2 AND same_top AS answers FROM z")
def backend_agreement_gate(spark, sf):
    a, b = _two_lists(spark, sf)
    return ranking.agreement_gate(a, b, "item_id", "doc_id", 0.2)


DENSE_SQL = "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))), 6) + 0.0 AS score FROM q JOIN embeddings d ON {on}) SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5"


@query(DENSE_SQL.format(on="q.vec_id <> d.vec_id"))
def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ranking.dense_top(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 5)  # the stated query set, against all rows


@query(DENSE_SQL.format(on="q.vec_id > d.vec_id"))
def cosine_topk_earlier(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ranking.dense_top(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 5, earlier_only=True)


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=10)}), g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) SELECT item_id, doc_id, rank, g.doc_id IS NOT NULL AS late, row_number() OVER (PARTITION BY item_id ORDER BY g.doc_id IS NOT NULL, rank) AS new_rank FROM r LEFT JOIN g USING (doc_id)")
def rank_demotion(spark, sf):
    asked, posts = lexical(spark, sf)
    top = ranking.bm25_top(asked, posts, "item_id", "doc_id", 10)
    return ranking.demoted(top, table(spark, sf, "labels").where("quality = 0"), "item_id", "doc_id").select("item_id", "doc_id", "rank", "late", "new_rank")


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, t AS (SELECT item_id, max(score) AS score FROM scored GROUP BY 1) SELECT item_id, score, place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, item_id) AS place, count(*) OVER () AS n FROM t) WHERE place <= ceil(0.25 * n)")
def fire_set(spark, sf):
    asked, posts = lexical(spark, sf)
    best = cut(ranking.bm25_top(asked, posts, "item_id", "doc_id", 1).select("item_id", "score"), "best")  # a row a query, read for its order and for its places
    return ranking.fire_set(best, "item_id", 0.25).select("item_id", "score", "place")


@query(f"WITH {TOKENS_SQL} SELECT doc_id, term, tf, count(*) OVER (PARTITION BY term ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS df_before FROM posts")
def visible_document_counts(spark, sf):
    return ranking.visible_bm25_counts(lexical(spark, sf)[1].posts.select("doc_id", "term", "tf"), "doc_id", "doc_id")


_SEEN = "v AS (SELECT DISTINCT item_id, 20 * (item_id + 1) AS cutoff FROM benchmark), vn AS (SELECT item_id, cutoff, count(*) AS n, avg(dl) AS avgdl FROM v JOIN dl ON doc_id < cutoff GROUP BY ALL), vd AS (SELECT item_id, term, count(*) AS df FROM v JOIN qt USING (item_id) JOIN posts USING (term) WHERE doc_id < cutoff GROUP BY ALL)"


@query(f"WITH {TOKENS_SQL}, {_SEEN}, scored AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM vn JOIN vd USING (item_id) JOIN posts USING (term) JOIN dl USING (doc_id) WHERE doc_id < cutoff GROUP BY ALL) {RANKED_SQL.format(k=5)}")
def bm25_visible(spark, sf):
    """BM25 top 5 over the documents that came before each item, by the statistics of those documents alone: item i asks when 20 (i + 1) ids are out."""
    asked, index = lexical(spark, sf)
    timed = asked.withColumn("cutoff", 20 * (F.col("item_id") + 1))
    return ranking.visible_bm25_top(timed, index, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


# --- Measures ------------------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=5)}), {GOLD_SQL}, h AS (SELECT item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM r JOIN gold USING (item_id, doc_id) GROUP BY 1), s AS (SELECT item_id, count(*) AS gold FROM gold GROUP BY 1) SELECT item_id, CASE WHEN gold IS NOT NULL THEN round(coalesce(hits, 0) / gold, 6) END AS recall, CASE WHEN gold IS NOT NULL THEN round(coalesce(hits, 0) / 5, 6) END AS precision, CASE WHEN gold IS NOT NULL THEN round(coalesce(1 / first, 0), 6) END AS rr, CASE WHEN gold IS NOT NULL THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(gold, 5) AS INTEGER) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg, coalesce(hits, 0) AS hits FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN s USING (item_id) LEFT JOIN h USING (item_id)")
def retrieval_metrics(spark, sf):
    return measures.retrieval_scores(_top5(spark, sf), gold(spark, sf), table(spark, sf, "benchmark"), "item_id", "doc_id", 5)


@query("WITH r AS (SELECT lang, quality FROM documents JOIN labels USING (doc_id)) SELECT (SELECT round(avg(m), 6) FROM (SELECT avg(quality) AS m FROM r GROUP BY lang)) AS macro, (SELECT round(avg(quality), 6) FROM r) AS micro")
def metrics_macro_micro(spark, sf):
    return measures.macro_micro(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id"), "lang", "quality")


@query("SELECT lang, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(n_chars) AS BIGINT) AS chars, CASE WHEN sum(n_chars) <> 0 THEN round(1000 * sum(quality) / sum(n_chars), 6) END AS good_per_1k FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def ratio_of_sums(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("bigint").alias("good"), F.sum("n_chars").alias("chars"))
    return rows.withColumn("good_per_1k", F.round(measures.ratio(1000 * F.col("good"), F.col("chars")), 6))


_SCORED = "r AS (SELECT quality AS y, least(1.0, n_chars / 4000) AS s FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "source", "quality", "toxic", F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("s"), "n_chars")


@query(f"WITH {_SCORED}, b AS (SELECT least(9, floor(s * 10)) AS b, count(*) AS n, avg(s) AS ms, avg(y) AS my, sum((s - y) * (s - y)) AS e FROM r GROUP BY 1) SELECT round(sum(e) / sum(n), 6) AS brier, round(sum(abs(ms - my) * n) / sum(n), 6) AS ece FROM b")
def brier_ece(spark, sf):
    return measures.brier_ece(_scored(spark, sf), "s", "y")


@query(f"WITH {_SCORED} SELECT round(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM r p, r n WHERE p.y = 1 AND n.y = 0")
def auroc(spark, sf):
    return measures.auroc(_scored(spark, sf), "s", "y")


@query("WITH t AS (SELECT CAST(sum(quality * toxic) AS DOUBLE) a, CAST(sum(quality * (1 - toxic)) AS DOUBLE) b, CAST(sum((1 - quality) * toxic) AS DOUBLE) c, CAST(sum((1 - quality) * (1 - toxic)) AS DOUBLE) d FROM labels) SELECT round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 6) AS phi, round(((a + d) / (a + b + c + d) - ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d))) / (1 - ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d))), 6) AS kappa FROM t")
def phi_kappa(spark, sf):
    return measures.phi_kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("WITH c AS (SELECT lang, quality, count(*) AS o FROM documents JOIN labels USING (doc_id) GROUP BY ALL), e AS (SELECT o, sum(o) OVER (PARTITION BY lang) * sum(o) OVER (PARTITION BY quality) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM c) SELECT round(sum(o * o / e) - max(n), 6) AS chi2, (SELECT (count(DISTINCT lang) - 1) * (count(DISTINCT quality) - 1) FROM c) AS dof FROM e")
def chi_square(spark, sf):
    return measures.chi_square(_scored(spark, sf), "lang", "quality")


_MID = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"


@query(f"WITH r AS (SELECT {_MID.format(c='c_acctbal')} AS a, {_MID.format(c='n')} AS b FROM (SELECT c_acctbal, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer)) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman_midrank(spark, sf):
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_acctbal", F.coalesce("n", F.lit(0)).alias("n"))
    return measures.spearman(rows, "c_acctbal", "n")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(quantile_cont(value, 0.9), 6) AS linear, max(CASE WHEN i = greatest(1, ceil(round(0.9 * n, 9))) THEN value END) AS nearest_rank, max(CASE WHEN i = least(n, floor(round(0.9 * n, 9)) + 1) THEN value END) AS index_rule FROM r GROUP BY 1")
def percentile_rules(spark, sf):
    return measures.percentiles(table(spark, sf, "events"), "event_type", "value", 0.9)


_CURVE = f"{_SCORED}, g AS (SELECT s AS threshold, count(*) AS n, sum(1 - y) AS bad FROM r GROUP BY 1), curve AS (SELECT threshold, round(sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER (), 6) AS coverage, round(sum(bad) OVER (ORDER BY threshold DESC) / sum(n) OVER (ORDER BY threshold DESC), 6) AS risk FROM g)"


@query(f"WITH {_CURVE} SELECT * FROM curve")
def risk_coverage(spark, sf):
    return measures.risk_coverage(_scored(spark, sf).withColumn("wrong", F.col("y") == 0), "s", "wrong")


@query(f"WITH {_CURVE}, l AS (SELECT coverage, risk, lag(coverage) OVER (ORDER BY coverage) AS x0, lag(risk) OVER (ORDER BY coverage) AS y0 FROM curve) SELECT round(sum((coverage - x0) * (risk + y0) / 2), 6) AS area FROM l WHERE x0 IS NOT NULL")
def risk_coverage_area(spark, sf):
    return measures.area(risk_coverage(spark, sf), "coverage", "risk")


@query("WITH g AS (SELECT user_id, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS bn, sum(n * n) AS n2, sum(n * m) AS s, sum(n * m * m) AS s2, sum(n * v) AS w FROM g), u AS (SELECT (s2 - s * s / bn) / (k - 1) AS b, w / (bn - k) AS w, (bn - n2 / bn) / (k - 1) AS n0 FROM t) SELECT round(greatest(0.0, least(1.0, (b - w) / (b + (n0 - 1) * w))), 6) AS icc FROM u")
def intraclass_correlation(spark, sf):
    return measures.icc(table(spark, sf, "events"), "user_id", "value")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1")
def shannon_entropy(spark, sf):
    return measures.entropy(table(spark, sf, "events"), "user_id", "event_type")


@query("WITH k AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM documents), g AS (SELECT key, min(doc_id) AS doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS labels FROM k GROUP BY 1) SELECT d.doc_id, d.lang, d.source, labels FROM g JOIN documents d USING (doc_id)")
def first_wins_dedup(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2(tx.join_key(F.col("text")), 256).alias("digest"))
    return measures.first_wins(rows, F.col("digest"), ["doc_id"], "source").select("doc_id", "lang", "source", "labels")


@query("WITH r AS (SELECT event_id, user_id, value, list(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM events) SELECT event_id, CASE WHEN len(e) > 0 THEN round((len(list_filter(e, lambda x: x < value)) + len(list_filter(e, lambda x: x = value)) / 2) / len(e), 6) END AS percentile FROM r")
def expanding_percentile(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("channel"), F.struct("ts", "event_id").alias("o"), "value")
    return measures.expanding_percentile(rows, "channel", "o", "value").select("event_id", "percentile")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, grouping(o_orderstatus) + grouping(o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def nested_counts(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return rows.rollup("status", "priority").agg((F.grouping("status") + F.grouping("priority")).cast("bigint").alias("level"), F.count("*").alias("n"))


# --- Facts in time ---------------------------------------------------------------------------------------------------

NOON = "2024-01-15 12:00:00"
_LAST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY valid_from DESC, id DESC) AS version FROM ({src}) WHERE {where}) WHERE version = {n}"


def _now(at: str = NOON):
    return F.lit(at).cast("timestamp")


def _log(spark, sf):
    """Events as a log in which every event supersedes the one before it in its chain."""
    f = facts(spark, sf)
    return f.withColumn("supersedes", F.lag("id").over(Window.partitionBy(*CHAIN).orderBy(*ORDER)))


@query(f"SELECT id, user_id, event_type, value FROM (SELECT *, lead(id) OVER (PARTITION BY user_id, event_type ORDER BY valid_from, id) AS nxt FROM ({FACTS_SQL})) WHERE nxt IS NULL")
def active_view(spark, sf):
    return fx.active_view(_log(spark, sf)).select("id", "user_id", "event_type", "value")


@query(f"SELECT id, lead(id) OVER w AS successor, epoch_us(lead(valid_from) OVER w) AS valid_to, epoch_us(lead(recorded) OVER w) AS expired_at FROM ({FACTS_SQL}) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY valid_from, id)")
def derive_temporal_ends(spark, sf):
    return fx.with_successor(facts(spark, sf), CHAIN, ORDER).select("id", "successor", seconds("valid_to").alias("valid_to"), seconds("expired_at").alias("expired_at"))


@query(f"SELECT id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY valid_from DESC, id DESC) AS version FROM ({FACTS_SQL})")
def version_rank(spark, sf):
    return fx.version_rank(facts(spark, sf), CHAIN, ORDER).select("id", "version")


@query(_LAST.format(cols="id, user_id, event_type, value", src=FACTS_SQL, where="true", n=3))
def two_before_latest(spark, sf):
    return fx.nth_before_latest(facts(spark, sf), CHAIN, ORDER, 2).select("id", "user_id", "event_type", "value")


@query(_LAST.format(cols="id, user_id, event_type, value", src=FACTS_SQL, where=f"valid_from <= TIMESTAMP '{NOON}'", n=1))
def valid_at(spark, sf):
    return fx.valid_at(facts(spark, sf), _now(), CHAIN, ORDER).select("id", "user_id", "event_type", "value")


@query(_LAST.format(cols="id, user_id, event_type, value", src=FACTS_SQL, where=f"recorded <= TIMESTAMP '{NOON}'", n=1))
def as_known_at(spark, sf):
    return fx.as_known_at(facts(spark, sf), _now(), CHAIN, ORDER).select("id", "user_id", "event_type", "value")


@query(_LAST.format(cols="id, user_id, event_type, value", src=FACTS_SQL, where=f"recorded <= TIMESTAMP '{NOON}' AND valid_from <= TIMESTAMP '2024-01-10 00:00:00'", n=1))
def bitemporal(spark, sf):
    return fx.bitemporal(facts(spark, sf), _now("2024-01-10 00:00:00"), _now(), CHAIN, ORDER).select("id", "user_id", "event_type", "value")


@query("SELECT p.event_id, f.event_id AS fact_event_id, f.value AS fact_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') f ON p.user_id = f.user_id AND p.ts >= f.ts")
def as_of(spark, sf):
    events = table(spark, sf, "events")
    found = fx.as_of_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'view'").select("user_id", "event_id", "ts", "value"), ["user_id"], "ts", "ts", "event_id")
    return found.select("event_id", "fact_event_id", "fact_value")


@query(f"WITH f AS (SELECT *, lead(valid_from) OVER (PARTITION BY user_id, event_type ORDER BY valid_from, id) AS valid_to FROM ({FACTS_SQL})), s AS (SELECT event_id, user_id, ts AS low, ts + INTERVAL 6 HOUR AS high FROM events WHERE event_type = 'signup') SELECT s.event_id, f.id FROM f JOIN s USING (user_id) WHERE f.valid_to IS NOT NULL AND f.valid_from < s.high AND s.low < f.valid_to")
def interval_overlap(spark, sf):
    f = fx.with_successor(facts(spark, sf), CHAIN, ORDER).where("valid_to is not null").select("id", "user_id", "valid_from", "valid_to")
    spans = table(spark, sf, "events").where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("low"), (F.col("ts").cast("timestamp") + F.expr("interval 6 hours")).alias("high"))
    return fx.overlapping(f, spans, ["user_id"], 86400).select("event_id", "id")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 200")
def timeline(spark, sf):
    return fx.timeline(table(spark, sf, "events").withColumn("kind", F.col("event_type")), ["ts", "event_id"], 500, ("purchase", "signup")).select("event_id", "event_type", "value")


@query("WITH d AS (SELECT event_id, user_id, event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events) SELECT event_id, count(*) OVER w AS earlier, count(DISTINCT event_type) OVER w AS kinds FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def look_back_days(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
    seen = fx.within_days(rows, ["user_id"], "day", 7, "event_type")
    return seen.select("event_id", "earlier", F.size("kinds").cast("bigint").alias("kinds"))


@query(f"SELECT id FROM (SELECT *, lag(recorded) OVER (PARTITION BY user_id ORDER BY id) AS b FROM ({FACTS_SQL})) WHERE recorded < b")
def monotone_breaks(spark, sf):
    return fx.monotone_breaks(facts(spark, sf), ["user_id"], "id", "recorded").select("id")


@query("WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS low, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS high FROM events), m AS (SELECT *, max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s), g AS (SELECT *, sum(CASE WHEN r IS NULL OR low > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY low, high) AS run FROM m), t AS (SELECT user_id, run, min(low) AS a, max(high) AS b FROM g GROUP BY ALL) SELECT user_id, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS covered FROM t GROUP BY 1")
def span_coverage(spark, sf):
    low = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return fx.merged_spans(table(spark, sf, "events").select("user_id", low.alias("low"), (low + 3600).alias("high")), ["user_id"])


# --- Packing ---------------------------------------------------------------------------------------------------------

_PACK = f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=20)}), c AS (SELECT item_id, doc_id, rank, {{cost}} AS cost FROM r JOIN documents USING (doc_id)) SELECT item_id, doc_id, rank, CAST(spent AS BIGINT) AS spent FROM (SELECT *, sum(cost) OVER (PARTITION BY item_id ORDER BY rank) AS spent FROM c) WHERE spent <= {{budget}}"


def _ranked_docs(spark, sf):
    asked, posts = lexical(spark, sf)
    return cut(ranking.bm25_top(asked, posts, "item_id", "doc_id", 20), "top20").join(table(spark, sf, "documents").select("doc_id", "text", "n_chars"), "doc_id")


@query(_PACK.format(cost="n_chars", budget=8000))
def prefix_fill(spark, sf):
    return packing.prefix_fill(_ranked_docs(spark, sf), "item_id", "rank", "n_chars", 8000).select("item_id", "doc_id", "rank", "spent")


@query(_PACK.format(cost="strlen(text)", budget=8192))
def byte_prefix_pack(spark, sf):
    return packing.byte_prefix(_ranked_docs(spark, sf), "item_id", "rank", "text", 8192).select("item_id", "doc_id", "rank", "spent")


_COSTS = f"{TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=20)}), c AS (SELECT item_id, doc_id, rank, CAST(n_chars AS BIGINT) AS cost FROM r JOIN documents USING (doc_id))"


@query(f"WITH RECURSIVE {_COSTS}, f AS (SELECT DISTINCT item_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS spent, '' AS taken FROM c UNION ALL SELECT f.item_id, c.rank, CASE WHEN spent + cost <= 8000 THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= 8000 THEN CASE WHEN taken = '' THEN '' ELSE taken || ',' END || doc_id ELSE taken END FROM f JOIN c ON c.item_id = f.item_id AND c.rank = f.rank + 1) SELECT item_id, taken, spent FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC) = 1")
def skip_fill(spark, sf):
    filled = packing.skip_fill(_ranked_docs(spark, sf), "item_id", "rank", "doc_id", "n_chars", 8000)
    return filled.select("item_id", F.array_join(F.col("taken").cast("array<string>"), ",").alias("taken"), "spent")


@query(f"WITH {_COSTS}, l AS (SELECT item_id, max(l) AS l FROM (SELECT item_id, l, sum(least(cost, l)) AS s FROM c, range(0, 8001) t(l) GROUP BY ALL) WHERE s <= 8000 GROUP BY 1), g AS (SELECT *, 8000 - sum(least(cost, l)) OVER (PARTITION BY item_id) AS rest, row_number() OVER (PARTITION BY item_id, cost > l ORDER BY rank) AS turn FROM c JOIN l USING (item_id)) SELECT item_id, doc_id, rank, cost AS n_chars, CAST(least(cost, l) + CASE WHEN cost > l AND turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM g")
def fair_share(spark, sf):
    return packing.fair_share(_ranked_docs(spark, sf).select("item_id", "doc_id", "rank", "n_chars"), "item_id", "rank", "n_chars", 8000)


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, 100 * n / sum(n) OVER () AS e FROM s), f AS (SELECT *, floor(e) AS f, 100 - sum(floor(e)) OVER () AS l, row_number() OVER (ORDER BY round(floor(e) - e, 9), source) AS r FROM e) SELECT source, n, CAST(f + CASE WHEN r <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def quota_sample(spark, sf):
    return packing.quota_counts(table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")), "source", "n", 100)


@query("SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold, substr(sha256(concat_ws('|', doc_id, source)), 1, 12) AS stable FROM documents")
def hash_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fold_of(F.col("doc_id"), 5).cast("bigint").alias("fold"), tx.stable_hash(F.col("doc_id"), F.col("source")).alias("stable"))


# --- Inference -------------------------------------------------------------------------------------------------------

_ARMS = "p AS (SELECT x.o_custkey AS unit, x.v AS a, y.v AS b FROM (SELECT o_custkey, max(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) x JOIN (SELECT o_custkey, max(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) y USING (o_custkey))"


def _arms(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max((F.col("o_totalprice") > 200000).cast("int")).alias("v"))
    return inference.paired(rows.withColumnRenamed("o_custkey", "unit"), "unit", "o_orderstatus", "v", "F", "O")


@query(f"WITH {_ARMS}, t AS (SELECT sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS x, sum(CASE WHEN b > a THEN 1 ELSE 0 END) AS y FROM p) SELECT CAST(x AS BIGINT) AS a_only, CAST(y AS BIGINT) AS b_only, CASE WHEN x + y = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(x, y) AS BIGINT) + 1), lambda j: exp(lgamma(x + y + 1) - lgamma(j + 1) - lgamma(x + y - j + 1) + (x + y) * ln(0.5))))), 6) END AS p FROM t")
def mcnemar_exact(spark, sf):
    return inference.mcnemar(_arms(spark, sf))


@query(f"WITH {_ARMS}, t AS (SELECT count(*) AS n, avg(b - a) AS m, var_samp(b - a) AS v FROM p), u AS (SELECT n, m, CASE WHEN coalesce(v, 0) > 0 THEN sqrt(v / n) ELSE 1 / n END AS se FROM t), w AS (SELECT n, m, m - 1.96 * se AS l, m + 1.96 * se AS h FROM u) SELECT n, round(m, 6) AS diff, round(l, 6) AS low, round(h, 6) AS high, CASE WHEN l >= 0.05 THEN 'practical' WHEN l > 0 THEN 'positive' WHEN h < 0 THEN 'negative' WHEN l > -0.05 AND h < 0.05 THEN 'equivalent' ELSE 'inconclusive' END AS state FROM w")
def wald_state(spark, sf):
    return inference.wald(_arms(spark, sf), 0.05)


_WILSON = "(p + 3.8416 / (2 * n) {s} 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query(f"WITH t AS (SELECT lang, count(*) AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT lang, n, round({_WILSON.format(s='-')}, 6) AS low, round({_WILSON.format(s='+')}, 6) AS high FROM t")
def wilson(spark, sf):
    t = _scored(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("k")).withColumn("w", inference.wilson(F.col("k"), F.col("n")))
    return t.select("lang", "n", F.col("w.low").alias("low"), F.col("w.high").alias("high"))


@query("WITH t AS (SELECT event_type, 2 * exp(-abs(avg(value) - 50) / 5) / 2 AS p FROM events GROUP BY 1), r AS (SELECT event_type, p, row_number() OVER (ORDER BY p, event_type) AS rank, count(*) OVER () AS m FROM t), s AS (SELECT *, least(1.0, (m - rank + 1) * p) AS s FROM r), a AS (SELECT event_type, rank, round(max(s) OVER (ORDER BY p, event_type), 6) AS adjusted FROM s) SELECT event_type, rank, adjusted, adjusted <= 0.05 AS rejected FROM a")
def holm(spark, sf):
    t = table(spark, sf, "events").groupBy("event_type").agg((2 * F.exp(-F.abs(F.avg("value") - 50) / 5) / 2).alias("p"))
    return inference.holm(t, "event_type", "p").select("event_type", "rank", "adjusted", "rejected")


@query("SELECT o_custkey AS unit, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)) GROUP BY 1")
def complete_cases(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("unit"), "o_orderstatus")
    return inference.complete_cases(rows, "unit", "o_orderstatus").groupBy("unit").agg(F.count("*").alias("n"))


# --- Graphs ----------------------------------------------------------------------------------------------------------

_EDGES = "l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS support FROM l x JOIN l y USING (l_orderkey) WHERE x.l_partkey < y.l_partkey GROUP BY ALL), w AS (SELECT a, b, support FROM e UNION ALL SELECT b, a, support FROM e)"


def _edges(spark, sf):
    return graphs.shared_edges(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


def _seeds(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("q"), (F.col("s_suppkey") + 1).cast("bigint").alias("part"))


@query(f"WITH {_EDGES} SELECT * FROM e")
def cooccurrence_edges(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {_EDGES}, s AS (SELECT CAST(s_suppkey AS BIGINT) AS q, CAST(s_suppkey + 1 AS BIGINT) AS part FROM supplier) SELECT q, part, support, rank FROM (SELECT q, b AS part, support, row_number() OVER (PARTITION BY q ORDER BY support DESC, b) AS rank FROM (SELECT q, b, CAST(sum(support) AS BIGINT) AS support FROM s JOIN w ON s.part = w.a GROUP BY ALL) t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.q = t.q AND s.part = t.b)) WHERE rank <= 5")
def neighbour_rank(spark, sf):
    return graphs.neighbours(_seeds(spark, sf), _edges(spark, sf), "q", "part", 5)


@query(f"WITH {_EDGES}, s AS (SELECT CAST(s_suppkey AS BIGINT) AS q, CAST(s_suppkey + 1 AS BIGINT) AS part, 1.0 AS weight FROM supplier), t AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY support DESC, b) AS r FROM w) WHERE r <= 3), x AS (SELECT q, part, CAST(weight AS DOUBLE) AS weight FROM s UNION ALL SELECT q, b, weight * 0.5 FROM s JOIN t ON s.part = t.a) SELECT q, part, round(least(1.0, sum(weight)), 6) AS weight FROM x GROUP BY ALL")
def spread_activation(spark, sf):
    return graphs.spread(_seeds(spark, sf).withColumn("weight", F.lit(1.0)), _edges(spark, sf), "q", "part", 3, 0.5, 1.0)


@query("WITH RECURSIVE e AS (SELECT DISTINCT n_regionkey AS s, 100 + n_nationkey AS o FROM nation UNION SELECT DISTINCT 100 + s_nationkey, 1000 + s_suppkey FROM supplier), p AS (SELECT r_regionkey AS start, [CAST(r_regionkey AS BIGINT)] AS path, 0 AS hops FROM region UNION ALL SELECT start, list_append(path, CAST(o AS BIGINT)), hops + 1 FROM p JOIN e ON e.s = path[-1] WHERE hops < 2 AND NOT list_contains(path, CAST(o AS BIGINT))) SELECT CAST(start AS BIGINT) AS start, array_to_string(path, '>') AS path, hops FROM p WHERE hops > 0")
def multihop_paths(spark, sf):
    nations, suppliers = table(spark, sf, "nation"), table(spark, sf, "supplier")
    edges = nations.select(F.col("n_regionkey").cast("bigint").alias("s"), (100 + F.col("n_nationkey")).cast("bigint").alias("o")).unionByName(suppliers.select((100 + F.col("s_nationkey")).cast("bigint").alias("s"), (1000 + F.col("s_suppkey")).cast("bigint").alias("o")))
    starts = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("s"))
    found = graphs.paths(edges, starts, 2, 1 << 30)
    return found.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops")


# --- Streams and novelty -----------------------------------------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return streams.tumbling(_events(spark, sf), "ts", "1 hour", "event_type").withColumn("window_start", seconds("window_start"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(h AS INTEGER))) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 3) t(h) GROUP BY ALL")
def sliding(spark, sf):
    return streams.sliding(_events(spark, sf), "ts", "3 hours", "1 hour", "event_type").withColumn("window_start", seconds("window_start"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 4 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS session_end, count(*) AS n FROM r GROUP BY user_id, run")
def session_windows(spark, sf):
    return streams.sessions(_events(spark, sf), "ts", "4 hours", "user_id").withColumns({"session_start": seconds("session_start"), "session_end": seconds("session_end")})


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT id FROM (SELECT id, recorded, max(recorded) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ({FACTS_SQL})) WHERE recorded < r")
def late_rows(spark, sf):
    return streams.late_rows(facts(spark, sf), "user_id", "id", "recorded").select("id")


@query("SELECT q.user_id, q.event_id, (SELECT count(*) FROM events r WHERE r.user_id = q.user_id AND r.event_type = 'view' AND r.ts < q.ts) AS records FROM events q WHERE q.event_type = 'purchase'")
def prefix_counts(spark, sf):
    e = _events(spark, sf)
    return streams.prefix_counts(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id")


_STREAMS = "d AS (SELECT CAST('0x' || substr(sha256(coalesce(source, 'none')), 1, 8) AS BIGINT) AS stream, doc_id AS seq, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, doc_id * 37 % 101 AS value, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS draw, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS needed FROM documents WHERE text IS NOT NULL)"
_WEIGHTS = {"recent": "seq", "first": "-seq", "long": "words", "short": "-words", "value": "value", "low_value": "-value", "random": "draw", "dense": "value / greatest(1, words)", "oracle": "needed"}


def _retention_sql(policy: str) -> str | None:
    """The gate as a recursion over the rows of all streams at once: of what is held and the new row, the heaviest that fit stay."""
    if policy == "all":
        return f"WITH {_STREAMS} SELECT stream, seq, CAST(words AS BIGINT) AS words FROM d"
    if policy not in _WEIGHTS:
        return None
    fits = "list_filter(h, lambda x, i: list_sum(list_transform(h[1:i], lambda y: y.n)) <= floor(0.2 * seen + 1e-9))"
    return (
        f"WITH RECURSIVE {_STREAMS}, n AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) AS i, {{'w': CAST({_WEIGHTS[policy]} AS DOUBLE), 'q': seq, 'n': CAST(words AS BIGINT)}} AS x, sum(words) OVER (PARTITION BY stream ORDER BY seq) AS seen FROM d), "
        f"s AS (SELECT stream, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(w DOUBLE, q BIGINT, n BIGINT)[]) AS held FROM n WHERE i = 1 UNION ALL SELECT stream, i, {fits} FROM (SELECT s.stream, n.i, n.seen, list_reverse_sort(list_append(s.held, n.x)) AS h FROM s JOIN n ON n.stream = s.stream AND n.i = s.i + 1)), "
        "z AS (SELECT stream, unnest(held) AS x FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stream ORDER BY i DESC) = 1)) SELECT stream, x.q AS seq, x.n AS words FROM z"
    )


def _gate(policy):
    def run(spark, sf):
        hexed = lambda c, n: F.conv(F.substring(F.sha2(c, 256), 1, n), 16, 10).cast("bigint")
        docs = table(spark, sf, "documents").where("text is not null").select(hexed(F.coalesce("source", F.lit("none")), 8).alias("stream"), F.col("doc_id").alias("seq"), tx.word_count(F.col("text")).cast("bigint").alias("words"), (F.col("doc_id") * 37 % 101).alias("value"), hexed(F.col("doc_id").cast("string"), 12).alias("draw"), (F.col("doc_id") % 7).alias("topic"), (F.col("doc_id") % 4 == 0).cast("int").alias("needed"))
        return streams.retained(docs, policy, 0.2)

    run.__name__ = f"retention_{policy}"
    return run


for _policy in streams.POLICIES:
    query(_retention_sql(_policy))(_gate(_policy))


_CONV = "t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations), g AS (SELECT DISTINCT conv_id, turn, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM t WHERE len(w) >= 3)"


def _grams(spark, sf):
    return novelty.grams_of(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", 3)


@query(f"WITH {_CONV}, f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, gram) AS first FROM g) SELECT conv_id, turn, count(*) AS grams, round(avg(CASE WHEN turn = first THEN 1.0 ELSE 0.0 END), 6) AS novelty FROM f GROUP BY ALL")
def union_novelty(spark, sf):
    return novelty.union_novelty(_grams(spark, sf), "conv_id", "turn")


@query(f"WITH {_CONV}, n AS (SELECT conv_id, turn, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT a.conv_id, a.turn, b.turn AS t2, count(*) AS c FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.gram = b.gram AND b.turn < a.turn AND b.turn >= a.turn - 3 GROUP BY ALL), m AS (SELECT conv_id, turn, max(c) AS c FROM s GROUP BY ALL) SELECT conv_id, turn, round(coalesce(c, 0) / n, 6) AS repetition FROM n LEFT JOIN m USING (conv_id, turn)")
def ngram_repetition(spark, sf):
    return novelty.repetition(_grams(spark, sf), "conv_id", "turn", 3)


@query("WITH t AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM conversations) GROUP BY ALL), m AS (SELECT *, coalesce(sum(tf) OVER (PARTITION BY conv_id, term ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, row_number() OVER (PARTITION BY conv_id, term ORDER BY turn) = 1 AS f FROM t), i AS (SELECT conv_id, turn, sum(tf) AS dl, sum(CASE WHEN f THEN 1 ELSE 0 END) AS fresh FROM m GROUP BY ALL), x AS (SELECT conv_id, turn, coalesce(sum(dl) OVER w, 0) AS total, coalesce(sum(fresh) OVER w, 0) AS vocab FROM i WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, turn, round(sum(-ln((c + 1) / (total + vocab + 1)) * tf) / sum(tf), 6) AS surprisal FROM m JOIN x USING (conv_id, turn) GROUP BY ALL")
def unigram_surprisal_stream(spark, sf):
    tokens = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(tx.ascii_tokens(F.col("text"))).alias("term")).groupBy("conv_id", "turn", "term").agg(F.count("*").alias("tf"))
    return novelty.expanding_surprisal(tokens, "conv_id", "turn")


# --- Rules and policies --------------------------------------------------------------------------------------------------


@query(f"WITH f AS ({FACTS_SQL}) SELECT id, 'value-high' AS rule FROM f WHERE value > 95 UNION ALL SELECT id, 'recorded-late' FROM f WHERE recorded > valid_from + INTERVAL 170 MINUTE UNION ALL SELECT id, 'k-low' FROM f WHERE k < 3")
def integrity_violations(spark, sf):
    rules = {"value-high": F.col("value") > 95, "recorded-late": F.col("recorded") > F.col("valid_from") + F.expr("interval 170 minutes"), "k-low": F.col("k") < 3}
    return integrity.violations(facts(spark, sf), "id", rules)


@query("WITH p AS (SELECT DISTINCT doc_id FROM documents), d AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) SELECT doc_id, 'missing' AS status FROM p WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, 'extra' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM p) UNION ALL SELECT doc_id, 'repeated' FROM d WHERE n > 1")
def set_audit(spark, sf):
    return integrity.set_audit(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM (SELECT lower(term) IS NOT NULL AS x, bool_or(k = 'en') AS a, bool_or(k = 'de') AS b FROM (SELECT lang AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE lang IN ('en', 'de')) GROUP BY term, x)")
def split_overlap(spark, sf):
    docs = table(spark, sf, "documents")
    words = lambda lang: docs.where(F.col("lang") == lang).select(F.explode(tx.ascii_tokens(F.col("text"))).alias("term"))
    return integrity.split_overlap(words("en"), words("de"), "term")


_SPEC = {"OR": [{"lang": "de", "n_chars": {"gte": 500, "lt": 3000}}, {"NOT": [{"source": {"in": ["src0", "src1"]}}, {"lang": {"nin": ["en", "fr"]}}]}], "text": {"icontains": "TH"}}


@query("SELECT doc_id FROM documents WHERE ((lang = 'de' AND n_chars >= 500 AND n_chars < 3000) OR NOT (source IN ('src0', 'src1') OR lang NOT IN ('en', 'fr'))) AND contains(lower(text), 'th')")
def metadata_filter(spark, sf):
    return table(spark, sf, "documents").where(policies.metadata_filter(_SPEC)).select("doc_id")


_CONDITION = {"any": [{"all": [{"gt": [{"mul": ["quality", 2]}, 1]}, {"lt": [{"abs": {"sub": ["toxic", 1]}}, 0.5]}]}, {"not": {"ge": ["n_chars", 1500]}}]}


@query("SELECT doc_id, (quality * 2 > 1 AND abs(toxic - 1) < 0.5) OR NOT n_chars >= 1500 AS holds FROM documents LEFT JOIN labels USING (doc_id)")
def condition_language(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", policies.condition(_CONDITION).alias("holds"))


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'yes' ELSE 'no' END AS closed, CASE WHEN quality IS NOT NULL THEN 'yes' ELSE 'unknown' END AS open, CASE WHEN quality IS NOT NULL THEN 'yes' WHEN source = 'src0' THEN 'no' ELSE 'unknown' END AS certificate FROM documents LEFT JOIN labels USING (doc_id)")
def closure_policy(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    found, complete = F.col("quality").isNotNull(), F.col("source") == "src0"
    return rows.select("doc_id", *[policies.closure(found, complete, p).alias(p) for p in ("closed", "open", "certificate")])


_EVIDENCE = "e AS (SELECT user_id AS c, event_type AS need, CASE WHEN value >= 20 THEN 1 ELSE -1 END AS polarity, k % 10 > 0 AND value < 60 AS ok FROM (SELECT user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) ), n AS (SELECT DISTINCT u.user_id AS c, t.event_type AS need FROM events u, (SELECT DISTINCT event_type FROM events) t)"


def _evidence(spark, sf):
    f = facts(spark, sf)
    return f.select(F.col("user_id").alias("c"), F.col("event_type").alias("need"), F.when(F.col("value") >= 20, 1).otherwise(-1).alias("polarity"), (F.col("k") % 10 > 0).alias("current"), (F.col("value") < 60).alias("authorised"), F.col("id").alias("provenance"))


@query(f"WITH {_EVIDENCE}, s AS (SELECT n.c, n.need, coalesce(max(CASE WHEN ok AND polarity > 0 THEN 1 ELSE 0 END), 0) AS y, coalesce(max(CASE WHEN ok AND polarity < 0 THEN 1 ELSE 0 END), 0) AS x, coalesce(max(CASE WHEN NOT ok THEN 1 ELSE 0 END), 0) AS bad FROM n LEFT JOIN e USING (c, need) GROUP BY ALL), t AS (SELECT c, CAST(sum(CASE WHEN y + x + bad = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(x) AS BIGINT) AS contradicted, CAST(sum(CASE WHEN y + x = 0 AND bad = 1 THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM s GROUP BY 1) SELECT *, CASE WHEN contradicted > 0 THEN 'reject' WHEN missing + invalid > 0 THEN 'ask' ELSE 'accept' END AS action FROM t")
def obligation_state(spark, sf):
    e = _evidence(spark, sf)
    needs = e.select("need").distinct()
    return policies.obligations(e, e.select("c").distinct().crossJoin(F.broadcast(needs)), "c", "need")  # the needs are a fixed list of kinds


@query(f"WITH {_EVIDENCE} SELECT c, CAST(sum(CASE WHEN polarity > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positives, CAST(sum(CASE WHEN polarity < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives, sum(CASE WHEN polarity > 0 THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN polarity < 0 THEN 1 ELSE 0 END) > 0 AS conflict FROM e WHERE ok GROUP BY 1")
def record_polarity(spark, sf):
    return policies.polarity(_evidence(spark, sf), "c")


# --- Text and time -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens, CAST(ceil(length(text) / 4) AS BIGINT) AS estimate, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key FROM documents")
def text_measures(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.word_count(t).cast("bigint").alias("words"), F.size(tx.ascii_tokens(t)).cast("bigint").alias("tokens"), tx.token_estimate(t).alias("estimate"), F.sha2(tx.join_key(t), 256).alias("key"))


@query("WITH d AS (SELECT event_id, epoch(ts - TIMESTAMP '2024-01-01') AS s FROM events) SELECT event_id, CAST(floor(s / 60) AS BIGINT) AS minute, CAST(floor(floor(s / 60) / 1440) AS BIGINT) AS day, CASE WHEN floor(floor(s / 60) / 1440) < 1 THEN 0 WHEN floor(floor(s / 60) / 1440) < 4 THEN 1 WHEN floor(floor(s / 60) / 1440) < 15 THEN 2 WHEN floor(floor(s / 60) / 1440) < 61 THEN 3 WHEN floor(floor(s / 60) / 1440) < 181 THEN 4 ELSE 5 END AS delay FROM d")
def minute_clock(spark, sf):
    minutes = clock.minute_of(F.col("ts"), "2024-01-01 00:00:00")
    rows = _events(spark, sf).withColumn("minute", minutes.cast("bigint"))
    day = clock.day_of(F.col("minute")).cast("bigint")
    return rows.select("event_id", "minute", day.alias("day"), clock.delay_bin(day).alias("delay"))
