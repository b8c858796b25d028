"""Further queries: controls, calibrations and profiles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillon.functions import text as tx
from quillon.operators import controls, graphs, ranking
from quillon.plans.catalogue import BM25_SQL, RANKED_SQL, _arms, _edges, _events, _scored, _EDGES, _top5, query, session_windows  # noqa: F401
from quillon.plans.tables import GOLD_SQL, TOKENS_SQL, gold, lexical, table
from quillon.sources.index import open_index


@query(f"WITH {TOKENS_SQL}, nn AS (SELECT count(DISTINCT doc_id) AS n FROM posts), scored AS (SELECT item_id, doc_id, round(sum(ln((nn.n + 1) / (df + 1)) + 1), 6) AS score FROM qt JOIN posts USING (term) JOIN df USING (term), nn GROUP BY ALL) {RANKED_SQL.format(k=5)}")
def term_scorer(spark, sf):
    asked, posts = lexical(spark, sf)
    return controls.term_scorer(asked, posts, "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


_HEAD = "ht AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL), hl AS (SELECT doc_id, sum(tf) AS dl FROM ht GROUP BY 1), hs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM hl), hf AS (SELECT term, count(*) AS df FROM ht GROUP BY 1)"


@query(f"WITH {TOKENS_SQL}, {_HEAD}, {BM25_SQL.format(dl='dl').replace('scored AS', 'body AS')}, head AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN ht USING (term) JOIN hf USING (term) JOIN hl USING (doc_id), hs GROUP BY ALL), scored AS (SELECT item_id, doc_id, round(sum(s), 6) AS score FROM (SELECT item_id, doc_id, 4.0 * score AS s FROM head UNION ALL SELECT item_id, doc_id, score FROM body) GROUP BY ALL) {RANKED_SQL.format(k=5)}")
def fts_weighted(spark, sf):
    """BM25 over two fields: a document's first line (its title, weight 4) and its whole text (weight 1)."""
    asked, posts = lexical(spark, sf)
    titles = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"))
    opening = open_index(titles, "doc_id", name="titles", ranges=posts.ranges)
    return ranking.bm25_fields_top(asked, [(opening, 4.0), (posts, 1.0)], "item_id", "doc_id", 5).select("item_id", "doc_id", "score", "rank")


@query("WITH q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{2,}'))) AS name FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{2,}'))) AS name FROM documents), r AS (SELECT name FROM d GROUP BY 1 HAVING count(*) <= 3) SELECT item_id, doc_id, count(*) AS hits FROM d JOIN r USING (name) JOIN q USING (name) GROUP BY ALL")
def name_channel(spark, sf):
    return controls.rare_name_hits(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", 3)


@query("WITH k AS (SELECT DISTINCT user_id, event_type AS v FROM events), c AS (SELECT e.event_id, k.v, count(*) FILTER (WHERE p.event_type = k.v) AS c FROM events e JOIN k USING (user_id) LEFT JOIN events p ON p.user_id = e.user_id AND p.event_id < e.event_id GROUP BY ALL) SELECT event_id, CASE WHEN max(c) > 0 THEN arg_min(v, (-c, v)) END AS guess FROM c GROUP BY 1")
def mode_so_far(spark, sf):
    return controls.mode_so_far(table(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type", "event_id")


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=5)}), {GOLD_SQL}, h AS (SELECT g.item_id, min(rank) AS r FROM gold g LEFT JOIN r USING (item_id, doc_id) GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM h")
def self_retrieval(spark, sf):
    return controls.self_retrieval(_top5(spark, sf), gold(spark, sf), "item_id", "doc_id")


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, t AS (SELECT item_id, max(score) AS score FROM scored GROUP BY 1), c AS (SELECT quantile_disc(score, 0.75) AS threshold FROM t) SELECT threshold, CAST(sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS fires FROM t, c GROUP BY 1")
def threshold_calibration(spark, sf):
    asked, posts = lexical(spark, sf)
    best = ranking.bm25_top(asked, posts, "item_id", "doc_id", 1).select("item_id", "score")
    return controls.firing_threshold(best, "score", 0.25)


@query("WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS days, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, min(n) AS least, max(n) AS most, (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM events GROUP BY props)) AS repeats FROM d")
def cadence_profile(spark, sf):
    return controls.cadence(_events(spark, sf), F.col("ts").cast("date"), "props")


@query("WITH j AS (SELECT o_custkey AS task, o_orderstatus AS o, CASE WHEN o_totalprice > 160000 THEN 1.0 WHEN o_totalprice > 150000 THEN 0.5 ELSE 0.0 END AS p FROM orders), e AS (SELECT task, o, avg(p) AS p FROM j GROUP BY ALL) SELECT task, round(avg(p), 6) AS rate FROM e GROUP BY 1")
def pairwise_win_rates(spark, sf):
    winner = F.when(F.col("o_totalprice") > 160000, "a").when(F.col("o_totalprice") > 150000, "tie").otherwise("b")
    return controls.win_rates(table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("order"), winner.alias("winner")), "task")


@query("WITH g AS (SELECT source, count(*) AS n, sum(quality) AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, sum(k) OVER () / sum(n) OVER () AS p FROM g) SELECT round(sum((k - n * p) * (k - n * p) / (n * p * (1 - p))) / (count(*) - 1), 6) AS d FROM p")
def over_dispersion(spark, sf):
    return controls.over_dispersion(_scored(spark, sf), "source", "quality")


@query("WITH c AS (SELECT o_custkey AS u, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY ALL), s AS (SELECT *, sum(c) OVER (PARTITION BY u) AS m FROM c), t AS (SELECT * FROM s WHERE m > 1), o AS (SELECT sum(c) AS n, sum(c * (c - 1) / (m - 1)) AS same FROM t), e AS (SELECT sum(v * (v - 1)) AS e FROM (SELECT sum(c) AS v FROM t GROUP BY t.v)) SELECT round(1 - (1 - same / n) / (1 - e / (n * (n - 1))), 6) AS alpha FROM o, e")
def krippendorff_alpha(spark, sf):
    return controls.krippendorff(table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("WITH t AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS na, count(*) FILTER (WHERE event_type = 'purchase') AS nb, avg(value) FILTER (WHERE event_type = 'view') AS ma, avg(value) FILTER (WHERE event_type = 'purchase') AS mb, var_samp(value) FILTER (WHERE event_type = 'view') AS va, var_samp(value) FILTER (WHERE event_type = 'purchase') AS vb FROM events) SELECT round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS d FROM t")
def cohen_d(spark, sf):
    return controls.effect(table(spark, sf, "events"), "event_type", "value", "view", "purchase")


@query("WITH r AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS cost FROM events WHERE event_type IN ('error', 'click')) SELECT user_id, round(sum(cost), 4) AS total, count(*) AS rows, CASE WHEN count(cost) = count(*) THEN 'known' WHEN count(cost) > 0 THEN 'lower bound' ELSE 'unobserved' END AS state FROM r GROUP BY 1")
def cost_totals(spark, sf):
    rows = table(spark, sf, "events").where("event_type in ('error', 'click')").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("cost"))
    return controls.known_cost(rows, "user_id", "cost")


@query(f"WITH {_EDGES} SELECT a, b, support, CAST(CAST('0x' || substr(sha256(concat_ws('|', CAST(a AS VARCHAR), CAST(b AS VARCHAR))), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM e")
def edge_folds(spark, sf):
    return graphs.fold_edges(_edges(spark, sf), 5)


@query("SELECT user_id, round(regr_slope(value, epoch(ts - TIMESTAMP '2024-01-01') / 86400), 6) AS slope, count(*) AS n FROM events GROUP BY 1")
def linear_fit(spark, sf):
    days = (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 86_400_000_000
    return _events(spark, sf).groupBy("user_id").agg(F.round(F.regr_slope("value", days), 6).alias("slope"), F.count("*").alias("n"))


@query("WITH f AS (SELECT DISTINCT user_id, first_value(value) OVER w AS early, last_value(value) OVER w AS final FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT user_id, early, final, final >= early AS rose FROM f")
def early_and_final(spark, sf):
    order = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", order).alias("early"), F.max_by("value", order).alias("final")).withColumn("rose", F.col("final") >= F.col("early"))


@query("SELECT user_id, event_id, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def recency_arm(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").select("user_id", "event_id", "value", "event_type")


@query("SELECT doc_id, substr(sha256(concat('7|', CAST(doc_id AS VARCHAR))), 1, 16) AS draw, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('7|', CAST(doc_id AS VARCHAR)))) AS place FROM documents")
def seeded_order(spark, sf):
    draw = F.sha2(F.concat(F.lit("7|"), F.col("doc_id").cast("string")), 256)
    return table(spark, sf, "documents").select("doc_id", F.substring(draw, 1, 16).alias("draw"), F.row_number().over(Window.partitionBy("source").orderBy(draw)).alias("place"))


@query("SELECT doc_id, length(text) AS size, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\\.[A-Za-z0-9_-]+)+', '<mail>', 'g'), '[0-9]', '#', 'g')) AS masked FROM documents")
def masked_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("size"), F.sha2(tx.masked(F.col("text")), 256).alias("masked"))


@query("SELECT doc_id, 0 AS gap, length(text) AS chars, strlen(text) AS bytes FROM documents WHERE length(text) > 0")
def text_windows(spark, sf):
    """What the windows of each text cover, as sums: no gap, all characters, all bytes."""
    windows = controls.text_windows(table(spark, sf, "documents"), "doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("window")
    gap = F.greatest(F.lit(0), F.col("char_start") - F.coalesce(F.lag("char_end").over(w), F.lit(0)))
    return windows.withColumn("g", gap).groupBy("doc_id").agg(F.sum("g").alias("gap"), F.max("char_end").alias("chars"), F.max("byte_end").alias("bytes"))


@query()
def vocabulary_scan(spark, sf):
    return controls.vocabulary_scan(table(spark, sf, "documents"), "doc_id", "text", {"the": "article", "of the": "of", "und": "and", "que": "that", "es": "is"})
