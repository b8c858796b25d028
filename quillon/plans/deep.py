"""Queries over matching, samples of deciles, exact draws, windows of texts and the inverted file."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import numeric, text as tx
from quillon.operators import audit, controls, evidence, graphs, packing, vectors, windows
from quillon.plans.catalogue import _EDGES, _edges, _scored, query
from quillon.plans.tables import table
from quillon.sources import index, logs, worlds

_PAIRS = """gt AS (SELECT item_id AS g, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), pt AS (SELECT doc_id AS p, lang, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents),
gx AS (SELECT g, len(t) AS n, unnest(t) AS x FROM gt), px AS (SELECT p, lang, len(t) AS n, unnest(t) AS x FROM pt),
e AS (SELECT lang, g, p, round(count(*) / (any_value(gx.n) + any_value(px.n) - count(*)), 6) AS o FROM gx JOIN px USING (x) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY o DESC, g, p) AS i FROM e)"""


@query(f"""WITH RECURSIVE {_PAIRS}, m AS (SELECT lang, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS g, CAST(NULL AS BIGINT) AS p, CAST(NULL AS DOUBLE) AS o, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ps FROM (SELECT DISTINCT lang FROM e)
UNION ALL SELECT * FROM (SELECT m.lang, o.i, o.g, o.p, o.o, list_append(gs, o.g), list_append(ps, o.p) FROM m JOIN o ON o.lang = m.lang AND o.i > m.i AND NOT list_contains(gs, o.g) AND NOT list_contains(ps, o.p) QUALIFY row_number() OVER (PARTITION BY m.lang ORDER BY o.i) = 1))
SELECT lang, g AS gold, p AS predicted, o AS overlap FROM m WHERE g IS NOT NULL""")
def one_to_one_match(spark, sf):
    """Benchmark items and documents of each language, matched one to one by their words, the most alike first."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("node"), tx.ascii_tokens(F.col("text")).alias("t"))
    docs = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("node"), tx.ascii_tokens(F.col("text")).alias("t"))
    asked = items.crossJoin(F.broadcast(docs.select("lang").distinct()))  # one row a language
    return audit.greedy_match(asked, docs, "lang", "node", "t")


@query("""WITH g AS (SELECT source AS g, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1), p AS (SELECT *, sum(k) OVER () / sum(n) OVER () AS p FROM g),
f AS (SELECT g, j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))) OVER (PARTITION BY g ORDER BY j) AS upto FROM (SELECT g, n, p, unnest(range(0, n)) AS j FROM p)),
u AS (SELECT g, draw, CAST(('0x' || substr(sha256(concat_ws('|', 29, draw, g)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM g, range(0, 500) t(draw)),
d AS (SELECT u.g, draw, count(f.j) AS k FROM u LEFT JOIN f ON f.g = u.g AND f.upto <= u.u GROUP BY ALL),
x AS (SELECT draw, sum((d.k - n * p) * (d.k - n * p) / (n * p * (1 - p))) AS x FROM d JOIN p USING (g) GROUP BY 1), s AS (SELECT sum((k - n * p) * (k - n * p) / (n * p * (1 - p))) AS x, count(*) AS groups FROM p)
SELECT round(s.x / (groups - 1), 6) AS d, groups, round((1 + (SELECT count(*) FROM x WHERE x.x >= s.x - 1e-9)) / 501, 6) AS p FROM s""")
def dispersion_draws(spark, sf):
    """Whether good documents vary more between sources than one binomial would, by exact draws."""
    return controls.dispersion_p(_scored(spark, sf), "source", "quality")


@query("""WITH r AS (SELECT doc_id, n_chars, CAST(floor((row_number() OVER (ORDER BY n_chars, doc_id) - 1) * 10 / count(*) OVER ()) AS INTEGER) AS bin FROM documents WHERE n_chars IS NOT NULL),
i AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY substr(sha256(concat_ws('|', 31, doc_id)), 1, 8), doc_id) AS i, CASE WHEN bin < 5 THEN 11 ELSE 10 END AS q FROM r)
SELECT doc_id, n_chars, bin, CAST(row_number() OVER (ORDER BY round((i - 0.5) / q, 9), bin) AS INTEGER) AS place FROM i WHERE i <= q""")
def decile_sample(spark, sf):
    """105 documents, spread evenly over the tenths of all lengths, in an order of which every prefix is spread too."""
    return packing.decile_sample(table(spark, sf, "documents"), "doc_id", "n_chars", 105)


@query()
def window_search(spark, sf):
    """The three best windows of documents for each benchmark item, with their text as the documents have it now. How windows are cut has no SQL; tests hold it
    against a loop."""
    docs = table(spark, sf, "documents")
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(tx.ascii_tokens(F.col("text"))).alias("term")).distinct()
    return windows.search_windows(asked, windows.window_index(docs, "doc_id"), docs, "item_id", 3)


@query()
def cosine_topk_inverted(spark, sf):
    """cosine_topk by an inverted file: approximate, so without SQL; tests measure its recall against cosine_topk."""
    rows = table(spark, sf, "embeddings")
    lists = max(1, int(rows.count() ** 0.5) // 2)
    found = vectors.inverted_file(rows, "vec_id", "embedding", lists)
    return vectors.inverted_top(rows.where("vec_id % 20 = 0"), found, "vec_id", "embedding", 5)  # the stated query set, against all rows




_NORMAL = "((" + " + ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) / 4294967296.0" for k in range(8)) + ") - 4) / sqrt(8 / 12)"


@query(f"""WITH n AS (SELECT event_type, value AS x, {_NORMAL} AS e FROM (SELECT event_type, value, sha256('37|' || event_id) AS h FROM events)),
s AS (SELECT event_type, var_pop(x) AS xx, covar_pop(x, e) AS xe, var_pop(e) AS ee FROM n GROUP BY 1),
q AS (SELECT event_type, xe * xe - 0.64 * xx * ee AS a, 2 * xx * xe * (1 - 0.64) AS b, xx * xx * (1 - 0.64) AS c FROM s)
SELECT event_type, round((-b - sqrt(b * b - 4 * a * c)) / (2 * a), 5) AS sigma, 0.8 AS correlation FROM q""")
def channel_noise(spark, sf):
    """The noise of each kind of event at which values are seen with a correlation of 0.8; the SQL solves the equation of second moments."""
    rows = table(spark, sf, "events")
    return controls.solved_noise(rows, "event_type", "value", numeric.hashed_normal(37, F.col("event_id")), 0.8)


_SPARSE = f"{_EDGES}, k AS (SELECT a, b, support, CAST('0x' || substr(sha256(least(a, b) || '|' || greatest(a, b)), 1, 8) AS BIGINT) % 5 AS fold FROM e WHERE support >= 2), v AS (SELECT a, b, support, fold FROM k UNION ALL SELECT b, a, support, fold FROM k)"


@query(f"""WITH {_SPARSE}, f AS (SELECT * FROM range(0, 5) t(fold)),
g AS (SELECT f.fold, x.a AS x, y.b AS y, sum(x.support * y.support) AS score FROM f, v x JOIN v y ON x.b = y.a WHERE x.a <> y.b AND x.fold <> f.fold AND y.fold <> f.fold GROUP BY ALL),
r AS (SELECT g.*, row_number() OVER (PARTITION BY g.x, g.fold ORDER BY score DESC, g.y) AS rank FROM g WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.a = g.x AND v.b = g.y AND v.fold <> g.fold)),
h AS (SELECT r.fold, count(*) AS hits FROM r JOIN v ON v.a = r.x AND v.b = r.y AND v.fold = r.fold WHERE rank <= 10 GROUP BY 1)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS held, coalesce(any_value(hits), 0) AS hits, round(coalesce(any_value(hits), 0) / count(*), 6) AS recall FROM v LEFT JOIN h USING (fold) GROUP BY fold""")
def left_out_edges(spark, sf):
    """Pairs of parts that are ordered together twice or more, guessed from the others: recall at ten, by fold."""
    return graphs.left_out_recall(_edges(spark, sf).where("support >= 2"), 5, 10)


@query("""WITH c AS (SELECT source, lang, quality, count(*) AS o FROM documents JOIN labels USING (doc_id) GROUP BY ALL), e AS (SELECT source, o, sum(o) OVER (PARTITION BY source, lang) * sum(o) OVER (PARTITION BY source, quality) / sum(o) OVER (PARTITION BY source) AS e, sum(o) OVER (PARTITION BY source) AS n, lang, quality FROM c),
s AS (SELECT source, sum(o * o / e) - any_value(n) AS x, (count(DISTINCT lang) - 1) * (count(DISTINCT quality) - 1) AS dof FROM e GROUP BY 1)
SELECT source, round(x, 6) AS chi2, dof, CASE WHEN dof > 0 THEN round(CASE WHEN x <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 400), lambda i: exp((dof / 2 + i) * ln(x / 2) - x / 2 - lgamma(dof / 2 + i + 1)))) END, 6) END AS p FROM s""")
def chi_square_gate(spark, sf):
    """For each source, whether quality depends on the language: chi-square with its chance."""
    rows = _scored(spark, sf).groupBy("source", "lang", "quality").agg(F.count("*").alias("o"))
    both = rows.join(rows.groupBy("source", "lang").agg(F.sum("o").alias("r")), ["source", "lang"]).join(rows.groupBy("source", "quality").agg(F.sum("o").alias("c")), ["source", "quality"])
    sums = both.join(rows.groupBy("source").agg(F.sum("o").alias("n")), "source").groupBy("source").agg((F.sum(F.col("o") ** 2 * F.col("n") / (F.col("r") * F.col("c"))) - F.first("n")).alias("x"), ((F.countDistinct("lang") - 1) * (F.countDistinct("quality") - 1)).alias("dof"))
    return sums.select("source", F.round("x", 6).alias("chi2"), "dof", F.when(F.col("dof") > 0, F.round(numeric.chi_square_p(F.col("x"), F.col("dof")), 6)).alias("p"))


# --- Sources: tables written in another form and scanned back ---------------------------------------------------------------


@query("SELECT event_type AS cycle, CAST(user_id AS VARCHAR) AS unit, CAST(event_id % 3 AS VARCHAR) AS arm, CAST(event_id % 2 AS INTEGER) AS seed, round(avg(value), 6) AS score, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL")
def unit_scan(spark, sf):
    """Results by unit, written as CSV and read back with typed keys and numbers."""
    rows = table(spark, sf, "events")
    units = rows.groupBy(F.col("event_type").alias("cycle"), F.col("user_id").alias("unit"), (F.col("event_id") % 3).alias("arm"), (F.col("event_id") % 2).alias("seed")).agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("n"))
    path = f"{index.shared_folder(spark)}/quillon-units/{index.source_mark(rows)}"
    units.write.mode("overwrite").option("header", True).csv(path)
    return logs.read_units(spark, path)


@query("SELECT CAST(part AS BIGINT) AS part, 'Part ' || part AS title, sha256('# Part ' || part || chr(10) || string_agg(doc_id || ' ' || coalesce(lang, '-') || chr(10), '' ORDER BY doc_id)) AS digest FROM (SELECT *, doc_id // 1000 AS part FROM documents) GROUP BY part")
def text_tree_scan(spark, sf):
    """Documents listed in text files of a thousand ids under a tree of folders, scanned back: file, title and content."""
    rows = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("-"))).alias("value"))
    heads = rows.select("part").distinct().select("part", F.lit(-1).cast("bigint").alias("doc_id"), F.concat(F.lit("# Part "), F.col("part").cast("string")).alias("value"))
    path = f"{index.shared_folder(spark)}/quillon-trees/{index.source_mark(table(spark, sf, 'documents'))}"
    rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.mode("overwrite").partitionBy("part").text(path)
    found = logs.read_text_tree(spark, path)
    return found.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part"), "title", F.sha2("text", 256).alias("digest"))


@query("SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS text FROM benchmark WHERE regexp_matches(lower(text), '[a-z0-9]')")
def inverted_texts(spark, sf):
    """Texts put together again from their maps of words to places."""
    places = table(spark, sf, "benchmark").select("item_id", F.posexplode(tx.ascii_tokens(F.col("text"))).alias("p", "w")).groupBy("item_id", "w").agg(F.collect_list("p").alias("ps"))
    maps = places.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("places"))
    return logs.inverted_text(maps, "item_id", "places")


@query("""WITH c AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, json_extract_string(props, '$.k')) AS uses, sha256('41|' || event_id) AS h FROM events)
SELECT 'frequency' AS arm, user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, event_id DESC) AS place FROM c) WHERE place <= 3
UNION ALL SELECT 'random', user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h) AS place FROM c) WHERE place <= 3""")
def frequency_and_random_arms(spark, sf):
    """Three entries of each user: those whose key the user has most often (the newest first), and three by a seeded lot."""
    rows = table(spark, sf, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("k"))
    return controls.frequency_arm(rows, "user_id", "event_id", "k", 3).unionByName(controls.random_arm(rows, "user_id", "event_id", 3, 41))


@query(r"""WITH RECURSIVE w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), a AS (SELECT DISTINCT item_id, array_to_string(t[1:n], ' ') AS alias FROM w, range(2, 4) r(n) WHERE len(t) >= n),
k AS (SELECT alias, count(DISTINCT item_id) AS entities, min(item_id) AS e FROM a GROUP BY 1),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents), x AS (SELECT doc_id, p, n, array_to_string(t[p:p + n - 1], ' ') AS alias FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS p FROM d, range(2, 4) r(n))),
s AS (SELECT doc_id, p, n, alias, entities, e FROM x JOIN k USING (alias)),
m AS (SELECT doc_id, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS n, '' AS alias, CAST(0 AS BIGINT) AS entities, CAST(NULL AS BIGINT) AS e FROM (SELECT DISTINCT doc_id FROM s)
UNION ALL SELECT * FROM (SELECT s.doc_id, s.p, s.n, s.alias, s.entities, s.e FROM m JOIN s ON s.doc_id = m.doc_id AND s.p >= m.p + m.n QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY s.p, s.n DESC) = 1))
SELECT doc_id, CAST(p AS INTEGER) AS start, CAST(n AS INTEGER) AS length, alias, CASE WHEN entities = 1 THEN e END AS entity, entities FROM m WHERE n > 0""")
def alias_resolution(spark, sf):
    """The first two and three words of benchmark items as their aliases, found in all documents."""
    items = table(spark, sf, "benchmark").select("item_id", tx.ascii_tokens(F.col("text")).alias("t"))
    aliases = items.withColumn("n", F.explode(F.array(F.lit(2), F.lit(3)))).where("size(t) >= n").select("item_id", F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("alias"))
    texts = table(spark, sf, "documents").select("doc_id", tx.ascii_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return evidence.resolved_aliases(texts, aliases, "doc_id", "t", "alias", "item_id", 3)


@query("SELECT event_id AS id, event_type || ' ' || coalesce(json_extract_string(props, '$.k'), '') AS text, epoch_us(ts) AS at, CAST(user_id AS VARCHAR) AS channel, CASE WHEN event_id % 7 <> 0 THEN 'feed' || event_id % 3 ELSE '' END AS source, CASE WHEN event_type = 'purchase' THEN value END AS heartbeat FROM events")
def world_records(spark, sf):
    """Events as observations, six of seven with a specified source, purchases with a channel value."""
    rows = table(spark, sf, "events")
    observed = rows.select("event_id", F.concat_ws(" ", "event_type", F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("text"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("user_id").cast("string").alias("channel"))
    specs = rows.where("event_id % 7 <> 0").select("event_id", F.concat(F.lit("feed"), (F.col("event_id") % 3).cast("string")).alias("source"))
    return worlds.records(observed, specs, "event_id", rows.where("event_type = 'purchase'").select("event_id", "value"))


@query("SELECT (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS unspecified, 0 AS unobserved, 0 AS repeated")
def world_specification_audit(spark, sf):
    rows = table(spark, sf, "events")
    return worlds.spec_audit(rows, rows.where("event_id % 7 <> 0"), "event_id")
