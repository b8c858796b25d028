"""Queries over packing and rendering: budgets, ledgers, formats, placebos, sections."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillon.functions import parse
from quillon.operators import packing
from quillon.plans.catalogue import BM25_SQL, RANKED_SQL, _ranked_docs, query
from quillon.plans.tables import GOLD_SQL, TOKENS_SQL, gold, table

_R20 = f"{TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=20)})"
_ITEMS = f"{_R20}, i AS (SELECT item_id, doc_id, rank, score, substr(md5(text), 1, 8) || ' ' || lang AS text, source, CASE WHEN quality = 0 THEN 'stale' WHEN lang = 'en' THEN 'current' ELSE 'supporting' END AS bucket FROM r JOIN documents USING (doc_id) LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"


def _items(spark, sf):
    """Candidates of every item: a line of text for each ranked document, its source and its bucket."""
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.substring(F.md5("text"), 1, 8), F.lit(" "), "lang").alias("line"), "lang", "source").join(labels, "doc_id", "left")
    bucket = F.when(F.col("quality") == 0, "stale").when(F.col("lang") == "en", "current").otherwise("supporting")
    ranked = _ranked_docs(spark, sf).select("item_id", "doc_id", "rank", "score")
    return ranked.join(docs, "doc_id").select("item_id", "doc_id", "rank", "score", F.col("line").alias("text"), "source", bucket.alias("bucket"))


@query(f"WITH {_R20}, c AS (SELECT item_id, doc_id, rank, 40 + sum(CAST(ceil(n_chars / 4) AS BIGINT)) OVER (PARTITION BY item_id ORDER BY rank) AS block FROM r JOIN documents USING (doc_id)) SELECT item_id, doc_id, rank, CAST(block AS BIGINT) AS block FROM c WHERE block <= 2500")
def token_drop(spark, sf):
    return packing.token_drop(_ranked_docs(spark, sf), "item_id", "rank", F.ceil(F.col("n_chars") / 4).cast("bigint"), 40, 2500).select("item_id", "doc_id", "rank", "block")


_PLACE = {"ranked": "rank", "governed": "CASE bucket WHEN 'current' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END, rank", "reversed": "rank DESC"}
_FORM = {"text": "strlen(text) + 1", "inline": "strlen('[' || source || '#' || doc_id || '] ' || text) + 1", "footer": "strlen('[S] ' || text) + 1 + CASE WHEN row_number() OVER (PARTITION BY item_id, source ORDER BY place) = 1 THEN strlen(source) + 6 ELSE 0 END"}


def _pack_sql(order: str, form: str, budget: int) -> str:
    return f"(WITH p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {_PLACE[order]}) AS place FROM i), b AS (SELECT *, {_FORM[form]} AS bytes FROM p), s AS (SELECT *, sum(bytes) OVER (PARTITION BY item_id ORDER BY place) AS spent FROM b) SELECT '{order}' AS arm, '{form}' AS form, {budget} AS budget, item_id, doc_id, place, spent <= {budget} AS included, CASE WHEN spent > {budget} AND coalesce(lag(spent) OVER (PARTITION BY item_id ORDER BY place), 0) <= {budget} THEN 'budget' WHEN spent > {budget} THEN 'after' END AS reason FROM s)"


_ARMS = [(order, form, budget) for order in ("ranked", "governed", "reversed") for form in ("text", "inline", "footer") for budget in (120, 240)]


@query(f"WITH {_ITEMS} {' UNION ALL '.join('SELECT * FROM ' + _pack_sql(*a) for a in _ARMS)}")
def pack_grid(spark, sf):
    """Every order x format x budget, with the omission ledger."""
    packed = packing.pack(_items(spark, sf), "item_id", "rank", "bucket", "doc_id", "text", "source", _ARMS)
    return packed.select("arm", "form", "budget", "item_id", "doc_id", "place", "included", "reason")


@query(f"WITH {_ITEMS}, {GOLD_SQL}, k AS (SELECT * FROM {_pack_sql('governed', 'footer', 240)}) SELECT item_id, count(*) AS required, CAST(sum(CASE WHEN included THEN 1 ELSE 0 END) AS BIGINT) AS kept, round(sum(CASE WHEN included THEN 1 ELSE 0 END) / count(*), 6) AS retention FROM gold g LEFT JOIN k USING (item_id, doc_id) GROUP BY 1")
def pack_retention(spark, sf):
    packed = packing.pack(_items(spark, sf), "item_id", "rank", "bucket", "doc_id", "text", "source", [("governed", "footer", 240)])
    return packing.pack_integrity(packed, gold(spark, sf), "item_id", "doc_id")


@query(f"WITH {_ITEMS}, t AS (SELECT * FROM i WHERE rank <= 6), h AS (SELECT item_id, source, 'S' || lpad(CAST(row_number() OVER (PARTITION BY item_id ORDER BY min(rank)) AS VARCHAR), 2, '0') AS h FROM t GROUP BY 1, 2), l AS (SELECT item_id, string_agg('[' || h || '] ' || text, chr(10) ORDER BY rank) AS l FROM t JOIN h USING (item_id, source) GROUP BY 1), f AS (SELECT item_id, string_agg(h || ' = ' || source, chr(10) ORDER BY h) AS f FROM h GROUP BY 1) SELECT item_id, l || chr(10) || '--' || chr(10) || f AS body FROM l JOIN f USING (item_id)")
def serialise_pack(spark, sf):
    return packing.serialised(_items(spark, sf).where("rank <= 6"), "item_id", "rank", "text", "source")


@query(f"WITH {_ITEMS}, t AS (SELECT *, max(doc_id) OVER (PARTITION BY item_id, source) AS top FROM i), s AS (SELECT item_id, CASE WHEN doc_id = top THEN 'current' ELSE 'history' END AS section, doc_id, source, text FROM t) SELECT item_id, section, row_number() OVER (PARTITION BY item_id, section ORDER BY doc_id DESC, source, text) AS place, text FROM s")
def current_over_history(spark, sf):
    return packing.current_and_history(_items(spark, sf), "item_id", "source", "doc_id", "text")


@query(f"WITH {_R20}, t AS (SELECT item_id, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b FROM r GROUP BY 1) SELECT item_id, 'the first two of the context are within 0.75' AS note FROM t WHERE a - b < 0.75")
def score_note(spark, sf):
    return packing.score_note(_ranked_docs(spark, sf).select("item_id", "rank", "score"), "item_id", "score", 0.75)


@query("WITH t AS (SELECT item_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM benchmark), f AS (SELECT min(doc_id) AS doc_id, CAST(ceil(n_chars / 4) AS BIGINT) AS tokens FROM documents GROUP BY 2), c AS (SELECT item_id, doc_id, abs(f.tokens - t.tokens) AS gap, row_number() OVER (PARTITION BY item_id ORDER BY abs(f.tokens - t.tokens), doc_id) AS k FROM t, f) SELECT item_id, doc_id AS filler, gap FROM c WHERE k = 1")
def token_placebo(spark, sf):
    size = lambda c: F.ceil(c / 4).cast("bigint").alias("tokens")
    targets = table(spark, sf, "benchmark").select("item_id", size(F.length("text")))
    return packing.placebo(targets, table(spark, sf, "documents").select("doc_id", size(F.col("n_chars"))), "item_id", "tokens", "doc_id")


_STEPS = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS action, props || ' ' || CAST(event_id AS VARCHAR) AS obs FROM events)"


@query(f"WITH {_STEPS} SELECT user_id, sha256(string_agg('> ' || action || chr(10) || CASE WHEN length(obs) > 12 THEN substr(obs, 1, 12) || '...' ELSE obs END, chr(10) ORDER BY step)) AS body, sha256(string_agg(CAST(step AS VARCHAR) || '. ' || action, chr(10) ORDER BY step)) AS outline FROM s GROUP BY 1")
def walkthroughs(spark, sf):
    """Two of the registered formatters over users' event histories, as digests."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf, "events").select("user_id", F.row_number().over(w).alias("step"), F.col("event_type").alias("action"), F.concat("props", F.lit(" "), F.col("event_id").cast("string")).alias("obs"))
    one = packing.walkthrough(steps, "user_id", "step", "action", "obs", 12)
    two = packing.FORMATTERS["outline"](steps, "user_id", "step", "action", "obs").withColumnRenamed("body", "outline")
    return one.join(two, "user_id").select("user_id", F.sha2("body", 256).alias("body"), F.sha2("outline", 256).alias("outline"))


@query(f"WITH {_ITEMS} SELECT item_id, string_agg(text, chr(10) ORDER BY source, doc_id) AS context FROM i WHERE rank <= 5 GROUP BY 1")
def chronological_context(spark, sf):
    return packing.chronological(_items(spark, sf).where("rank <= 5"), "item_id", "source", "doc_id", "text")


@query("SELECT event_id, 'Event ' || event_id || ' of user ' || user_id || ': ' || event_type AS sentence FROM events")
def template_fill(spark, sf):
    return table(spark, sf, "events").select("event_id", parse.filled("Event {event} of user {user}: {kind}", event=F.col("event_id"), user=F.col("user_id"), kind=F.col("event_type")).alias("sentence"))


@query(r"WITH m AS (SELECT doc_id, regexp_replace(text, '(?m)^(#{1,6} .*|\s*[-*+] .*|\s*\d+\. .*)$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g') AS t FROM documents), u AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n[ \t]*\n'), lambda x: trim(regexp_replace(x, '^\n+|\n+$', '', 'g'))), lambda x: x <> '') AS u FROM m) SELECT doc_id, len(u) AS units, len(list_filter(u, lambda x: regexp_matches(x, '^([-*+]|\d+\.) '))) AS items FROM u")
def markdown_units(spark, sf):
    units = table(spark, sf, "documents").select("doc_id", parse.markdown_units(F.col("text")).alias("u"))
    return units.select("doc_id", F.size("u").cast("bigint").alias("units"), F.size(F.filter("u", lambda x: x["kind"] == "item")).cast("bigint").alias("items"))
