"""Queries over audits, resampling, gates, controls and text parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.functions import parse, text as tx
from quillon.operators import audit, controls, inference, measures, samples
from quillon.plans.catalogue import _ARMS, BM25_SQL, RANKED_SQL, _arms, _scored, _top5, jaccard_topk, query
from quillon.plans.tables import FACTS_SQL, GOLD_SQL, TOKENS_SQL, gold, table
from quillon.sources.index import cut

# --- The log -----------------------------------------------------------------------------------------------------------

_PM = "'PM-20240101-' || lpad(lower(hex({e})), 8, '0')"
LOG_SQL = f"""log AS (SELECT e AS line, CASE WHEN e % 97 = 0 THEN 'bad' WHEN e % 89 = 5 THEN {_PM.format(e='e - 1')} ELSE {_PM.format(e='e')} END AS id,
CASE WHEN e % 83 = 0 THEN 'delete' WHEN e % 3 = 0 THEN 'supersede' ELSE 'create' END AS operation,
CASE WHEN e % 71 = 0 THEN 'note' ELSE CASE event_type WHEN 'view' THEN 'finding' WHEN 'click' THEN 'decision' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'session' ELSE 'hypothesis' END END AS kind,
CASE WHEN e % 19 = 0 THEN '' ELSE 'title' END AS title, CASE WHEN e % 67 = 0 THEN 'sure' ELSE ['unknown', 'low', 'medium', 'high'][CAST(e % 4 AS INTEGER) + 1] END AS confidence, 'active' AS status,
CASE WHEN e % 61 = 0 THEN 'yesterday' WHEN e % 73 = 7 THEN strftime(ts - INTERVAL 3 DAY, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS created_at, CASE WHEN e % 59 = 0 THEN '2024' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS valid_from,
CASE WHEN e % 53 = 0 THEN 'odd' ELSE 'state' END AS claim_class, CASE WHEN e % 17 = 0 THEN '2024-01-01T00:00:00Z' END AS expired_at,
CASE WHEN e % 3 <> 0 OR e % 47 = 0 THEN NULL WHEN e % 43 = 0 THEN 'PM-20230101-00000000' WHEN e % 41 = 0 THEN {_PM.format(e='e + 5')} WHEN e % 37 = 0 THEN {_PM.format(e='e')} ELSE {_PM.format(e='greatest(e - 10, 0)')} END AS supersedes,
CASE WHEN e % 31 = 0 THEN 'swap' WHEN e % 11 = 0 THEN 'unclassified' ELSE 'succession' END AS supersession_kind, CASE WHEN e % 29 = 0 THEN ' ' ELSE 'reason' END AS supersession_reason,
CASE WHEN e % 7 = 0 THEN [] ELSE ['source'] END AS source_refs, CASE WHEN e % 23 = 0 THEN ['PM-missing'] WHEN e % 5 = 0 THEN [{_PM.format(e='greatest(e - 1, 0)')}] ELSE [] END AS related_ids FROM (SELECT *, event_id AS e FROM events))"""


def _log(spark, sf) -> DataFrame:
    """The events as a memory log in which rows of certain numbers break a rule."""
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    pm = lambda x: F.concat(F.lit("PM-20240101-"), F.lpad(F.lower(F.hex(x)), 8, "0"))
    iso = lambda x: F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    strings = lambda *x: F.array(*x).cast("array<string>")
    kinds = F.when(F.col("event_type") == "view", "finding").when(F.col("event_type") == "click", "decision").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "session").otherwise("hypothesis")
    return table(spark, sf, "events").select(
        e.alias("line"), F.when(e % 97 == 0, "bad").when(e % 89 == 5, pm(e - 1)).otherwise(pm(e)).alias("id"),
        F.when(e % 83 == 0, "delete").when(e % 3 == 0, "supersede").otherwise("create").alias("operation"), F.when(e % 71 == 0, "note").otherwise(kinds).alias("kind"),
        F.when(e % 19 == 0, "").otherwise("title").alias("title"), F.when(e % 67 == 0, "sure").otherwise(F.element_at(F.array(*map(F.lit, ("unknown", "low", "medium", "high"))), (e % 4 + 1).cast("int"))).alias("confidence"),
        F.lit("active").alias("status"), F.when(e % 61 == 0, "yesterday").when(e % 73 == 7, iso(ts - F.expr("interval 3 days"))).otherwise(iso(ts)).alias("created_at"), F.when(e % 59 == 0, "2024").otherwise(iso(ts)).alias("valid_from"),
        F.when(e % 53 == 0, "odd").otherwise("state").alias("claim_class"), F.when(e % 17 == 0, "2024-01-01T00:00:00Z").alias("expired_at"),
        F.when((e % 3 != 0) | (e % 47 == 0), F.lit(None).cast("string")).when(e % 43 == 0, "PM-20230101-00000000").when(e % 41 == 0, pm(e + 5)).when(e % 37 == 0, pm(e)).otherwise(pm(F.greatest(e - 10, F.lit(0)))).alias("supersedes"),
        F.when(e % 31 == 0, "swap").when(e % 11 == 0, "unclassified").otherwise("succession").alias("supersession_kind"), F.when(e % 29 == 0, " ").otherwise("reason").alias("supersession_reason"),
        F.when(e % 7 == 0, strings()).otherwise(strings(F.lit("source"))).alias("source_refs"),
        F.when(e % 23 == 0, strings(F.lit("PM-missing"))).when(e % 5 == 0, strings(pm(F.greatest(e - 1, F.lit(0))))).otherwise(strings()).alias("related_ids"),
    )


def _rule(name: str, where: str) -> str:
    return f"SELECT line, id, '{name}' AS rule FROM log WHERE {where}"


_TS = "regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z')"
_FAMILIES = {
    "fields": [_rule(f"missing-{f}", f"coalesce({f}, '') = ''") for f in audit.REQUIRED] + [_rule("malformed-id", "coalesce(id, '') <> '' AND NOT regexp_full_match(id, 'PM-\\d{8}-[0-9a-f]{8}')"), "SELECT line, id, 'duplicate-id' AS rule FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS k FROM log WHERE coalesce(id, '') <> '') WHERE k > 1"],
    "enums": [_rule(f"bad-{f}", f"{f} IS NULL OR {f} NOT IN {values}") for f, values in audit.ENUMS.items()] + [_rule("bad-claim-class", f"claim_class IS NULL OR claim_class NOT IN {audit.CLAIM_CLASSES}"), _rule("bad-supersession-kind", f"operation = 'supersede' AND (supersession_kind IS NULL OR supersession_kind NOT IN {audit.SUPERSESSION_KINDS})")],
    "times": [_rule("bad-timestamp", f"NOT {_TS.format(c='created_at')}"), _rule("bad-valid-from", f"NOT {_TS.format(c='valid_from')}"), f"SELECT line, id, 'non-monotonic-time' AS rule FROM (SELECT *, lag(created_at) OVER (ORDER BY line) AS b FROM log WHERE {_TS.format(c='created_at')}) WHERE created_at < b"],
    "provenance": [_rule("missing-provenance", "kind IN ('finding', 'failure') AND len(source_refs) = 0"), _rule("stored-derived-field", "expired_at IS NOT NULL")],
    "revisions": [_rule("missing-supersedes", "operation = 'supersede' AND supersedes IS NULL"), _rule("missing-supersession-reason", "operation = 'supersede' AND trim(supersession_reason) = ''"), "SELECT line, l.id, CASE WHEN f IS NULL THEN 'dangling-supersedes' WHEN supersedes = l.id THEN 'self-supersedes' ELSE 'forward-supersedes' END AS rule FROM log l LEFT JOIN (SELECT id, min(line) AS f FROM log GROUP BY 1) k ON k.id = l.supersedes WHERE supersedes IS NOT NULL AND (f IS NULL OR supersedes = l.id OR f >= line)"],
    "links": ["SELECT line, id, 'dangling-related-id' AS rule FROM (SELECT line, id, unnest(related_ids) AS t FROM log) WHERE t NOT IN (SELECT id FROM log)"],
}


def _family(name: str):
    rules = {"fields": "rule like 'missing-%' and rule not in ('missing-provenance', 'missing-supersedes', 'missing-supersession-reason') or rule in ('malformed-id', 'duplicate-id')", "enums": "rule in ('bad-operation', 'bad-kind', 'bad-confidence', 'bad-claim-class', 'bad-supersession-kind')", "times": "rule in ('bad-timestamp', 'bad-valid-from', 'non-monotonic-time')", "provenance": "rule in ('missing-provenance', 'stored-derived-field')", "revisions": "rule in ('missing-supersedes', 'missing-supersession-reason', 'dangling-supersedes', 'self-supersedes', 'forward-supersedes')", "links": "rule = 'dangling-related-id'"}[name]

    def run(spark, sf):
        return audit.log_violations(_log(spark, sf)).where(rules)

    run.__name__ = f"log_{name}"
    return query(f"WITH {LOG_SQL} {' UNION ALL '.join(_FAMILIES[name])}")(run)


for _name in _FAMILIES:
    _family(_name)


@query(f"WITH {LOG_SQL}, k AS (SELECT id, unnest(related_ids) AS t FROM log UNION ALL SELECT id, supersedes FROM log WHERE supersedes IS NOT NULL), g AS (SELECT DISTINCT supersedes AS id FROM log WHERE supersedes IS NOT NULL), a AS (SELECT *, CASE WHEN {_TS.format(c='created_at')} THEN date_diff('day', CAST(substr(created_at, 1, 10) AS DATE), DATE '2024-03-01') END AS age FROM log) SELECT id, 'unreferenced-decision' AS question FROM a WHERE kind = 'decision' AND age > 7 AND id NOT IN (SELECT t FROM k) UNION ALL SELECT id, 'stale-hypothesis' FROM a WHERE kind = 'hypothesis' AND age > 30 AND id NOT IN (SELECT id FROM g) UNION ALL SELECT DISTINCT id, 'cited-superseded' FROM (SELECT id, unnest(related_ids) AS t FROM log) WHERE t IN (SELECT id FROM g) UNION ALL SELECT id, 'unclassified-revision' FROM log WHERE operation = 'supersede' AND supersession_kind = 'unclassified'")
def open_questions(spark, sf):
    return audit.open_questions(_log(spark, sf), F.lit("2024-03-01").cast("date"))


# --- Gates and audits --------------------------------------------------------------------------------------------------


@query("WITH f AS (SELECT l_orderkey, l_shipdate, l_shipdate + INTERVAL 1 DAY * (l_linenumber - 2) AS e, l_extendedprice AS v FROM lineitem), r AS (SELECT v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k, count(*) OVER () AS n FROM f), d AS (SELECT least(9, floor(round((k - 0.5) / n * 10, 9))) AS d, count(*) AS c FROM r GROUP BY 1) SELECT 'duplicate-id' AS rule, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n UNION ALL SELECT 'no-host', (SELECT count(*) FROM f WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'ends-before-start', (SELECT count(*) FROM f WHERE e < l_shipdate) UNION ALL SELECT 'uneven-decile', (SELECT count(*) FROM d, (SELECT sum(c) AS t FROM d) WHERE abs(c / t - 0.1) > 0.05)")
def world_invariants(spark, sf):
    facts = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("s"), (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(days=(F.col("l_linenumber") - 2).cast("int"))).alias("e"), F.col("l_extendedprice").alias("v"))
    return audit.world_violations(table(spark, sf, "orders").select("o_orderkey"), facts, "o_orderkey", "l_orderkey", "s", "e", "v")


@query("WITH t AS (SELECT avg(value) AS mean, stddev_samp(value) AS spread, corr(value, event_id) AS trend FROM events) SELECT 'mean' AS gate, round(mean, 6) AS value, mean BETWEEN 20 AND 80 AS passes FROM t UNION ALL SELECT 'spread', round(spread, 6), spread BETWEEN 10 AND 40 FROM t UNION ALL SELECT 'trend', round(trend, 6), trend BETWEEN -0.1 AND 0.1 FROM t")
def instrument_gates(spark, sf):
    t = table(spark, sf, "events").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"), F.corr("value", "event_id").alias("trend"))
    return audit.banded(t, {"mean": (20, 80), "spread": (10, 40), "trend": (-0.1, 0.1)})


@query("WITH e AS (SELECT o_orderstatus AS arm, o_orderpriority AS family, avg(o_totalprice / 1000) AS m, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT arm, avg(m) AS m, min(n) AS n FROM e GROUP BY 1), t AS (SELECT max(CASE WHEN arm = 'F' THEN m END) AS chosen, max(CASE WHEN arm <> 'F' THEN m END) AS best, min(n) AS fewest FROM m) SELECT round(chosen, 6) AS chosen, round(best, 6) AS best, round(chosen - best, 6) AS headroom, fewest, round(chosen - best, 9) >= 0.5 AND fewest >= 20 AS passes FROM t")
def headroom_gate(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 1000).alias("v"))
    return audit.headroom(rows, "o_orderstatus", "o_orderpriority", "v", "F", 0.5, 20)


_DIGEST = "sha256(concat_ws('|', " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS HUGEINT)) AS VARCHAR)" for k in range(4)) + "))"


@query(f"""WITH j AS (SELECT sha256('{{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}}') AS h FROM documents) SELECT count(*) AS n, {_DIGEST} AS digest, true AS alike, true AS changed FROM j""")
def determinism_gate(spark, sf):
    """The digest of a table's rows; that another order and other partitions have the same, and the table without one row another."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source")
    one = audit.digest_of_rows(rows)
    other = audit.digest_of_rows(rows.orderBy(F.desc("doc_id")).repartition(7, "source")).select(F.col("digest").alias("other"))
    less = audit.digest_of_rows(rows.where(F.col("doc_id") != rows.agg(F.max("doc_id")).first()[0])).select(F.col("digest").alias("less"))
    return one.crossJoin(other).crossJoin(less).select("n", "digest", (F.col("digest") == F.col("other")).alias("alike"), (F.col("digest") != F.col("less")).alias("changed"))  # one row each


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=5)}), {GOLD_SQL}, h AS (SELECT g.item_id, min(rank) AS r FROM gold g LEFT JOIN r USING (item_id, doc_id) GROUP BY 1), t AS (SELECT item_id, h.item_id IS NOT NULL AS known, h.r IS NOT NULL AS found, h.r = 1 AS first, length(text) > 200 AS long FROM benchmark LEFT JOIN h USING (item_id)) SELECT item_id, CASE WHEN NOT known THEN 'F0' WHEN NOT found THEN 'F1' WHEN NOT coalesce(first, false) THEN 'F2' WHEN NOT long THEN 'F3' ELSE 'none' END AS stage FROM t")
def failure_stage(spark, sf):
    """Stored, retrieved, ranked first, long enough: the first that fails."""
    hits = gold(spark, sf).join(_top5(spark, sf).select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.min("rank").alias("r"), F.lit(True).alias("known"))
    rows = table(spark, sf, "benchmark").join(hits, "item_id", "left")
    return rows.select("item_id", audit.first_failure({"F0": F.col("known"), "F1": F.col("r").isNotNull(), "F2": F.col("r") == 1, "F3": F.length("text") > 200}).alias("stage"))


_ANSWERS = "a AS (SELECT event_id, event_type AS gold, CASE event_id % 7 WHEN 0 THEN 'It was a ' || event_type || '.' WHEN 1 THEN 'maybe ' || event_type WHEN 2 THEN 'unknown' WHEN 3 THEN 'click or view' WHEN 4 THEN 'signup' WHEN 5 THEN 'no idea of it' ELSE upper(event_type) END AS answer FROM events)"


@query(f"WITH {_ANSWERS}, f AS (SELECT *, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda v: contains(' ' || regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || v || ' '))) AS f FROM a) SELECT event_id, len(f) > 0 AND len(list_filter(f, lambda v: v <> gold)) = 0 AS correct, CASE WHEN len(f) > 0 AND len(list_filter(f, lambda v: v <> gold)) = 0 THEN CASE WHEN contains(lower(answer), 'maybe') THEN 'hedged' ELSE 'none' END WHEN len(f) = 0 AND contains(lower(answer), 'unknown') THEN 'abstained' WHEN len(f) = 0 THEN 'unmatched' WHEN len(f) > 1 THEN 'several' WHEN gold = 'purchase' AND f[1] = 'signup' THEN 'near_miss' ELSE 'wrong' END AS error FROM f")
def answer_scores(spark, sf):
    e, kind = F.col("event_id") % 7, F.col("event_type")
    answer = F.when(e == 0, F.concat(F.lit("It was a "), kind, F.lit("."))).when(e == 1, F.concat(F.lit("maybe "), kind)).when(e == 2, "unknown").when(e == 3, "click or view").when(e == 4, "signup").when(e == 5, "no idea of it").otherwise(F.upper(kind))
    near = F.when(kind == "purchase", F.array(F.lit("signup"))).otherwise(F.array().cast("array<string>"))
    vocabulary = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    rows = table(spark, sf, "events").withColumn("s", audit.scored(answer, kind, F.array().cast("array<string>"), near, vocabulary))
    return rows.select("event_id", "s.correct", "s.error")


_OUTCOMES = "o AS (SELECT source AS arm, ['yes', 'no', 'unknown'][CAST(doc_id % 3 AS INTEGER) + 1] AS p, CASE WHEN quality = 1 THEN 'yes' WHEN quality = 0 THEN 'no' ELSE 'unknown' END AS g FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) USING (doc_id))"


@query(f"WITH {_OUTCOMES} SELECT arm, count(*) AS n, round(avg(CASE WHEN p = 'no' AND g <> 'no' THEN 1 ELSE 0 END), 6) AS unsafe_negatives, round(avg(CASE WHEN p <> 'unknown' AND g = 'unknown' THEN 1 ELSE 0 END), 6) AS false_closures, round(avg(CASE WHEN p = 'unknown' AND g = 'yes' THEN 1 ELSE 0 END), 6) AS omissions, round(avg(CASE WHEN p = 'unknown' AND g = 'unknown' THEN 1 ELSE 0 END), 6) AS safe_abstentions FROM o GROUP BY 1")
def unsafe_outcomes(spark, sf):
    label = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = table(spark, sf, "documents").join(label, "doc_id", "left")
    guess = F.element_at(F.array(*map(F.lit, ("yes", "no", "unknown"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = rows.select(F.col("source").alias("arm"), guess.alias("p"), F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").otherwise("unknown").alias("g"))
    return audit.unsafe_outcomes(rows, "arm", "p", "g")


@query(f"WITH {_ARMS} SELECT unit, CASE WHEN b > a THEN 'gained' ELSE 'lost' END AS change FROM p WHERE a <> b")
def gained_and_lost(spark, sf):
    return audit.gained_and_lost(_arms(spark, sf), "unit")


@query("SELECT event_type AS arm, count(*) AS n, count(*) FILTER (WHERE value > 60) AS solved, count(*) FILTER (WHERE value < 10) AS errors, CAST(sum(length(props)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def arm_summary(spark, sf):
    status = F.when(F.col("value") > 60, "solved").when(F.col("value") < 10, "error").otherwise("open")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("arm"), status.alias("status"), F.length("props").alias("tokens"))
    return audit.arm_summary(rows, "arm", "status", "tokens").withColumn("tokens", F.col("tokens").cast("bigint"))


@query("WITH c AS (SELECT event_id, user_id, unnest([CAST(json_extract_string(props, '$.k') AS VARCHAR), CAST(event_id % 90 AS VARCHAR)]) AS k FROM events) SELECT DISTINCT event_id, k FROM c WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = c.user_id AND json_extract_string(s.props, '$.k') = c.k)")
def reviewer_visibility(spark, sf):
    """What an event cites (its own k and another number) that no event of its user has."""
    events = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    reviews = events.select("event_id", "user_id", F.concat(F.lit("see <"), "k", F.lit("> and <"), (F.col("event_id") % 90).cast("string"), F.lit(">")).alias("text"))
    shown = reviews.select("event_id", "user_id").join(events.select("user_id", "k").distinct(), "user_id").select("event_id", "k")
    return audit.fabricated(reviews, shown, "event_id", "text", "k", "<([0-9]+)>")


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=5)}), w AS (SELECT item_id, rank, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM r JOIN documents USING (doc_id)) SELECT d AS depth, count(DISTINCT item_id) AS queries, CAST(sum(w) AS BIGINT) AS words, CAST(0 AS BIGINT) AS missing FROM w, (VALUES (1), (3), (5)) t(d) WHERE rank <= d GROUP BY 1")
def snapshot_cost(spark, sf):
    return audit.shown_cost(_top5(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), "item_id", "doc_id", tx.word_count(F.col("text")), (1, 3, 5))


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, r AS ({RANKED_SQL.format(k=5)}), {GOLD_SQL}, a AS (SELECT DISTINCT item_id, lang AS arm FROM gold JOIN documents USING (doc_id)), h AS (SELECT DISTINCT item_id FROM r JOIN gold USING (item_id, doc_id) WHERE rank <= 3) SELECT arm, count(*) AS queries, round(count(h.item_id) / count(*), 6) AS recall FROM a LEFT JOIN h USING (item_id) GROUP BY 1")
def language_recall(spark, sf):
    """Recall by the languages of the documents that hold a query's passage: one query asked of several languages."""
    found = gold(spark, sf)
    arms = found.join(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("arm")), "doc_id").select("item_id", "arm").distinct()
    return audit.recall_by(_top5(spark, sf), found, arms, "item_id", "doc_id", 3)


_CALLS = "c AS (SELECT event_id, event_type AS tool, CASE event_id % 5 WHEN 0 THEN '{\"id\": \"' || event_id || '\"}' WHEN 1 THEN '{\"id\": \"x\", \"why\": \"y\"}' WHEN 2 THEN '{}' WHEN 3 THEN 'no' ELSE '{\"id\": \"7\", \"limit\": \"ten\"}' END AS args FROM events)"


@query(f"WITH {_CALLS} SELECT event_id, 'unknown tool' AS error FROM c WHERE tool NOT IN ('view', 'click') UNION ALL SELECT event_id, 'no object' FROM c WHERE args = 'no' UNION ALL SELECT event_id, 'missing id' FROM c WHERE tool IN ('view', 'click') AND args = '{{}}' UNION ALL SELECT event_id, 'id is no bigint' FROM c WHERE tool IN ('view', 'click') AND event_id % 5 = 1 UNION ALL SELECT event_id, 'unknown why' FROM c WHERE tool IN ('view', 'click') AND event_id % 5 = 1 UNION ALL SELECT event_id, 'limit is no int' FROM c WHERE tool = 'view' AND event_id % 5 = 4 UNION ALL SELECT event_id, 'unknown limit' FROM c WHERE tool = 'click' AND event_id % 5 = 4")
def tool_call_errors(spark, sf):
    e = F.col("event_id") % 5
    args = F.when(e == 0, F.concat(F.lit('{"id": "'), F.col("event_id").cast("string"), F.lit('"}'))).when(e == 1, '{"id": "x", "why": "y"}').when(e == 2, "{}").when(e == 3, "no").otherwise('{"id": "7", "limit": "ten"}')
    docs = {"view": {"id": ("bigint", True), "limit": ("int", False)}, "click": {"id": ("bigint", True)}}
    return audit.call_errors(table(spark, sf, "events").withColumn("args", args), "event_id", "event_type", "args", docs)


# --- Resampling --------------------------------------------------------------------------------------------------------

# One digest has the numbers of eight draws, or the signs of 256.
_U = "CAST(('0x' || substr(sha256(concat_ws('|', {seed}, draw // 8, {unit})), 8 * (draw % 8) + 1, 8)) AS BIGINT) / 4294967296.0"
_SIGN = "(((strpos('0123456789abcdef', substr(sha256(concat_ws('|', {seed}, draw // 256, {unit})), CAST((draw % 256) // 4 AS INTEGER) + 1, 1)) - 1) >> CAST(draw % 4 AS INTEGER)) & 1) = 1"
_TIMES = "(" + " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in inference.POISSON) + ")"
_CI = "round(quantile_cont({v}, 0.025), 6) AS low, round(quantile_cont({v}, 0.975), 6) AS high"


@query(f"WITH d AS (SELECT event_type, value, draw, {_U.format(seed=7, unit='event_id')} AS u FROM events, range(0, 200) t(draw)), m AS (SELECT event_type, draw, sum({_TIMES} * value) / sum({_TIMES}) AS v FROM d GROUP BY ALL), i AS (SELECT event_type, {_CI.format(v='v')} FROM m GROUP BY 1), a AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1) SELECT * FROM a JOIN i USING (event_type)")
def bootstrap_ci(spark, sf):
    return inference.bootstrap(table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 200)


@query(f"WITH b AS (SELECT event_type, event_id, sum(value) OVER w AS s, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)), d AS (SELECT event_type, s, c, draw, {_U.format(seed=7, unit='event_id')} AS u FROM b, range(0, 200) t(draw)), m AS (SELECT event_type, draw, sum({_TIMES} * s) / sum({_TIMES} * c) AS v FROM d GROUP BY ALL), i AS (SELECT event_type, {_CI.format(v='v')} FROM m GROUP BY 1), a AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1) SELECT * FROM a JOIN i USING (event_type)")
def block_bootstrap(spark, sf):
    return inference.bootstrap(table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value", 200, block=24)


@query(f"WITH {_ARMS}, s AS (SELECT avg(b - a) AS m, count(*) AS n FROM p), f AS (SELECT draw, sum(CASE WHEN {_SIGN.format(seed=3, unit='unit')} THEN b - a ELSE a - b END) AS t FROM p, range(0, 2000) x(draw) WHERE a <> b GROUP BY 1) SELECT round(any_value(m), 6) AS diff, round((1 + sum(CASE WHEN abs(t / n) >= abs(m) - 1e-12 THEN 1 ELSE 0 END)) / 2001, 6) AS p FROM f, s")
def sign_flip_test(spark, sf):
    return inference.sign_flips(_arms(spark, sf), "unit")


@query(f"WITH c AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1), d AS (SELECT m, draw, {_U.format(seed=11, unit='user_id')} AS u FROM c, range(0, 200) t(draw)), v AS (SELECT draw, sum({_TIMES} * m) / sum({_TIMES}) AS v FROM d GROUP BY 1 HAVING sum({_TIMES}) > 0) SELECT (SELECT count(*) FROM c) AS clusters, (SELECT round(avg(m), 6) FROM c) AS mean, {_CI.format(v='v')} FROM v")
def cluster_bootstrap(spark, sf):
    return inference.cluster_bootstrap(table(spark, sf, "events"), "user_id", "value")


@query(f"WITH {_ARMS}, z AS (SELECT *, c_mktsegment AS s FROM p JOIN customer ON c_custkey = unit), d AS (SELECT s, CAST(b - a AS DOUBLE) AS x, draw, {_U.format(seed=13, unit='unit')} AS u FROM z, range(0, 200) t(draw)), m AS (SELECT s, draw, sum({_TIMES} * x) / sum({_TIMES}) AS v FROM d GROUP BY ALL HAVING sum({_TIMES}) > 0), v AS (SELECT draw, avg(v) AS v FROM m GROUP BY 1) SELECT (SELECT round(avg(m), 6) FROM (SELECT avg(b - a) AS m FROM z GROUP BY s)) AS diff, {_CI.format(v='v')} FROM v")
def stratified_bootstrap(spark, sf):
    pairs = _arms(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), "c_mktsegment"), "unit")
    return inference.stratified_bootstrap(pairs, "c_mktsegment", "unit")


_FIRED = "(SELECT draw, sum(greatest(0, least(t, mx - before)) * hit) / sum(t) AS h FROM (SELECT *, sum(t) OVER (PARTITION BY draw ORDER BY {c} DESC, doc_id) - t AS before, ceil(round(0.25 * sum(t) OVER (PARTITION BY draw), 9)) AS mx FROM w) GROUP BY 1)"


@query(f"WITH s AS (SELECT doc_id, n_chars AS a, doc_id % 101 AS b, quality AS hit FROM documents JOIN labels USING (doc_id)), d AS (SELECT s.*, draw, {_U.format(seed=17, unit='doc_id')} AS u FROM s, range(0, 101) t(draw)), w AS (SELECT * FROM (SELECT *, CASE WHEN draw = 100 THEN 1 ELSE {_TIMES} END AS t FROM d) WHERE t > 0), v AS (SELECT draw, x.h - y.h AS v FROM {_FIRED.format(c='a')} x JOIN {_FIRED.format(c='b')} y USING (draw)) SELECT (SELECT round(v, 6) FROM v WHERE draw = 100) AS diff, {_CI.format(v='v')} FROM v WHERE draw < 100")
def fired_difference(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").alias("a"), (F.col("doc_id") % 101).alias("b"), "quality")
    return inference.fired_difference(rows, "doc_id", "a", "b", "quality", 0.25, draws=100)


@query("WITH c AS (SELECT user_id, avg(value) AS m, count(*) AS n, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS bn, sum(n * n) AS n2, sum(n * m) AS s, sum(n * m * m) AS s2, sum(n * v) AS w FROM c), u AS (SELECT (s2 - s * s / bn) / (k - 1) AS b, w / (bn - k) AS w, (bn - n2 / bn) / (k - 1) AS n0 FROM t), i AS (SELECT round(greatest(0.0, least(1.0, (b - w) / (b + (n0 - 1) * w))), 6) AS icc FROM u) SELECT count(*) AS clusters, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, round(avg(m) - 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS low, round(avg(m) + 1.96 * stddev_samp(m) / sqrt(count(*)), 6) AS high, round(1 + (avg(n) - 1) * any_value(icc), 6) AS design FROM c, i")
def cluster_interval(spark, sf):
    return inference.cluster_interval(table(spark, sf, "events"), "user_id", "value")


@query("SELECT event_type, count(*) AS n, round(1 - pow(0.05, 1 / count(*)), 6) AS bound FROM events GROUP BY 1")
def zero_failure_bound(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("bound", inference.zero_failure_bound(F.col("n")))


@query(f"WITH r AS (SELECT id, event_type AS kind, valid_from AS p, recorded AS k, value AS y FROM ({FACTS_SQL})), n AS (SELECT q.id, count(f.id) AS n, avg(f.y) AS m, count(f.id) FILTER (WHERE f.kind = q.kind) AS kn, sum(f.y) FILTER (WHERE f.kind = q.kind) AS ks, any_value(q.y) AS y FROM r q LEFT JOIN r f ON f.k < q.p GROUP BY 1), g AS (SELECT *, CASE WHEN n > 0 THEN CASE WHEN kn > 0 THEN kn / (kn + 5.0) * ks / kn + (1 - kn / (kn + 5.0)) * m ELSE m END END AS g FROM n) SELECT id, n, round(g, 9) AS guess, round(abs(g - y), 9) AS error FROM g")
def rolling_origin(spark, sf):
    from quillon.plans.tables import facts

    return inference.rolling_origin(facts(spark, sf), "id", "valid_from", "recorded", "event_type", "value")


_LOT = "CAST(('0x' || substr(sha256(concat_ws('|', {parts})), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"WITH s AS (SELECT user_id, avg(value) / 100 AS base FROM events GROUP BY 1), c AS (SELECT user_id, cluster, least(1.0, greatest(0.0, base + 0.1 + 0.2 * (2 * {_LOT.format(parts="'23', 'c', user_id, cluster")} - 1))) AS p FROM s, range(0, 6) k(cluster)), h AS (SELECT user_id, sum(CASE WHEN {_LOT.format(parts="'23', 't', user_id, cluster, trial")} < p THEN 1 ELSE 0 END) AS k FROM c, range(0, 10) t(trial) GROUP BY 1) SELECT user_id AS sim, CAST(k AS BIGINT) AS successes, k >= 0.55 * 60 AS fires FROM h")
def rule_characteristics(spark, sf):
    """For each user, whether the rule fires in a program of six clusters of ten trials around the user's own mean."""
    programs = table(spark, sf, "events").groupBy(F.col("user_id").alias("sim")).agg((F.avg("value") / 100).alias("base"))
    return inference.simulate_rule(programs, 6, 10, F.col("base"), 0.1, 0.2, lambda k, n: k >= 0.55 * n)


# --- Measures ----------------------------------------------------------------------------------------------------------


@query("WITH p AS (SELECT source, doc_id % 8 + 1 AS x, avg(n_chars) / 1000 AS y FROM documents GROUP BY 1, 2), s AS (SELECT source, log2(x) AS l, lag(log2(x)) OVER w AS x0, lag(y) OVER w AS y0, y FROM p WINDOW w AS (PARTITION BY source ORDER BY x)) SELECT source, CASE WHEN max(l) > min(l) THEN round(sum((l - x0) * (y + y0) / 2) / (max(l) - min(l)), 6) END AS area FROM s GROUP BY 1")
def log_area(spark, sf):
    points = table(spark, sf, "documents").groupBy("source", (F.col("doc_id") % 8 + 1).alias("x")).agg((F.avg("n_chars") / 1000).alias("y"))
    return measures.log_area(points, "source", "x", "y")


@query("WITH r AS (SELECT CASE WHEN event_type IN ('view', 'error') THEN CASE WHEN user_id % 2 = 0 THEN 'ab' ELSE 'a' END WHEN user_id % 2 = 0 THEN 'b' ELSE 'none' END AS arm, value FROM events), t AS (SELECT avg(value) FILTER (WHERE arm = 'none') AS s0, avg(value) FILTER (WHERE arm = 'a') AS a, avg(value) FILTER (WHERE arm = 'b') AS b, avg(value) FILTER (WHERE arm = 'ab') AS ab FROM r), c AS (SELECT *, round(ab - a - b + s0, 6) AS contrast FROM t) SELECT round(s0, 6) AS s0, round(a, 6) AS a, round(b, 6) AS b, round(ab, 6) AS ab, contrast, CASE WHEN contrast IS NULL THEN 'unknown' WHEN contrast > 0 THEN 'synergy' WHEN contrast < 0 THEN 'interference' ELSE 'additive' END AS reading FROM c")
def interaction_contrast(spark, sf):
    first, second = F.col("event_type").isin("view", "error"), F.col("user_id") % 2 == 0
    rows = table(spark, sf, "events").select(F.when(first & second, "ab").when(first, "a").when(second, "b").otherwise("none").alias("arm"), "value")
    return measures.interaction(rows, "arm", "value")


@query("WITH g AS (SELECT event_type, avg(value) AS v, min(value) AS f, max(value) AS c FROM events GROUP BY 1) SELECT event_type, CASE WHEN c <> f THEN round((v - f) / (c - f), 6) END AS closed FROM g")
def gap_closed(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.min("value").alias("f"), F.max("value").alias("c"))
    return g.select("event_type", measures.gap_closed(F.col("v"), F.col("f"), F.col("c")).alias("closed"))


@query("WITH r AS (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS k, count(*) OVER () AS n FROM customer) SELECT c_custkey, round((k - 0.5) / n, 6) AS share, CAST(least(9, floor(round((k - 0.5) / n * 10, 9))) AS INTEGER) AS decile, CAST(least(2, floor(round((k - 0.5) / n * 3, 9))) AS INTEGER) AS tercile FROM r")
def rank_shares(spark, sf):
    return measures.rank_shares(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "share", "decile", "tercile")


@query("SELECT event_type, user_id % 3 AS seed, CAST(sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) AS BIGINT) AS given, round(avg(CASE WHEN value > 70 THEN 1 ELSE 0 END) FILTER (WHERE value > 40), 6) AS rate FROM events GROUP BY 1, 2")
def conditional_rates(spark, sf):
    rows = table(spark, sf, "events").withColumn("seed", F.col("user_id") % 3)
    return measures.conditional_rate(rows, ["event_type", "seed"], F.col("value") > 70, F.col("value") > 40)


@query("WITH r AS (SELECT lang, least(1.0, n_chars / 4000) AS s, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) AS n, round(avg(CASE WHEN s >= 0.8 AND y = 0 THEN 1 ELSE 0 END), 6) AS rate FROM r GROUP BY 1")
def confident_wrong(spark, sf):
    return measures.confident_wrong(_scored(spark, sf), "lang", "s", "y", 0.8)


# --- Samples and controls ----------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('5|' || doc_id)) AS k FROM (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id % 10 <> 0 GROUP BY 1)) SELECT doc_id, quality FROM r WHERE k <= 10")
def stratified_sample(spark, sf):
    rows = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    decisive = rows.where("doc_id % 10 = 0").select("doc_id")
    return samples.per_label(rows, decisive, "doc_id", "quality", 10, 5)


@query("WITH RECURSIVE c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), s AS (SELECT 0 AS turn, CAST(floor(0.21 * sum(n)) AS BIGINT) AS most FROM c UNION ALL SELECT turn + 1, CAST(floor(0.21 * sum(least(n, most))) AS BIGINT) FROM s, c WHERE turn < 60 GROUP BY turn), r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('9|' || event_id)) AS k FROM events) SELECT event_id FROM r WHERE k <= (SELECT most FROM s WHERE turn = 60)")
def capped_selection(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.sha2(F.concat(F.lit("9|"), F.col("event_id").cast("string")), 256).alias("pos"))
    return samples.capped(rows, "event_type", "pos", 0.21).select("event_id")


@query(f"WITH g AS (SELECT * FROM events WHERE user_id <> 3) SELECT id, nullif(CASE WHEN b IN (SELECT event_id FROM g) THEN b END, -1) AS supersedes FROM (SELECT id, user_id, lag(id) OVER (PARTITION BY event_type ORDER BY valid_from, id) AS b FROM ({FACTS_SQL})) WHERE user_id <> 3")
def ablation(spark, sf):
    """Without one user: its events go, and links to them are reset."""
    from quillon.plans.tables import facts

    chained = facts(spark, sf).withColumn("supersedes", F.lag("id").over(Window.partitionBy("event_type").orderBy("valid_from", "id")))
    return samples.ablated(chained, spark.createDataFrame([(3,)], "user_id bigint"), "user_id", "id", "supersedes").select("id", "supersedes")


@query("WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), b AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY sha256('4|' || event_id)) AS k FROM events) SELECT event_id, value FROM a JOIN b USING (event_type, k)")
def shuffle_in_groups(spark, sf):
    return samples.permuted(table(spark, sf, "events"), "event_type", "event_id", "value", 4).select("event_id", "value")


_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) + 0.0"


@query(f"WITH s AS (SELECT {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), c AS (SELECT sim, sum(n) OVER (ORDER BY sim) AS upto, sum(n) OVER () AS t FROM (SELECT sim, count(*) AS n FROM s GROUP BY 1)), n AS (SELECT vec_id AS x, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings), p AS (SELECT x, y, {_COS} AS sim FROM n JOIN embeddings a ON a.vec_id = x JOIN embeddings b ON b.vec_id = y) SELECT x, y, p.sim, round(coalesce(c.upto, 0) / (SELECT max(t) FROM c), 6) AS below FROM p LEFT JOIN c ON c.sim = (SELECT max(sim) FROM c WHERE c.sim < p.sim)")
def similarity_percentile(spark, sf):
    """Where the likeness of each vector to the next of its label stands among the likenesses of the stated query set to all others."""
    vectors = table(spark, sf, "embeddings")
    successor = F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id"))
    pairs = vectors.select(F.col("vec_id").alias("x"), successor.alias("y")).where("y is not null")
    return samples.pair_percentiles(vectors.where("vec_id % 20 = 0"), vectors, pairs, "vec_id", "embedding")


@query("WITH r AS (SELECT event_id, user_id, event_type, value, list(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM events) SELECT event_id, round(list_median(e), 6) AS median FROM r")
def expanding_median(spark, sf):
    return samples.expanding_median(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "median")


_CONCEPT = "t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM t)"


@query(f"WITH {_CONCEPT}, w AS (SELECT doc_id, term, round(tf * ln(n / df), 6) AS w FROM t JOIN df USING (term), n WHERE df >= 2 AND df <= 0.5 * n) SELECT doc_id, term, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS k FROM w) WHERE k <= 5")
def concepts(spark, sf):
    from quillon.plans.tables import lexical

    return samples.concepts(lexical(spark, sf)[1], "doc_id", 5, 2, 0.5)


@query(f"WITH {GOLD_SQL} SELECT g.item_id, count(*) AS lines, min(doc_id) AS first FROM gold g GROUP BY 1")
def candidate_pools(spark, sf):
    """Targets that can be answered, with all documents that observe them."""
    return samples.pools(gold(spark, sf), "item_id", "doc_id").select("item_id", F.size("lines").cast("bigint").alias("lines"), F.element_at("lines", 1).alias("first"))


@query("SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '-?\\b[0-9]+(?:\\.[0-9]+)?\\b'), lambda x: x <> ''), lambda x: CAST(x AS DOUBLE))[1] AS first, len(regexp_extract_all(text, '-?\\b[0-9]+(?:\\.[0-9]+)?\\b')) AS n FROM (SELECT doc_id, 'value ' || (doc_id * 7 % 1000) || ' and -' || (doc_id % 13) || '.5 of ' || n_chars AS text FROM documents)")
def number_parser(spark, sf):
    """The SQL has the texts without their dates and times, which are no numbers."""
    text = F.concat(F.lit("value "), (F.col("doc_id") * 7 % 1000).cast("string"), F.lit(" at 18:05 on 2024-03-05 and -"), (F.col("doc_id") % 13).cast("string"), F.lit(".5, half past six, of "), F.col("n_chars").cast("string"))
    return table(spark, sf, "documents").withColumn("x", parse.numbers(text)).select("doc_id", F.col("x")[0].alias("first"), F.size("x").cast("bigint").alias("n"))


@query("SELECT doc_id, list_filter([CASE WHEN h < 24 THEN h * 60 + m END, (w * 60 + 30) % 1440, (w + 12 * (w < 12)::INT) * 60 - 15, (w % 12) * 60, 720], lambda x: x IS NOT NULL)::VARCHAR AS times FROM (SELECT doc_id, doc_id % 26 AS h, doc_id % 60 AS m, doc_id % 12 + 1 AS w FROM documents)")
def clock_time_parser(spark, sf):
    """All times of texts made of each document's id: one maybe out of range, two in words, one with a half of the day, one by name."""
    word = F.element_at(F.array(*[F.lit(w) for w in parse.UNITS[1:13]]), (F.col("doc_id") % 12 + 1).cast("int"))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    w = (F.col("doc_id") % 12 + 1).cast("string")
    text = F.concat(F.lit("On 2024-03-05 at "), pad(F.col("doc_id") % 26), F.lit(":"), pad(F.col("doc_id") % 60), F.lit(" or half past "), word, F.lit(", quarter to "), w, F.lit(" pm, "), w, F.lit(" am and noon of May 5"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("["), F.array_join(F.transform(parse.clock_times(text), lambda x: x.cast("string")), ", "), F.lit("]")).alias("times"))



@query(f"SELECT id, hour(valid_from) * 60 + minute(valid_from) AS minutes, CAST(CAST(valid_from AS DATE) AS VARCHAR) AS day FROM ({FACTS_SQL})")
def clock_parser(spark, sf):
    """Times and dates written out in words and read back."""
    ts = F.col("ts").cast("timestamp")
    said = F.concat(F.lit("at "), F.date_format(ts, "h:mm a"), F.lit(" on "), F.date_format(ts, "d MMMM yyyy"))
    return table(spark, sf, "events").withColumn("said", said).select(F.col("event_id").alias("id"), parse.minutes(F.col("said")).cast("bigint").alias("minutes"), parse.date_of(F.col("said")).cast("string").alias("day"))


@query("SELECT event_id, event_type AS answer, CASE WHEN event_id % 130 <= 100 THEN CAST(event_id % 130 AS INTEGER) END AS confidence FROM events")
def answer_parser(spark, sf):
    said = F.concat("event_type", F.lit("  CONF: "), (F.col("event_id") % 130).cast("string"))
    return audit.conf_fields(table(spark, sf, "events").withColumn("said", said), "event_id", "said")


@query("WITH p AS (SELECT a.p_partkey, lower(a.p_name) AS x, lower(b.p_name) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT p_partkey, CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE round(1 - levenshtein(x, y) / greatest(length(x), length(y)), 6) END AS likeness FROM p")
def title_similarity(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return parts.join(after, "p_partkey").select("p_partkey", parse.title_likeness(F.col("p_name"), F.col("other")).alias("likeness"))


@query(f"SELECT doc_id, CAST(CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2 AS INTEGER) AS fold, sha256('key' || doc_id) AS sealed_id FROM documents")
def sealed_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.fold_of(F.col("doc_id"), 2).alias("fold"), F.sha2(F.concat(F.lit("key"), F.col("doc_id").cast("string")), 256).alias("sealed_id"))


@query(f"WITH {TOKENS_SQL}, {BM25_SQL.format(dl='dl')}, a AS ({RANKED_SQL.format(k=5)}), jn AS (SELECT item_id, doc_id, count(*) AS inter FROM qt JOIN posts USING (term) GROUP BY ALL), qs AS (SELECT item_id, count(*) AS qn FROM qt GROUP BY 1), ds AS (SELECT doc_id, count(*) AS dn FROM posts GROUP BY 1), js AS (SELECT item_id, doc_id, round(inter / (qn + dn - inter), 6) AS score FROM jn JOIN qs USING (item_id) JOIN ds USING (doc_id)), b AS ({RANKED_SQL.format(k=5).replace('FROM scored', 'FROM js')}), x AS (SELECT 'bm25' AS arm, false AS scoped, * FROM a UNION ALL SELECT 'jaccard', false, * FROM b UNION ALL SELECT 'bm25', true, * FROM a WHERE doc_id % 2 = item_id % 2 UNION ALL SELECT 'jaccard', true, * FROM b WHERE doc_id % 2 = item_id % 2) SELECT arm, scoped, count(*) AS rows, count(DISTINCT item_id) AS items FROM x GROUP BY 1, 2")
def scope_factorial(spark, sf):
    """Two rankings, with and without the query's scope: a 2 x 2 of arms."""
    arms = {"bm25": _top5(spark, sf), "jaccard": cut(jaccard_topk(spark, sf), "top5")}
    return controls.factorial(arms, F.col("doc_id") % 2 == F.col("item_id") % 2, "item_id")
