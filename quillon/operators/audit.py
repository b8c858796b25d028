"""Audits: the invariants of an append-only log, open questions in it, gates of instruments, scorers of answers, commitments."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import parse
from quillon.sources.index import cut

from .measures import ratio, running

# Fixed values of the log's schema.
REQUIRED = ("id", "operation", "kind", "title", "created_at", "confidence", "status")
ENUMS = {
    "operation": ("create", "supersede"),
    "kind": ("candidate", "constraint", "decision", "failure", "finding", "hypothesis", "procedure", "question", "session"),
    "confidence": ("unknown", "low", "medium", "high"),
}
CLAIM_CLASSES, SUPERSESSION_KINDS = ("dispositional", "state", "unclassified"), ("succession", "correction", "unclassified")
EVIDENCE_KINDS = ("finding", "failure")
DERIVED = ("valid_to", "expired_at")
ID_FORM, TIME_FORM = r"^PM-\d{8}-[0-9a-f]{8}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def _time(c: str) -> Column:
    return F.when(F.col(c).rlike(TIME_FORM), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def row_violations(log: DataFrame) -> DataFrame:
    """line, id and rule of what a row breaks by itself. log: line, the schema's fields as strings, source_refs as an array."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    among = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    supersedes = F.coalesce(F.col("operation") == "supersede", F.lit(False))
    rules: list[tuple[str, Column]] = [(f"missing-{f}", blank(f)) for f in REQUIRED]
    rules += [("malformed-id", ~blank("id") & ~F.col("id").rlike(ID_FORM))]
    rules += [(f"bad-{f}", ~among(f, values)) for f, values in ENUMS.items()]
    rules += [("bad-timestamp", _time("created_at").isNull()), ("bad-valid-from", ~F.coalesce(F.col("valid_from").rlike(TIME_FORM), F.lit(False))), ("bad-claim-class", ~among("claim_class", CLAIM_CLASSES))]
    rules += [("missing-provenance", among("kind", EVIDENCE_KINDS) & (F.coalesce(F.size("source_refs"), F.lit(0)) <= 0))]
    rules += [("stored-derived-field", F.coalesce(*[F.col(d) for d in DERIVED if d in log.columns]).isNotNull())] if any(d in log.columns for d in DERIVED) else []
    rules += [("bad-supersession-kind", supersedes & ~among("supersession_kind", SUPERSESSION_KINDS)), ("missing-supersedes", supersedes & blank("supersedes"))]
    rules += [("missing-supersession-reason", supersedes & (F.coalesce(F.trim("supersession_reason"), F.lit("")) == ""))]
    broken = F.filter(F.array(*[F.when(broken_, name) for name, broken_ in rules]), lambda x: x.isNotNull())
    return log.select("line", "id", F.explode(broken).alias("rule"))


def log_violations(log: DataFrame) -> DataFrame:
    """line, id and rule of every violation: row_violations(), and what rows break together: ids used before, times before the preceding one,
    links to ids that are not there or come later, and to oneself."""
    named = log.where(F.col("id").isNotNull() & (F.col("id") != ""))
    first = named.groupBy("id").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    again = named.join(first, "id").where(F.col("line") > F.col("first_line")).select("line", "id", F.lit("duplicate-id").alias("rule"))
    timed = running(log.select("line", "id", _time("created_at").alias("t")).where("t is not null"), "line", {"i": F.lit(1)}, tie="line")
    before = timed.select((F.col("i") + 1).alias("i"), F.col("t").alias("before"))
    back = timed.join(before, "i").where("t < before").select("line", "id", F.lit("non-monotonic-time").alias("rule"))
    known = first.select(F.col("id").alias("target"), "first_line")
    links = log.where(F.col("supersedes").isNotNull() & (F.col("supersedes") != "")).select("line", "id", F.col("supersedes").alias("target")).join(known, "target", "left")
    rule = F.when(F.col("first_line").isNull(), "dangling-supersedes").when(F.col("target") == F.col("id"), "self-supersedes").when(F.col("first_line") >= F.col("line"), "forward-supersedes")
    broken = links.withColumn("rule", rule).where("rule is not null").select("line", "id", "rule")
    related = log.select("line", "id", F.explode("related_ids").alias("target")).join(known, "target", "left_anti").select("line", "id", F.lit("dangling-related-id").alias("rule"))
    return row_violations(log).unionByName(again).unionByName(back).unionByName(broken).unionByName(related)


def open_questions(log: DataFrame, now: Column, decision_days: int = 7, hypothesis_days: int = 30) -> DataFrame:
    """id and question: decisions that nothing refers to after `decision_days`, hypotheses unrevised after `hypothesis_days`, events that cite
    a superseded one, and revisions whose kind is unclassified. log as in row_violations()."""
    links = log.select("id", F.explode("related_ids").alias("target")).unionByName(log.where("supersedes is not null").select("id", F.col("supersedes").alias("target")))
    gone = log.where("supersedes is not null").select(F.col("supersedes").alias("id")).distinct()
    age = F.date_diff(now, _time("created_at"))
    asked = lambda rows, name: rows.select("id", F.lit(name).alias("question"))
    pointed = links.select(F.col("target").alias("id")).distinct()
    one = asked(log.where((F.col("kind") == "decision") & (age > decision_days)).join(pointed, "id", "left_anti"), "unreferenced-decision")
    two = asked(log.where((F.col("kind") == "hypothesis") & (age > hypothesis_days)).join(gone, "id", "left_anti"), "stale-hypothesis")
    cites = log.select("id", F.explode("related_ids").alias("target")).join(gone.withColumnRenamed("id", "target"), "target", "left_semi").select("id").distinct()
    three = asked(cites, "cited-superseded")
    four = asked(log.where((F.col("operation") == "supersede") & (F.coalesce("supersession_kind", F.lit("unclassified")) == "unclassified")), "unclassified-revision")
    return one.unionByName(two).unionByName(three).unionByName(four)


def world_violations(entities: DataFrame, facts: DataFrame, key: str, host: str, start: str, end: str, value: str, tolerance: float = 0.5) -> DataFrame:
    """rule and n: entities with an id used twice, facts whose host does not exist, facts that end before they begin, and deciles of the
    value that hold less or more than a tenth of the facts by `tolerance` of it."""
    from .measures import rank_shares

    twice = entities.groupBy(key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate-id").alias("rule"), "n")
    orphans = facts.join(entities.select(F.col(key).alias(host)).distinct(), host, "left_anti").agg(F.count("*").alias("n")).select(F.lit("no-host").alias("rule"), "n")
    inverted = facts.agg(F.count(F.when(F.col(end) < F.col(start), 1)).alias("n")).select(F.lit("ends-before-start").alias("rule"), "n")
    shares = rank_shares(facts, value).groupBy("decile").agg(F.count("*").alias("c"))
    total = shares.agg(F.sum("c").alias("t"))
    uneven = shares.crossJoin(F.broadcast(total)).agg(F.count(F.when(F.abs(F.col("c") / F.col("t") - 0.1) > 0.1 * tolerance, 1)).alias("n")).select(F.lit("uneven-decile").alias("rule"), "n")  # one row
    return twice.unionByName(orphans).unionByName(inverted).unionByName(uneven)


def banded(values: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """gate, value and passes: whether each column of the one row lies in its band; unknown values do not pass."""
    rows = [F.struct(F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"), F.coalesce(F.col(name).between(low, high), F.lit(False)).alias("passes")) for name, (low, high) in bands.items()]
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.gate", F.round("g.value", 6).alias("value"), "g.passes")


def headroom(scores: DataFrame, arm: str, family: str, value: str, chosen: str, least: float, least_items: int) -> DataFrame:
    """One row: chosen (its macro mean over families), best (the best other arm's), headroom, fewest (items of the smallest family) and passes."""
    each = scores.groupBy(arm, family).agg(F.avg(value).alias("m"), F.count("*").alias("n"))
    macro = each.groupBy(arm).agg(F.avg("m").alias("m"), F.min("n").alias("n"))
    t = macro.agg(F.max(F.when(F.col(arm) == chosen, F.col("m"))).alias("chosen"), F.max(F.when(F.col(arm) != chosen, F.col("m"))).alias("best"), F.min("n").alias("fewest"))
    gap = F.col("chosen") - F.col("best")
    return t.select(F.round("chosen", 6).alias("chosen"), F.round("best", 6).alias("best"), F.round(gap, 6).alias("headroom"), "fewest", F.coalesce((F.round(gap, 9) >= least) & (F.col("fewest") >= least_items), F.lit(False)).alias("passes"))


def digest_of_rows(rows: DataFrame) -> DataFrame:
    """One row: n and digest of the rows, whatever their order: two builds agree if theirs do."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("digest"))


#: The stages of a run, in order; the first that failed is the cause.
STAGES = ("F0", "F1", "F2", "F3", "F4", "F5")


def first_failure(flags: dict[str, Column]) -> Column:
    """The first stage whose flag is false; none if all hold. Unknown flags do not hold."""
    out = None
    for stage in STAGES:
        if stage in flags:
            failed = ~F.coalesce(flags[stage], F.lit(False))
            out = F.when(failed, stage) if out is None else out.when(failed, stage)
    return out.otherwise("none")


HEDGES = ("maybe", "perhaps", "possibly", "might", "not sure", "i think")
ABSTAINS = ("unknown", "i don't know", "cannot tell", "no answer")


def scored(answer: Column, gold: Column, aliases: Column, near: Column, vocabulary: Column) -> Column:
    """(correct, error, candidates) of an answer by a closed vocabulary (arrays of lower-case values).

    Candidates are the vocabulary's values that stand in the answer as whole words. Right is an answer whose only candidate is the gold value or
    one of its aliases. Else the error is abstained, unmatched (no candidate), several, near_miss or wrong; a hedged answer with the
    right candidate is right but marked hedged.
    """
    lower = F.lower(F.coalesce(answer, F.lit("")))
    padded = F.concat(F.lit(" "), F.regexp_replace(lower, r"[^a-z0-9]+", " "), F.lit(" "))
    found = F.array_sort(F.array_distinct(F.filter(vocabulary, lambda v: F.contains(padded, F.concat(F.lit(" "), v, F.lit(" "))))))
    # Longest match: a value inside another found one is none of its own.
    found = F.filter(found, lambda v: ~F.exists(found, lambda o: (o != v) & F.contains(F.concat(F.lit(" "), o, F.lit(" ")), F.concat(F.lit(" "), v, F.lit(" ")))))
    wanted = F.concat(F.array(gold), F.coalesce(aliases, F.array().cast("array<string>")))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(lower, w))
    right = (F.size(found) > 0) & F.forall(found, lambda v: F.array_contains(wanted, v))
    error = F.when(right & says(HEDGES), "hedged").when(right, "none").when(says(ABSTAINS) & (F.size(found) == 0), "abstained").when(F.size(found) == 0, "unmatched").when(F.size(found) > 1, "several").when(F.arrays_overlap(found, F.coalesce(near, F.array().cast("array<string>"))), "near_miss").otherwise("wrong")
    return F.struct(right.alias("correct"), error.alias("error"), found.alias("candidates"))


def unsafe_outcomes(rows: DataFrame, arm: str, predicted: str, gold: str) -> DataFrame:
    """arm, n, unsafe_negatives (a firm no where the truth is yes or open), false_closures (a firm answer where the truth is open),
    omissions (open where the truth is yes) and safe_abstentions (open where the truth is open), as shares; null without rows."""
    p, g = F.col(predicted), F.col(gold)
    share = lambda cond: F.round(F.avg(F.coalesce(cond, F.lit(False)).cast("int")), 6)
    return rows.groupBy(arm).agg(
        F.count("*").alias("n"), share((p == "no") & (g != "no")).alias("unsafe_negatives"), share((p != "unknown") & (g == "unknown")).alias("false_closures"),
        share((p == "unknown") & (g == "yes")).alias("omissions"), share((p == "unknown") & (g == "unknown")).alias("safe_abstentions"),
    )


def sealed_side(key: bytes, ids: list[str]) -> dict[str, str]:
    """The side of each id under a key: the parity of the last byte of its HMAC."""
    return {i: "test" if hmac.new(key, i.encode(), hashlib.sha256).digest()[-1] & 1 else "dev" for i in ids}


def sealed(rows: DataFrame, id_: str, key: bytes) -> DataFrame:
    """Adds side (dev or test) by HMAC-SHA-256 of the id: from SHA-256 of the padded key and message, in the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.col(id_).cast("string").cast("binary")), 256))
    second = F.sha2(F.concat(F.lit(outer), first), 256)
    odd = F.conv(F.substring(second, 64, 1), 16, 10).cast("int") % 2 == 1
    return rows.withColumn("side", F.when(odd, "test").otherwise("dev"))


def commitment(split: DataFrame, id_: str, side: str, key: bytes) -> tuple[str, str]:
    """(digest of the key, digest of the split): published when a split is sealed. revealed() checks both."""
    row = digest_of_rows(split.select(id_, side)).first()
    return hashlib.sha256(key).hexdigest(), row["digest"]


def revealed(rows: DataFrame, id_: str, key: bytes, published: tuple[str, str]) -> DataFrame:
    """The split under a revealed key; a key or a split other than what was committed is an error."""
    split = sealed(rows, id_, key)
    if commitment(split, id_, "side", key) != published:
        raise ValueError("the revealed key or the rows are not what was committed")
    return split


def call_errors(calls: DataFrame, key: str, tool: str, arguments: str, docs: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """key and error of every tool call (arguments: a JSON object) that does not fit its tool's parameters (name -> (type, required))."""
    parsed = F.from_json(F.col(arguments), "map<string,string>")
    rows = calls.select(key, F.col(tool).alias("t"), parsed.alias("a"))
    errors = [F.when(~F.coalesce(F.col("t").isin(*docs), F.lit(False)), F.array(F.lit("unknown tool")))]
    errors.append(F.when(F.col("a").isNull(), F.array(F.lit("no object"))))
    for name, parameters in docs.items():
        own = [F.when(F.col("a")[p].isNull(), F.lit(f"missing {p}")) for p, (_, required) in parameters.items() if required]
        own += [F.when(F.col("a")[p].isNotNull() & F.col("a")[p].try_cast(kind).isNull(), F.lit(f"{p} is no {kind}")) for p, (kind, _) in parameters.items() if kind != "string"]
        extra = F.transform(F.array_sort(F.array_except(F.map_keys("a"), F.array(*map(F.lit, parameters)))), lambda x: F.concat(F.lit("unknown "), x))
        errors.append(F.when((F.col("t") == name) & F.col("a").isNotNull(), F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()) if own else F.array().cast("array<string>"), extra)))
    every = F.flatten(F.filter(F.array(*errors), lambda x: x.isNotNull()))
    return rows.select(key, F.explode(every).alias("error"))


def arm_summary(rows: DataFrame, arm: str, status: str, tokens: str) -> DataFrame:
    """arm, n, solved, errors and tokens."""
    count = lambda value: F.count(F.when(F.col(status) == value, 1))
    return rows.groupBy(arm).agg(F.count("*").alias("n"), count("solved").alias("solved"), count("error").alias("errors"), F.sum(tokens).alias("tokens"))


def gained_and_lost(pairs: DataFrame, unit: str) -> DataFrame:
    """unit and change: units that b solves and a does not (gained), and the other way (lost)."""
    return pairs.where("a <> b").select(unit, F.when(F.col("b") > F.col("a"), "gained").otherwise("lost").alias("change"))


def fabricated(reviews: DataFrame, shown: DataFrame, key: str, text: str, item: str, pattern: str) -> DataFrame:
    """key and item: what a review cites (by pattern, one group) though it was not shown to it."""
    cited = reviews.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias(item))
    return cited.join(shown.select(key, F.col(item).cast("string").alias(item)).distinct(), [key, item], "left_anti")


def shown_cost(ranked: DataFrame, texts: DataFrame, query: str, doc: str, words: Column, depths: tuple[int, ...]) -> DataFrame:
    """depth, queries, words and missing: the words of what is shown at each depth, and how many shown documents have no text."""
    rows = ranked.join(texts.withColumn("__w", words), doc, "left").withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).where(F.col("rank") <= F.col("depth"))
    return rows.groupBy("depth").agg(F.countDistinct(query).alias("queries"), F.coalesce(F.sum("__w"), F.lit(0)).cast("bigint").alias("words"), F.count(F.when(F.col("__w").isNull(), 1)).alias("missing"))


def recall_by(ranked: DataFrame, gold: DataFrame, arms: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """arm, queries and recall: the share of queries of each arm (query, arm) with a gold document in their first k."""
    hit = ranked.where(F.col("rank") <= k).join(gold.select(query, doc).distinct(), [query, doc], "left_semi").select(query, F.lit(1).alias("hit")).distinct()
    asked = arms.join(gold.select(query).distinct(), query, "left_semi").join(hit, query, "left")
    return asked.groupBy("arm").agg(F.count("*").alias("queries"), F.round(ratio(F.sum(F.coalesce("hit", F.lit(0))), F.count("*")), 6).alias("recall"))


def conf_fields(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, answer and confidence of lenient answers."""
    return rows.withColumn("__f", parse.answer_fields(F.col(text))).select(key, "__f.answer", "__f.confidence")


def greedy_match(gold: DataFrame, predicted: DataFrame, case: str, node: str, terms: str) -> DataFrame:
    """case, gold, predicted and overlap: nodes of a case matched one to one, the pairs of the greatest Jaccard first (ties by name).

    Pairs meet on shared terms. In rounds, each node proposes to its best free partner and mutual proposals are taken: the same pairs as one after the
    other in order, as the best pair left is always mutual, and no node's best partner can be lost to a lesser pair. No case is gathered.
    """
    g = gold.select(case, F.col(node).alias("g"), F.array_distinct(F.col(terms)).alias("gt"))
    p = predicted.select(case, F.col(node).alias("p"), F.array_distinct(F.col(terms)).alias("pt"))
    meet = g.select(case, "g", F.size("gt").alias("gn"), F.explode("gt").alias("x")).join(p.select(case, "p", F.size("pt").alias("pn"), F.explode("pt").alias("x")), [case, "x"])
    both = meet.groupBy(case, "g", "p").agg((F.count("*") / (F.first("gn") + F.first("pn") - F.count("*"))).alias("o"))
    free = cut(both.select(case, "g", "p", (-F.round("o", 6)).alias("o")), "pairs")
    taken = None
    while True:
        best = lambda end: free.groupBy(case, end).agg(F.min(F.struct("o", "g", "p")).alias("m")).select(case, "m.*")  # noqa: B023, E731
        mutual = cut(best("g").join(best("p"), [case, "o", "g", "p"]), "matched")
        taken = mutual if taken is None else taken.unionByName(mutual)
        if mutual.isEmpty():
            return taken.select(case, F.col("g").alias("gold"), F.col("p").alias("predicted"), (-F.col("o")).alias("overlap"))
        free = cut(free.join(mutual.select(case, "g"), [case, "g"], "left_anti").join(mutual.select(case, "p"), [case, "p"], "left_anti"), "pairs")


def violations_between(rows: DataFrame, other: DataFrame) -> DataFrame:
    """One row: only_first and only_second, rows of one table that the other has not (with repeats): an arm that should not depend on
    something gives the same rows with and without it."""
    one = rows.exceptAll(other).agg(F.count("*").alias("only_first"))
    two = other.exceptAll(rows).agg(F.count("*").alias("only_second"))
    return one.crossJoin(two)  # one row each
