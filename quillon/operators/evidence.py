"""Evidence: lookups, visibility, anchors, addresses, plans over facts, candidate pools and their rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions.text import ascii_tokens, lower_each
from quillon.sources.index import cut


def lookup(rows: DataFrame, ids: DataFrame, key: str, supersedes: str) -> DataFrame:
    """The rows with the asked ids, and is_active: whether nothing supersedes them. Unknown ids give no row."""
    asked = rows.join(ids.select(key).distinct(), key, "left_semi")
    gone = rows.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("__gone")).distinct()
    return asked.join(gone, asked[key] == gone["__gone"], "left").withColumn("is_active", F.col("__gone").isNull()).drop("__gone")


def visible_counts(calls: DataFrame, facts: DataFrame, scope: str, call: str, at: str, start: str, end: str) -> DataFrame:
    """call and candidates: the facts of the call's scope that began before it and were not yet replaced.

    Starts, ends and calls are one stream of +1, -1 and questions, summed by one window a scope: no call meets every fact.
    """
    moves = facts.select(scope, F.col(start).alias("__t"), F.lit(2).alias("__o"), F.lit(1).alias("__d"), F.lit(None).cast(calls.schema[call].dataType).alias(call))
    ends = facts.where(F.col(end).isNotNull()).select(scope, F.col(end).alias("__t"), F.lit(0).alias("__o"), F.lit(-1).alias("__d"), F.lit(None).cast(calls.schema[call].dataType).alias(call))
    asks = calls.select(scope, F.col(at).alias("__t"), F.lit(1).alias("__o"), F.lit(0).alias("__d"), call)
    w = Window.partitionBy(scope).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return moves.unionByName(ends).unionByName(asks).withColumn("candidates", F.sum("__d").over(w)).where(F.col(call).isNotNull()).select(call, "candidates")


def trusted_valid(ranked: DataFrame, records: DataFrame, doc: str, trusted: Column, valid: Column) -> DataFrame:
    """The ranked rows whose record is trusted and valid at the query's time; ranks stay what they were."""
    return ranked.join(records.where(trusted & valid).select(doc).distinct(), doc, "left_semi")


def without_held_out(ranked: DataFrame, held_out: DataFrame, doc: str, same_family: Column) -> DataFrame:
    """The ranked rows without documents that are held out and without those of the query's own family."""
    return ranked.where(~same_family).join(held_out.select(doc).distinct(), doc, "left_anti")


def anchors(questions: DataFrame, names: DataFrame, key: str, name: str, most: int = 16, words: int = 3) -> DataFrame:
    """key and anchors: the names that stand in the question as whole words, longest first, then by name, at most `most`.

    Questions are cut into runs of up to `words` tokens that meet the names by equality, so no question is searched for every name.
    """
    q = questions.select(key, ascii_tokens(F.col("text")).alias("t"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col("t"), i, F.lit(n)), " "))
    parts = q.select(key, F.explode(F.array_distinct(F.concat(*map(runs, range(1, words + 1))))).alias("name"))
    known = names.select(F.lower(F.col(name)).alias("name")).distinct()
    found = parts.join(known, "name").withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(F.length("name").desc(), "name"))).where(F.col("i") <= most)
    return found.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), ",").alias("anchors"))


#: Protected content, by kind.
PRIVATE = {"mail": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", "phone": r"\+?[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}", "card": r"\b[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}\b", "key": r"AKIA[A-Z0-9]{14,}"}


def private_parts(rows: DataFrame, key: str, text: str, kinds: dict[str, str] = PRIVATE) -> DataFrame:
    """key and, of each kind of protected content, how many stand in the text; rows without any are left out."""
    counted = rows.select(key, *[F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).cast("bigint").alias(k) for k, p in kinds.items()])
    return counted.where(" or ".join(f"{k} > 0" for k in kinds))


def snippets(pairs: DataFrame, query: str, doc: str, text: str, terms: str, width: int = 24) -> DataFrame:
    """query, doc, snippet and hits: the `width` tokens with the most of the query's terms (the first of equals), each found one in brackets."""
    rows = pairs.select(query, doc, ascii_tokens(F.col(text)).alias("__t"), F.col(terms).alias("__q")).withColumn("__h", F.transform("__t", lambda x: F.array_contains("__q", x).cast("int")))
    # hits of the window from i on: running sums differ by `width` places
    sums = F.aggregate("__h", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumn("__s", sums)
    last = F.greatest(F.size("__t") - width + 1, F.lit(1))
    scored = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct((F.element_at(F.col("__s"), F.least(i + width, F.size("__s"))) - F.element_at(F.col("__s"), i)).alias("n"), (-i).alias("i")))
    rows = rows.withColumn("__best", F.array_max(scored))
    shown = F.transform(F.slice("__t", -F.col("__best.i"), F.lit(width)), lambda x: F.when(F.array_contains("__q", x), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return rows.select(query, doc, F.array_join(shown, " ").alias("snippet"), F.col("__best.n").cast("bigint").alias("hits"))


def match_query(text: Column) -> Column:
    """The tokens as a query of alternatives, each quoted and once; null for a text without tokens, which asks for nothing."""
    tokens = F.array_distinct(ascii_tokens(text))
    return F.when(F.size(tokens) > 0, F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def expanded(query_terms: DataFrame, glossary: DataFrame, query: str) -> DataFrame:
    """The query's terms and the glossary's expansions (token, term) of them, each once; added says which are new."""
    more = query_terms.join(glossary.select(F.col("token").alias("term"), F.col("term").alias("__more")), "term").select(query, F.col("__more").alias("term"))
    every = query_terms.select(query, "term", F.lit(False).alias("added")).unionByName(more.withColumn("added", F.lit(True)))
    return every.groupBy(query, "term").agg(F.min("added").alias("added"))


def skip_bigrams(rows: DataFrame, key: str, text: str, reach: int = 2) -> DataFrame:
    """key, term and tf: tokens, and pairs of tokens at most `reach` places apart, in order."""
    t = rows.select(key, ascii_tokens(F.col(text)).alias("t"))
    at = lambda i: F.get(F.col("t"), i)
    places = F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0)))
    pairs = lambda d: F.filter(F.transform(places, lambda i: F.when(i + d < F.size("t"), F.concat(at(i), F.lit(" "), at(i + d)))), lambda x: x.isNotNull())
    return t.select(key, F.explode(F.concat(F.col("t"), *map(pairs, range(1, reach + 1)))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def recalled(facts: DataFrame, scope: str, address: list[str], recorded: str, key: str, known_at: Column, limit: int) -> DataFrame:
    """The newest facts of each address that were recorded by `known_at`, at most `limit` (1 to 50), and truncated: whether there are more."""
    limit = max(1, min(50, limit))
    w = Window.partitionBy(scope, *address).orderBy(F.col(recorded).desc(), F.col(key).desc())
    rows = facts.where(F.col(recorded) <= known_at).withColumns({"place": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(scope, *address))})
    return rows.where(F.col("place") <= limit).withColumn("truncated", F.col("__n") > limit).drop("__n")


def catalog(facts: DataFrame, scope: str, predicate: str, recorded: str, known_at: Column) -> DataFrame:
    """scope and predicate: what is visible in each scope at `known_at`."""
    return facts.where(F.col(recorded) <= known_at).select(scope, predicate).distinct()


def grounded(proposals: DataFrame, text: str, span: str) -> DataFrame:
    """Adds actual (the span as it stands in the text: itself, or its first occurrence in another case) and grounded."""
    exact, folded = F.expr(f"locate(`{span}`, `{text}`)"), F.position(lower_each(F.col(span)), lower_each(F.col(text)))
    actual = F.when(exact > 0, F.col(span)).when(folded > 0, F.substring(F.col(text), folded, F.length(F.col(span))))
    return proposals.withColumn("actual", F.when(F.length(F.col(span)) > 0, actual)).withColumn("grounded", F.col("actual").isNotNull())


def execute_plan(facts: DataFrame, starts: DataFrame, plan: list[tuple[str, str]], start: str = "start", branch_limit: int | None = 2000) -> DataFrame:
    """start, status, answers: what a plan of at most six steps (predicate, out or in) reaches from each start.

    facts: subject, predicate, object. Status is none, found, ambiguous, or branch_limit where a step reaches more than so many (None: no limit). A start
    that has passed the limit goes no further.

    Starts that stand at the same nodes after a step are one class from there on, named by the digest of its nodes: a class takes the next step once,
    however many starts it has.
    """
    if not 1 <= len(plan) <= 6 or any(way not in ("out", "in") for _, way in plan):
        raise ValueError("a plan has one to six steps, each out or in")
    placed = starts.select(start, F.col(start).cast("string").alias("class"), F.lit(False).alias("over")).where(F.col(start).isNotNull()).distinct()
    here = starts.select(F.col(start).cast("string").alias("class"), F.col(start).alias("at")).where("at is not null").distinct()
    for predicate, way in plan:
        source, target = ("subject", "object") if way == "out" else ("object", "subject")
        edges = facts.where(F.col("predicate") == predicate).select(F.col(source).alias("at"), F.col(target).alias("next")).distinct()
        sets = here.join(edges, "at").groupBy("class").agg(F.sort_array(F.collect_set("next")).alias("nodes")).where(F.size("nodes") > 0)
        over = F.lit(False) if branch_limit is None else F.size("nodes") > branch_limit
        sets = cut(sets.select("class", F.sha2(F.to_json("nodes"), 256).alias("to"), over.alias("past"), F.when(~over, F.col("nodes")).alias("nodes")), "plan")
        moved = placed.where("not over").join(sets.select("class", "to", "past"), "class").select(start, F.col("to").alias("class"), F.col("past").alias("over"))
        placed = moved.unionByName(placed.where("over"))
        ends = sets.where("not past").groupBy(F.col("to").alias("class")).agg(F.first("nodes").alias("nodes"))
        here = ends.select("class", F.explode("nodes").alias("at"))
    told = ends.select("class", F.array_join("nodes", ",").alias("answers"), F.size("nodes").alias("n"))
    reached = starts.select(start).distinct().join(placed, start, "left").join(told, "class", "left")  # the answers come last: they are long
    status = F.when(F.col("over"), "branch_limit").when(F.coalesce("n", F.lit(0)) == 0, "none").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return reached.select(start, status.alias("status"), F.coalesce("answers", F.lit("")).alias("answers"))


def plans_from(facts: DataFrame, starts: DataFrame, start: str = "start", hops: int = 6, most: int = 96) -> DataFrame:
    """start, plan and truncated: the distinct sequences of outgoing predicates, at most `hops` long, by which a start reaches something without
    coming back to a node; at most `most` a start, shorter ones first, then by name."""
    edges = facts.select(F.col("subject").alias("at"), "predicate", F.col("object").alias("next")).distinct()
    here = starts.select(start, F.col(start).alias("at"), F.array(F.col(start)).alias("seen"), F.lit("").alias("plan")).distinct()
    found = None
    for hop in range(1, hops + 1):
        step = here.join(edges, "at").where(~F.array_contains("seen", F.col("next")))
        here = step.select(start, F.col("next").alias("at"), F.concat("seen", F.array("next")).alias("seen"), F.when(F.col("plan") == "", F.col("predicate")).otherwise(F.concat_ws(">", "plan", "predicate")).alias("plan"))
        level = here.select(start, "plan", F.lit(hop).alias("hops")).distinct()
        found = level if found is None else found.unionByName(level)
    ranked = found.withColumns({"i": F.row_number().over(Window.partitionBy(start).orderBy("hops", "plan")), "n": F.count("*").over(Window.partitionBy(start))})
    return ranked.where(F.col("i") <= most).select(start, "plan", (F.col("n") > most).alias("truncated"))


def follow_latest(edges: DataFrame, starts: DataFrame, hops: int, start: str = "start") -> DataFrame:
    """start, hops and last: where the latest edges (at, next, one a node) lead in at most `hops` steps; a node without one ends the chain."""
    here = starts.select(start, F.col(start).alias("last"), F.lit(0).alias("hops")).distinct()
    one = edges.select(F.col("at").alias("last"), F.col("next").alias("__next"))
    for _ in range(hops):
        moved = here.join(one, "last", "left")
        here = moved.select(start, F.coalesce("__next", "last").alias("last"), (F.col("hops") + F.col("__next").isNotNull().cast("int")).alias("hops"))
    return here


def path_class(reached: Column, hops_latest: Column, anchored: Column) -> Column:
    """The class of an answer by its path: hops_latest is an array of whether each hop is the latest of its slot."""
    last = F.try_element_at(hops_latest, F.lit(-1))
    return F.when(~anchored, "NO_ANCHOR").when(~reached, "UNREACHABLE").when(F.forall(hops_latest, lambda x: x), "CONSISTENT").when(~last, "SUPERSEDED_FINAL_HOP").otherwise("SUPERSEDED_INTERMEDIATE_HOP")


def second_hop(ranked: DataFrame, search: Callable[[DataFrame], DataFrame], texts: DataFrame, query: str, doc: str, most: int = 1) -> DataFrame:
    """The ranked rows and, behind them, at most `most` unseen hits of a search with the first one's text; hop says which.

    search: from (query, term) to (query, doc, rank).
    """
    first = ranked.where("rank = 1").select(query, doc).join(texts, doc)
    terms = first.select(query, F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("term"))
    unseen = search(terms).join(ranked.select(query, doc), [query, doc], "left_anti")
    last = ranked.groupBy(query).agg(F.max("rank").alias("__last"))
    new = unseen.withColumn("__i", F.row_number().over(Window.partitionBy(query).orderBy("rank", doc))).where(F.col("__i") <= most)
    new = new.join(last, query).select(query, doc, (F.col("__last") + F.col("__i")).alias("rank"), F.lit(2).alias("hop"))
    return ranked.select(query, doc, "rank", F.lit(1).alias("hop")).unionByName(new)


def siblings(context: DataFrame, query: str, category: str, entity: str) -> DataFrame:
    """query, category and entities: the categories of a context in which at least two different entities stand."""
    grouped = context.groupBy(query, category).agg(F.array_sort(F.collect_set(entity)).alias("e"))
    return grouped.where(F.size("e") >= 2).select(query, category, F.array_join("e", ",").alias("entities"))


def interleaved(lists: DataFrame, query: str, anchor: str, doc: str, most: int = 16) -> DataFrame:
    """query, doc and place: candidates of several lists (query, anchor, list, rank, doc), merged: within an anchor by rank and list, across
    anchors in turn; a document counts once, where it first stands; at most `most` a query."""
    within = lists.withColumn("__p", F.row_number().over(Window.partitionBy(query, anchor).orderBy("rank", "list", doc)))
    once = within.groupBy(query, doc).agg(F.min(F.struct("__p", anchor)).alias("__at"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("__at", doc)))
    return placed.where(F.col("place") <= most).select(query, doc, "place")


def pool(lists: dict[str, DataFrame], query: str, doc: str, m: int) -> DataFrame:
    """query, doc and methods: the union of each method's first m, and decisive: whether not all of them have it."""
    every = None
    for name, ranked in lists.items():
        part = ranked.where(F.col("rank") <= m).select(query, doc, F.lit(name).alias("method"))
        every = part if every is None else every.unionByName(part)
    grouped = every.groupBy(query, doc).agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"), F.countDistinct("method").alias("__n"))
    return grouped.select(query, doc, "methods", (F.col("__n") < len(lists)).alias("decisive"))


def look_ahead(ranked: DataFrame, task: str, candidate: str) -> DataFrame:
    """The rows whose candidate does not lie before its task: there must be none."""
    return ranked.where(F.col(candidate) >= F.col(task))


def resolved_aliases(texts: DataFrame, aliases: DataFrame, key: str, tokens: str, alias: str, entity: str, most: int = 5) -> DataFrame:
    """key, start (a token's place, from 1), length, alias, entity and entities: the aliases in each text, leftmost first and of those the longest, without
    overlaps. An alias of several entities is ambiguous: entity is null, entities says how many.

    texts: an array of tokens a row; aliases: tokens joined by blanks, at most `most` of them. Runs of tokens meet aliases on the phrase itself, so no text is
    compared with all aliases; only the spans found are folded, in order, a text at a time.
    """
    known = aliases.where(F.col(alias).isNotNull() & F.col(entity).isNotNull()).groupBy(F.col(alias).alias("__a")).agg(F.countDistinct(entity).alias("entities"), F.min(entity).alias("__e"))
    rows = texts.select(key, F.col(tokens).alias("__t"))
    runs = rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(most)))).where(F.size("__t") >= F.col("__n"))
    phrases = runs.select(key, "__n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("__t") - F.col("__n") + 1), lambda i: F.array_join(F.slice(F.col("__t"), i, F.col("__n")), " "))).alias("__p", "__a"))
    spans = phrases.join(known, "__a").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("__p").alias("p"), (-F.col("__n")).alias("n"), F.col("__a").alias("a"), F.col("entities").alias("k"), F.col("__e").alias("e")))).alias("l"))
    kind = spans.schema["l"].dataType.elementType
    start = F.struct(F.lit(0).alias("upto"), F.array().cast(f"array<{kind.simpleString()}>").alias("out"))
    step = lambda acc, x: F.when(x["p"] >= acc["upto"], F.struct((x["p"] - x["n"]).alias("upto"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    taken = spans.select(key, F.explode(F.aggregate("l", start, step, lambda acc: acc["out"])).alias("s"))
    return taken.select(key, (F.col("s.p") + 1).alias("start"), (-F.col("s.n")).alias("length"), F.col("s.a").alias("alias"), F.when(F.col("s.k") == 1, F.col("s.e")).alias("entity"), F.col("s.k").alias("entities"))
