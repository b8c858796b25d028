"""Ranked retrieval: lexical, dense and fused. All rankings end in one deterministic order: score (9 or 6 digits), then id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.sources.index import Index, by_range, cut, flat, index_of, postings, removed, scale  # noqa: F401

from .measures import running


def lengths(posts: DataFrame | Index, key: str) -> DataFrame:
    return posts.docs if isinstance(posts, Index) else posts.groupBy(key).agg(F.sum("tf").alias("dl"))


def statistics(posts: DataFrame | Index, key: str) -> DataFrame:
    """One row: n and avgdl over the documents that have a term."""
    return posts.stats if isinstance(posts, Index) else lengths(posts, key).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def frequencies(posts: DataFrame | Index) -> DataFrame:
    return posts.terms if isinstance(posts, Index) else posts.groupBy("term").agg(F.count("*").alias("df"))


def top(scored: DataFrame, k: int, query: str, doc: str, positive: bool = True) -> DataFrame:
    """Adds rank and keeps the first k of each query."""
    kept = scored.where("score > 0") if positive else scored
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(doc)))).where(F.col("rank") <= k)


def _one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the single row of corpus statistics."""
    return df.crossJoin(F.broadcast(one))  # one row


def _live(bounds: DataFrame, exact, query: str, k: int, digits: int) -> DataFrame:
    """query, range: the ranges of documents that may hold one of a query's k best.

    bounds: query, range and bound (no document of the range scores more). The range of the greatest bound is scored in full; its k-th best
    score is one that the k-th best of all has at least, so ranges with a lesser bound are out. exact(ranges) scores the documents of ranges.
    """
    bounds = cut(bounds, "bounds")
    first = bounds.groupBy(query).agg(F.max_by("range", F.struct("bound", "range")).alias("range"))
    placed = exact(first).where("score is not null").withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc()))).where(F.col("r") <= k)
    floor = placed.groupBy(query).agg(F.when(F.count("*") == k, F.min("score")).otherwise(0.0).alias("floor"))
    slack = 10.0 ** -digits * 2  # scores are compared rounded
    return bounds.join(floor, query, "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - slack).select(query, "range")


#: Postings that a set of queries may ask for before ranges are bounded first; below it, reading them all at once is as good. The results are the same.
AT_ONCE = 2_000_000_000
#: Weights (query and term) that every task may hold.
HELD = 2_000_000
#: Queries that are summed up side by side over a range of documents.
TOGETHER = 2048


def gathered(weights: DataFrame, ix: Index, query: str, fields: tuple[str, ...], aggregates: list[Column], live: DataFrame | None = None) -> DataFrame:
    """query, doc and aggregates over the postings (with `fields` of them, and the weights' columns) of the terms that a query and a document share.

    The asked blocks are dealt once, by their range of documents, and meet the queries there: a block moves once, whoever asks for it, and a document's score
    is summed where its range is, so neither blocks nor pairs are exchanged for each query. live (query, range): the only ranges of a query to read.
    weights must be a table that is cheap to read. More than HELD of them are joined by term and not held by every task.
    """
    weights, more = weights.drop("df"), [c for c in weights.columns if c not in ("term", "df")]
    held = F.broadcast if weights.count() <= HELD else (lambda df: df)
    blocks = ix.asked(weights).select("term", "df", "range", "at", "tf").join(held(weights.select("term").distinct()), "term", "left_semi")
    if live is not None:
        blocks = blocks.join(held(live.select("range").distinct()), "range", "left_semi")
    met = blocks.repartition(ix.ranges, "range").join(held(weights), "term")
    if live is not None:
        met = met.join(held(live), [query, "range"], "left_semi")
    return flat(met, ix, "range", *more, fields=fields).groupBy("range", query, ix.key).agg(*aggregates).drop("range")


def _summed(weights: DataFrame, ix: Index, query: str, k: int, fields: tuple[str, ...], impact: Callable, one: str | None, slack: float, live: DataFrame | None) -> DataFrame:
    """query, doc and score (not rounded) of the documents that are among a query's k best of their range, or less than slack behind.

    Blocks and their range's documents are dealt by range (and by queries, where there are more than TOGETHER); there the scores of all queries are a matrix, to
    which a block adds its postings' impacts times its queries' weights. So what leaves a range is k rows a query, and no pair is a row before.
    """
    asked = weights.groupBy(query, "term").agg(F.sum("__w").alias("__w"), *([F.first(one).alias("one")] if one else []))
    parts = -(-asked.select(query).distinct().count() // TOGETHER) or 1
    part = F.pmod(F.xxhash64(query), F.lit(parts)) if parts > 1 else F.lit(0).cast("bigint")
    asks = asked.groupBy("term", part.alias("part")).agg(F.collect_list(query).alias("asks"), F.collect_list("__w").alias("w"), *([F.first("one").alias("one")] if one else []))
    held = F.broadcast if weights.count() <= HELD else (lambda df: df)
    unit = scale(ix.n) if "unit" in fields else F.lit(None).cast("double")
    told, key = {"dl": "dl", "dn": "dn", "unit": "norm"}, ix.key
    own = [told[f] for f in fields if f in told]
    blocks, rows = ix.asked(weights).join(held(asks), "term"), ix.told(own)
    if live is not None:
        blocks, rows = (df.join(held(live.select("range").distinct()), "range", "left_semi") for df in (blocks, rows))
    deal = (F.col("range") * parts + F.col("part")).alias("deal")
    blocks = blocks.select(deal, "at", "tf", "asks", "w", F.col("one") if one else F.lit(None).cast("double").alias("one"), unit.alias("scale"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).select(deal, "keys", *own)
    both = blocks.unionByName(rows, allowMissingColumns=True).repartition(ix.ranges * parts, "deal").sortWithinPartitions("deal", F.col("keys").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in by_range(batches):
            table = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            docs, met = table.slice(0, 1), table.slice(1)  # the documents come first
            if not len(met):
                continue
            keys, asks = docs["keys"].flatten(), met["asks"].flatten().dictionary_encode(null_encoding="encode")
            sizes, at, w, q = pc.list_value_length(met["at"]).to_numpy(), met["at"].flatten().to_numpy(), met["w"].flatten().to_numpy(), asks.indices.to_numpy()
            posts = {name: docs[name].flatten().to_numpy()[at] for name in own} | {"tf": met["tf"].flatten().to_numpy()}
            if "norm" in posts:
                posts["unit"] = (1 + np.log(posts["tf"])) * np.repeat(met["scale"].to_numpy(zero_copy_only=False), sizes) / posts["norm"]
            if one:
                posts["one"] = np.repeat(met["one"].to_numpy(zero_copy_only=False), sizes)
            gain = np.broadcast_to(impact(posts, np.minimum), at.shape)
            spots, places = (np.cumsum([0, *n]) for n in (sizes, pc.list_value_length(met["asks"]).to_numpy()))
            scores = np.zeros((len(asks.dictionary), len(keys)))
            for a, b, c, d in zip(spots[:-1], spots[1:], places[:-1], places[1:]):
                scores[q[c:d, None], at[a:b]] += w[c:d, None] * gain[a:b]  # a document stands once in a block, and so does a query
            floor = np.partition(scores, -k, axis=1)[:, -k:].min(1, keepdims=True) if len(keys) > k else np.zeros((len(scores), 1))
            found, doc = np.nonzero((scores > 0) & (scores >= floor - slack))
            yield pa.RecordBatch.from_arrays([asks.dictionary.take(pa.array(found)), keys.take(pa.array(doc)), pa.array(scores[found, doc])], names=[query, key, "score"])

    kinds = weights.schema[query].dataType.simpleString(), ix.docs.schema[ix.key].dataType.simpleString()
    return both.mapInArrow(run, f"`{query}` {kinds[0]}, `{ix.key}` {kinds[1]}, score double")


def best(weights: DataFrame, ix: Index, impact: Column | Callable, bound: Column, query: str, k: int, fields: tuple[str, ...], digits: int = 6, at_once: int | None = None, one: str | None = None) -> DataFrame:
    """query, doc and score of at least the k best documents of each query, by score and then id, in full.

    weights: query, term, __w, and what impact needs besides. A document's score is the sum of __w * impact over the query's terms that it has, if that is positive;
    impact is an expression over a posting (its `fields` out of tf, dl, dn, unit), bound one over a block that no posting of it exceeds. Where it is the same for all
    queries, impact is given as a function of the fields (and of `one`, a column of weights with one number for all) and of least(), over columns or arrays alike,
    and scores are summed by _summed(). Only the index's partitions
    of the queries' terms are read; where they hold very many postings, blocks are first summed up by their bounds, and ranges that cannot
    hold one of the k best are never unpacked.
    """
    over = impact({f: F.col(f) for f in fields} | ({"one": F.col(one)} if one else {}), F.least) if callable(impact) else impact
    score = F.round(F.sum(F.col("__w") * over), digits).alias("score")
    if ix.blocks is None:
        return ix.posts.join(weights.drop("df"), "term").groupBy(query, ix.key).agg(score)
    weights = cut(weights, "weights")
    if callable(impact):
        exact = lambda ranges=None: _summed(weights, ix, query, k, fields, impact, one, 10.0 ** -digits * 2, ranges).withColumn("score", F.round("score", digits))
    else:
        exact = lambda ranges=None: gathered(weights, ix, query, fields, [score], ranges)
    if _asked(weights, ix) <= (AT_ONCE if at_once is None else at_once):
        return exact()
    blocks = ix.asked(weights).join(weights.drop("df"), "term")
    return exact(_live(blocks.groupBy(query, "range").agg(F.sum(F.col("__w") * bound).alias("bound")), exact, query, k, digits))


def _asked(weights: DataFrame, ix: Index) -> int:
    """How many postings the queries ask for."""
    return weights.select("term").join(ix.terms, "term").agg(F.sum("df")).first()[0] or 0


def every(weights: DataFrame, ix: Index, query: str, fields: tuple[str, ...], *aggregates: Column) -> DataFrame:
    """query, doc and aggregates of every pair with a common term."""
    if ix.blocks is None:
        return ix.of(weights).join(weights.drop("df"), "term").groupBy(query, ix.key).agg(*aggregates)
    return gathered(cut(weights, "weights"), ix, query, fields, list(aggregates))


def _bm25_weights(query_terms: DataFrame, ix: Index, query: str) -> DataFrame:
    """query, term, w (idf ln(1 + (n - df + .5) / (df + .5))) and avgdl."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _one_row(query_terms.select(query, "term").distinct().join(ix.terms, "term"), ix.stats).select(query, "term", idf.alias("__w"), "avgdl")


def _bm25_gain(k1: float, b: float, cap: float | None = None) -> Callable:
    """The impact of best(): over columns, or over arrays."""

    def gain(post: dict, least: Callable):
        length = post["dl"] if cap is None else least(post["dl"] * 1.0, cap * post["one"])
        return post["tf"] * (k1 + 1) / (post["tf"] + k1 * (1 - b + b * length / post["one"]))

    return gain


def _bm25_impact(k1: float, b: float, cap: float | None, tf: str = "tf", dl: str = "dl") -> Column:
    return _bm25_gain(k1, b, cap)({"tf": F.col(tf), "dl": F.col(dl), "one": F.col("avgdl")}, F.least)


def bm25(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str, k1: float = 1.2, b: float = 0.75, cap: float | None = None, digits: int = 6) -> DataFrame:
    """query, doc and score of every pair with a common term. cap: document lengths count as at most cap * avgdl."""
    ix = index_of(posts, doc)
    weights = _bm25_weights(query_terms, ix, query)
    return every(weights, ix, query, ("tf", "dl"), F.round(F.sum(F.col("__w") * _bm25_impact(k1, b, cap)), digits).alias("score"))


def bm25_top(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str, k: int, k1: float = 1.2, b: float = 0.75, cap: float | None = None, digits: int = 6, at_once: int | None = None) -> DataFrame:
    """query, doc, score and rank: the k best of bm25(), without unpacking the postings of documents that cannot be among them."""
    ix = index_of(posts, doc)
    return top(best(_bm25_weights(query_terms, ix, query), ix, _bm25_gain(k1, b, cap), _bm25_impact(k1, b, cap, "most_tf", "least_dl"), query, k, ("tf", "dl"), digits, at_once, "avgdl"), k, query, doc)


def bm25_fields_top(query_terms: DataFrame, fields: list[tuple[Index, float]], query: str, doc: str, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """query, doc, score and rank: the k best sums of the fields' weighted bm25(). The fields' indexes are written and have the same ranges of documents, so that all
    fields of a document meet in its range and no pairs are exchanged."""
    asks, parts = [], []
    for i, (ix, _) in enumerate(fields):
        w = cut(_bm25_weights(query_terms, ix, query).withColumn("field", F.lit(i)), "weights")
        held = F.broadcast if w.count() <= HELD else (lambda df: df)
        asks.append(w)
        parts.append(ix.asked(w).join(held(w.select("term").distinct()), "term", "left_semi").select("term", "df", "range", "at", "tf", F.lit(i).alias("field")))
    weights, blocks, documents = asks[0], parts[0], fields[0][0].rows.withColumn("field", F.lit(0))
    for i in range(1, len(fields)):
        weights, blocks, documents = weights.unionByName(asks[i]), blocks.unionByName(parts[i]), documents.unionByName(fields[i][0].rows.withColumn("field", F.lit(i)))
    every = replace(fields[0][0], rows=documents, ranges=max(ix.ranges for ix, _ in fields), n=sum(ix.n for ix, _ in fields))
    met = blocks.repartition(every.ranges, "range").join(held(weights), ["field", "term"])
    rows = flat(met, every, "range", "field", query, "__w", "avgdl", fields=("tf", "dl"), on=("range", "field"))
    part = lambda i: F.round(F.sum(F.when(F.col("field") == i, F.col("__w") * _bm25_impact(k1, b, None))), digits)
    score = sum((F.coalesce(part(i), F.lit(0.0)) * weight for i, (_, weight) in enumerate(fields)), F.lit(0.0))
    return top(rows.groupBy("range", query, doc).agg(F.round(score, digits).alias("score")), k, query, doc).drop("range")


def _coverage_weights(query_terms: DataFrame, ix: Index, query: str) -> DataFrame:
    """query, term and w: the share of each term in the idf mass of its query."""
    df = F.coalesce("df", F.lit(0))
    idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
    weighted = _one_row(query_terms.select(query, "term").distinct().join(ix.terms, "term", "left"), ix.stats).select(query, "term", idf.alias("idf"))
    return weighted.withColumn("__w", F.col("idf") / F.sum("idf").over(Window.partitionBy(query))).drop("idf")


def idf_coverage(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str) -> DataFrame:
    """The idf mass of the query's terms found in the document, over that of all its terms."""
    ix = index_of(posts, doc)
    weights = _coverage_weights(query_terms, ix, query)
    return every(weights, ix, query, (), F.round(F.sum("__w"), 6).alias("score"))


def idf_coverage_top(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str, k: int, at_once: int | None = None) -> DataFrame:
    ix = index_of(posts, doc)
    return top(best(_coverage_weights(query_terms, ix, query), ix, lambda post, least: 1.0, F.lit(1.0), query, k, (), at_once=at_once), k, query, doc)


def _tfidf_weights(query_terms: DataFrame, ix: Index, query: str) -> DataFrame:
    """query, term and w: the query's vector of (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), of length 1."""
    x = (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    rows = _one_row(query_terms.join(ix.terms, "term"), ix.stats).withColumn("x", x)
    return rows.select(query, "term", (F.col("x") / F.sqrt(F.sum(F.col("x") ** 2).over(Window.partitionBy(query)))).alias("__w"))


def tfidf_cosine(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str) -> DataFrame:
    """Cosine of (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) vectors."""
    ix = index_of(posts, doc)
    weights = _tfidf_weights(query_terms, ix, query)
    return every(weights, ix, query, ("unit",), F.round(F.sum(F.col("__w") * F.col("unit")), 6).alias("score"))


def tfidf_top(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str, k: int, at_once: int | None = None) -> DataFrame:
    ix = index_of(posts, doc)
    # A document's norm is at least the root of its different terms, as no term weighs less than 1.
    most = F.least(F.lit(1.0), (1 + F.log("most_tf")) * scale(ix.n) / F.sqrt("least_dn"))
    return top(best(_tfidf_weights(query_terms, ix, query), ix, lambda post, least: post["unit"], most, query, k, ("unit",), at_once=at_once), k, query, doc)


def _set_weights(query_terms: DataFrame, query: str) -> DataFrame:
    """query, term, w (1) and qn, the query's terms."""
    return query_terms.select(query, "term").distinct().select(query, "term", F.lit(1).alias("__w"), F.count("*").over(Window.partitionBy(query)).alias("qn"))


def _set_share(both: Column, dn: Column) -> Column:
    return both / (F.col("qn") + dn - both)


def _both() -> list[Column]:
    return [F.count("*").alias("both"), F.first("qn").alias("qn"), F.first("dn").alias("dn")]


def jaccard(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str) -> DataFrame:
    """Set Jaccard of terms."""
    ix, weights = index_of(posts, doc), _set_weights(query_terms, query)
    both = every(weights, ix, query, ("dn",), *_both())
    return both.select(query, doc, F.round(_set_share(F.col("both"), F.col("dn")), 6).alias("score"))


def jaccard_top(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str, k: int, at_once: int | None = None) -> DataFrame:
    """query, doc, score and rank: the k best of jaccard(). A range of documents with m of the query's terms, the shortest of them of d different
    terms, has no document beyond m / (|q| + max(d, m) - m)."""
    ix, weights = index_of(posts, doc), _set_weights(query_terms, query)
    if ix.blocks is None:
        return top(jaccard(query_terms, ix, query, doc), k, query, doc)
    weights = cut(weights, "weights")

    def exact(ranges: DataFrame | None = None) -> DataFrame:
        rows = gathered(weights, ix, query, ("dn",), _both(), ranges)
        return rows.select(query, doc, F.round(_set_share(F.col("both"), F.col("dn")), 6).alias("score"))

    if _asked(weights, ix) <= (AT_ONCE if at_once is None else at_once):
        return top(exact(), k, query, doc)
    sums = ix.asked(weights).join(weights, "term").groupBy(query, "range").agg(F.count("*").alias("m"), F.first("qn").alias("qn"), F.min("least_dn").alias("d"))
    bounds = sums.select(query, "range", _set_share(F.col("m"), F.greatest("d", "m")).alias("bound"))
    return top(exact(_live(bounds, exact, query, k, 6)), k, query, doc)


def dense_top(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, earlier_only: bool = False, block: int = 2048) -> DataFrame:
    """query, doc, score and rank: the k vectors of greatest cosine for each query, other than itself (earlier_only: with a lesser key).

    Queries and vectors are dealt in blocks; each pair of blocks is one matrix product, of which the k best a query go on. Null and
    zero vectors match nothing.
    """
    count = lambda df: max(1, -(-df.count() // block))
    nq, nv = count(queries), count(vectors)
    q = queries.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.lit(True).alias("asks"), F.pmod(F.xxhash64(key), F.lit(nq)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nv - 1))).alias("j"))
    d = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"), F.pmod(F.xxhash64(key), F.lit(nv)).alias("j"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["v"].map(lambda v: v is not None and len(v) > 0 and np.linalg.norm(v) > 0)]
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("k")
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "doc": [], "score": []}).astype({"query": "int64", "doc": "int64", "score": "float64"})
        unit = lambda s: (m := np.stack(s.to_numpy()).astype(np.float64)) / np.linalg.norm(m, axis=1, keepdims=True)
        scores = np.round(unit(a["v"]) @ unit(b["v"]).T, 6)
        ak, bk = a["k"].to_numpy(), b["k"].to_numpy()
        scores[ak[:, None] <= bk[None, :] if earlier_only else ak[:, None] == bk[None, :]] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(scores, order, axis=1)
        rows, cols = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"query": ak[rows], "doc": bk[order[rows, cols]], "score": best[rows, cols] + 0.0})

    pairs = q.unionByName(d).groupBy("i", "j").applyInPandas(tile, "query bigint, doc bigint, score double")
    return top(pairs, k, "query", "doc", positive=False)


def without(posts: DataFrame | Index, gone: DataFrame, doc: str) -> Index:
    """The index without some documents; lengths, counts and statistics follow."""
    ix = index_of(posts, doc)
    if ix.blocks is not None:
        return removed(ix, gone)
    return index_of(ix.posts.select(doc, "term", "tf").join(gone.select(doc).distinct(), doc, "left_anti"), doc)


def reciprocal_rank_fusion(lists: list[DataFrame], query: str, doc: str, constant: int = 60, digits: int = 9) -> DataFrame:
    """Sum of 1 / (constant + rank) over the lists."""
    every = lists[0].select(query, doc, "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select(query, doc, "rank"))
    return every.groupBy(query, doc).agg(F.round(F.sum(1 / (constant + F.col("rank"))), digits).alias("score"))


def agreement_gate(a: DataFrame, b: DataFrame, query: str, doc: str, least: float) -> DataFrame:
    """query, jaccard of the two lists, same_top, answers: whether both agree enough."""
    x = a.groupBy(query).agg(F.collect_set(doc).alias("x"), F.min_by(doc, "rank").alias("xt"))
    y = b.groupBy(query).agg(F.collect_set(doc).alias("y"), F.min_by(doc, "rank").alias("yt"))
    both = F.size(F.array_intersect("x", "y"))
    j = F.round(both / (F.size("x") + F.size("y") - both), 6)
    return x.join(y, query).select(query, j.alias("jaccard"), (F.col("xt") == F.col("yt")).alias("same_top"), ((j >= least) & (F.col("xt") == F.col("yt"))).alias("answers"))


def demoted(ranked: DataFrame, superseded: DataFrame, query: str, doc: str) -> DataFrame:
    """Superseded documents move behind the others, both in their order."""
    gone = superseded.select(F.col(doc).alias("__g")).distinct()
    marked = ranked.join(gone, ranked[doc] == gone["__g"], "left").withColumn("late", F.col("__g").isNotNull())
    return marked.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy("late", "rank"))).drop("__g")


def fire_set(scores: DataFrame, key: str, q: float) -> DataFrame:
    """The ceil(q * n) rows of greatest score (ties by key); rows of score -infinity or null never fire."""
    total = scores.agg(F.count("*").alias("n"))
    ranked = running(scores, "score", {"place": F.lit(1)}, tie=key, descending=True)
    return _one_row(ranked, total).where((F.col("place") <= F.ceil(F.round(q * F.col("n"), 9))) & F.col("score").isNotNull() & (F.col("score") > float("-inf"))).drop("n")


def visible_bm25_counts(posts: DataFrame, doc: str, order: str) -> DataFrame:
    """For each posting, how many earlier documents have its term: document counts under strict causal visibility, from one
    cumulative window a term instead of a join of every query with every document."""
    return posts.withColumn("df_before", F.count("*").over(Window.partitionBy("term").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)))


def sums_before(rows: DataFrame, probes: DataFrame, keys: list[str], at: str, sums: dict[str, Column], segment: Column) -> DataFrame:
    """The probes with, for each of `sums`, its sum over the rows of the same keys that lie strictly before the probe's `at`.

    Sums are kept by segment of `at` (an expression over it that grows with it): a probe reads the sum of all earlier segments, one row each, and
    merges with the rows of its own segment alone. So no window holds more than a segment, and no probe is paired with rows.
    """
    events = rows.select(*keys, at, F.lit(1).alias("__row"), *[v.cast("double").alias(f"__{k}") for k, v in sums.items()], F.lit(None).cast("bigint").alias("__probe"))
    asked = probes.withColumn("__probe", F.xxhash64(*keys, at))
    marks = asked.select(*keys, at, F.lit(0).alias("__row"), *[F.lit(0.0).alias(f"__{k}") for k in sums], "__probe").distinct()
    every = events.unionByName(marks).withColumn("__segment", segment)
    inside = Window.partitionBy(*keys, "__segment").orderBy(at, "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = every.withColumns({f"__in_{k}": F.sum(f"__{k}").over(inside) for k in sums}).where("__probe is not null")
    whole = every.groupBy(*keys, "__segment").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    before = Window.partitionBy(*keys).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    earlier = whole.select(*keys, "__segment", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0.0)).alias(f"__to_{k}") for k in sums])
    found = within.join(earlier, [*keys, "__segment"]).select(*keys, at, *[(F.col(f"__in_{k}") + F.col(f"__to_{k}")).alias(k) for k in sums])
    return probes.join(found, [*keys, at])


def visible_statistics(asked: DataFrame, posts: DataFrame | Index, query: str, doc: str, segments: int = 256) -> DataFrame:
    """query, term, cutoff, n, avgdl and df: the statistics of the documents with a lesser key than the query's cutoff, those that it may see.

    asked: query, term, cutoff. Keys are whole numbers that grow with time; segments of them only steer the work.
    """
    ix = index_of(posts, doc)
    asked = asked.select(query, "term", F.col("cutoff").cast("bigint").alias("cutoff")).distinct()
    low, high = ix.docs.agg(F.min(doc), F.max(doc)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // segments))
    segment = F.floor((F.least("cutoff", F.lit((high or 0) + 1)) - F.lit(low or 0)) / width)
    at = F.col(doc).cast("bigint").alias("cutoff")
    times = asked.select(query, "cutoff").distinct()
    corpus = sums_before(ix.docs.select(at, "dl", F.lit(0).alias("__all")), times.withColumn("__all", F.lit(0)), ["__all"], "cutoff", {"n": F.lit(1), "total": F.col("dl")}, segment).drop("__all")
    terms = sums_before(ix.of(asked).select("term", at), asked, ["term"], "cutoff", {"df": F.lit(1)}, segment)
    return terms.join(corpus, [query, "cutoff"]).select(query, "term", "cutoff", "n", (F.col("total") / F.col("n")).alias("avgdl"), "df")


def visible_bm25_top(asked: DataFrame, posts: DataFrame | Index, query: str, doc: str, k: int, k1: float = 1.2, b: float = 0.75, segments: int = 256, at_once: int | None = None) -> DataFrame:
    """query, doc, score and rank: BM25 over the documents that a query may see (a lesser key than its cutoff), with their statistics alone."""
    ix = index_of(posts, doc)
    seen = visible_statistics(asked, ix, query, doc, segments).where("df > 0")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(seen.select(query, "term", "cutoff", "avgdl", idf.alias("__w")), "visible")
    impact = F.when(F.col(doc) < F.col("cutoff"), _bm25_impact(k1, b, None))
    return top(best(weights, ix, impact, _bm25_impact(k1, b, None, "most_tf", "least_dl"), query, k, ("tf", "dl"), at_once=at_once), k, query, doc)


def hashed_embedding(tokens: Column, dims: int = 64) -> Column:
    """Bucket weights of unigrams (1.0) and bigrams (0.5) by a hash; map bucket -> weight."""
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(dims)).cast("int")
    singles = F.transform(tokens, lambda t: F.struct(bucket(t).alias("k"), F.lit(1.0).alias("w")))
    doubles = F.when(F.size(tokens) > 1, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.struct(bucket(F.array_join(F.slice(tokens, i, F.lit(2)), " ")).alias("k"), F.lit(0.5).alias("w")))).otherwise(F.array().cast("array<struct<k:int,w:double>>"))
    every = F.concat(singles, doubles)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(every, F.lit(0.0), lambda acc, x: acc + F.when(x["k"] == d, x["w"]).otherwise(0.0)))
