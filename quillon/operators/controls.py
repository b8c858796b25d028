"""Controls, calibrations and profiles around retrieval studies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.sources.index import Index, cut, index_of

from .measures import ratio
from .ranking import best, top


def term_scorer(query_terms: DataFrame, posts: DataFrame | Index, query: str, doc: str, k: int) -> DataFrame:
    """query, doc, score, rank: each query term that a document has weighs ln((n + 1) / (m + 1)) + 1 for m documents with it."""
    ix = index_of(posts, doc)
    rows = query_terms.select(query, "term").distinct().join(ix.terms, "term").crossJoin(F.broadcast(ix.stats))  # one row
    weight = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return top(best(rows.select(query, "term", weight.alias("__w")), ix, lambda post, least: 1.0, F.lit(1.0), query, k, ()), k, query, doc)


def field_weighted(fields: dict[str, tuple[DataFrame, float]], query: str, doc: str) -> DataFrame:
    """query, doc, score: the weighted sum of per-field scores."""
    every = None
    for scored, weight in fields.values():
        part = scored.select(query, doc, (F.col("score") * weight).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(query, doc).agg(F.round(F.sum("part"), 6).alias("score"))


def max_ratio(a: DataFrame, b: DataFrame, query: str, doc: str, tau_a: float, tau_b: float) -> DataFrame:
    """query, doc, strength: the greater of two scores over their thresholds; 1 or more passes the gate."""
    both = a.select(query, doc, F.col("score").alias("a")).join(b.select(query, doc, F.col("score").alias("b")), [query, doc], "full_outer")
    return both.select(query, doc, F.round(F.greatest(F.coalesce("a", F.lit(0.0)) / tau_a, F.coalesce("b", F.lit(0.0)) / tau_b), 9).alias("strength"))


def names(text: Column) -> Column:
    """Distinct capitalised runs of three ASCII letters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), lambda x: x.rlike("^[A-Z][a-z]{2,}$")))


def rare_name_hits(queries: DataFrame, docs: DataFrame, query: str, doc: str, most: int) -> DataFrame:
    """query, doc, hits: documents that capitalise a query's capitalised words which at most `most` documents do."""
    q, d = queries.select(query, F.explode(names(F.col("text"))).alias("name")), docs.select(doc, F.explode(names(F.col("text"))).alias("name"))
    rare = d.groupBy("name").agg(F.count("*").alias("df")).where(F.col("df") <= most).select("name")
    return d.join(rare, "name").join(q, "name").groupBy(query, doc).agg(F.count("*").alias("hits"))


def mode_so_far(rows: DataFrame, group: str, order: str, value: str, key: str) -> DataFrame:
    """key and guess: the value that the group's earlier rows have most often, ties by value; null for the first.

    Each row carries the counts of all values so far as a map of running counts, one row a (row, value of the group).
    """
    kinds = rows.select(group, value).distinct().withColumnRenamed(value, "__v")
    grid = rows.join(kinds, group)
    w = Window.partitionBy(group, "__v").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = grid.withColumn("__c", F.coalesce(F.sum((F.col(value) == F.col("__v")).cast("int")).over(w), F.lit(0)))
    best = counted.groupBy(key).agg(F.max("__c").alias("__m"), F.min_by("__v", F.struct(-F.col("__c"), F.col("__v"))).alias("guess"))
    return best.select(key, F.when(F.col("__m") > 0, F.col("guess")).alias("guess"))


def self_retrieval(ranked: DataFrame, own: DataFrame, query: str, doc: str) -> DataFrame:
    """One row: queries, top1 and top3 shares of the queries whose own document is found there."""
    hit = own.join(ranked.select(query, doc, "rank"), [query, doc], "left").groupBy(query).agg(F.min("rank").alias("r"))
    share = lambda k: F.round(F.avg((F.coalesce("r", F.lit(1 << 30)) <= k).cast("int")), 6)
    return hit.agg(F.count("*").alias("queries"), share(1).alias("top1"), share(3).alias("top3"))


def firing_threshold(best: DataFrame, score: str, share: float) -> DataFrame:
    """One row: threshold (the score that the given share of queries reaches) and fires (their count)."""
    cut = best.agg(F.expr(f"percentile_disc({1 - share}) WITHIN GROUP (ORDER BY {score})").alias("threshold"))
    return best.crossJoin(F.broadcast(cut)).groupBy("threshold").agg(F.sum((F.col(score) >= F.col("threshold")).cast("bigint")).alias("fires"))  # one row


def cadence(rows: DataFrame, day: Column, text: str) -> DataFrame:
    """One row: days, mean, median, least and most rows a day, and rows whose exact text came before."""
    per_day = rows.groupBy(day.alias("d")).agg(F.count("*").alias("n")).agg(F.count("*").alias("days"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.expr("percentile(n, 0.5)"), 6).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))
    twice = rows.groupBy(F.sha2(text, 256)).agg((F.count("*") - 1).alias("e")).agg(F.sum("e").alias("repeats"))
    return per_day.crossJoin(F.broadcast(twice))  # one row each


def win_rates(judged: DataFrame, task: str) -> DataFrame:
    """task, rate: the mean over both orders of whether `a` won (ties count half). judged: task, order, winner a / b / tie."""
    point = F.when(F.col("winner") == "a", 1.0).when(F.col("winner") == "tie", 0.5).otherwise(0.0)
    each = judged.groupBy(task, "order").agg(F.avg(point).alias("p"))
    return each.groupBy(task).agg(F.round(F.avg("p"), 6).alias("rate"))


def over_dispersion(rows: DataFrame, group: str, label: str) -> DataFrame:
    """One row: d, Pearson's dispersion of group shares against one binomial (1 is none); null for one group."""
    each = rows.groupBy(group).agg(F.count(label).alias("n"), F.sum(label).alias("k"))
    w = Window.partitionBy(F.lit(0))
    p = F.sum("k").over(w) / F.sum("n").over(w)
    parts = each.withColumn("p", p).withColumn("x", (F.col("k") - F.col("n") * F.col("p")) ** 2 / (F.col("n") * F.col("p") * (1 - F.col("p"))))
    return parts.agg(F.round(ratio(F.sum("x"), F.count("*") - 1), 6).alias("d"))


def dispersion_p(rows: DataFrame, group: str, label: str, draws: int = 500, seed: int = 29) -> DataFrame:
    """One row: d, groups and p: over_dispersion() and how often it is as great under one binomial, by `draws` exact draws (the sample counted).

    A group's k in a draw is the inverse of its binomial's distribution function at a number hashed from seed, draw and group, so draws need no
    order and are the same in every run. A group is a row; what goes on is a partial sum a draw. Distribution functions are summed up around the mean, so
    far that what lies beyond is below 1e-30.
    """
    import hashlib

    each = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count(label).alias("n"), F.sum(label).cast("bigint").alias("k")).where("n > 0")
    total = each.agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.count("*").alias("groups"))
    parts = each.crossJoin(F.broadcast(total)).select("g", "n", "k", (F.col("all_k") / F.col("all_n")).alias("p"))  # one row

    def drawn(frames):
        for pdf in frames:
            out = []
            for g, n, k, p in pdf.itertuples(index=False):
                var = n * p * (1 - p)
                if var <= 0:
                    continue
                low, high = max(0, int(n * p - 13 * var**0.5 - 60)), min(n, int(n * p + 13 * var**0.5 + 60))
                j = np.arange(low, high, dtype=np.float64)
                logs = np.concatenate([[0.0], np.cumsum(np.log((n - j) / (j + 1)) + np.log(p / (1 - p)))])
                mass = np.exp(logs - logs.max())
                upto = np.cumsum(mass / mass.sum())
                us = np.array([int(hashlib.sha256(f"{seed}|{d}|{g}".encode()).hexdigest()[:8], 16) / 4294967296.0 for d in range(draws)])
                ks = np.append(low + np.minimum(np.searchsorted(upto, us, "right"), high - low), k)  # the last is the sample
                out.append(pd.DataFrame({"draw": np.arange(draws + 1), "x": (ks - n * p) ** 2 / var}))
            if out:
                yield pd.concat(out).groupby("draw", as_index=False)["x"].sum()

    sums = parts.mapInPandas(drawn, "draw bigint, x double").groupBy("draw").agg(F.sum("x").alias("x"))
    seen = sums.where(F.col("draw") == draws).select(F.col("x").alias("seen"))
    extreme = sums.where(F.col("draw") < draws).crossJoin(F.broadcast(seen)).agg(F.sum((F.col("x") >= F.col("seen") - 1e-9).cast("int")).alias("k"), F.max("seen").alias("seen"))  # one row
    return total.crossJoin(F.broadcast(extreme)).select(F.round(ratio(F.col("seen"), F.col("groups") - 1), 6).alias("d"), "groups", F.round((1 + F.col("k")) / (draws + 1), 6).alias("p"))  # one row each


def solved_noise(rows: DataFrame, channel: str, signal: str, noise: Column, target: float, observe=lambda x, e, sigma: x + sigma * e, high: float = 64.0, grid: int = 24, passes: int = 6) -> DataFrame:
    """channel, sigma and correlation: the noise of each channel at which what is observed correlates with the signal to `target`.

    Each pass is one aggregation of all channels, which tells the correlations at `grid` noises side by side; the interval between the two around the
    target is the next pass's. observe is any function of signal, noise and sigma for which the correlation falls as sigma grows; target may be
    out of reach (sigma is then 0 or `high`). Bounds are a row a channel.
    """
    known = cut(rows.where(F.col(signal).isNotNull()).select(channel, F.col(signal).cast("double").alias("__x"), noise.alias("__e")), "signals")
    bounds = known.select(channel).distinct().select(channel, F.lit(0.0).alias("__low"), F.lit(float(high)).alias("__high"))
    at = lambda j: F.col("__low") + (F.col("__high") - F.col("__low")) * j / (grid + 1)
    for _ in range(passes):
        seen = known.join(F.broadcast(bounds), channel).groupBy(channel, "__low", "__high").agg(*[F.corr("__x", observe(F.col("__x"), F.col("__e"), at(j))).alias(f"c{j}") for j in range(1, grid + 1)])
        above = sum((F.when(F.coalesce(F.col(f"c{j}"), F.lit(0.0)) >= target, 1).otherwise(0) for j in range(1, grid + 1)), F.lit(0))
        bounds = cut(seen.select(channel, at(above).alias("__low"), at(above + 1).alias("__high")), "bounds")
    middle = (F.col("__low") + F.col("__high")) / 2
    solved = known.join(F.broadcast(bounds), channel).groupBy(channel).agg(F.first(middle).alias("sigma"), F.corr("__x", observe(F.col("__x"), F.col("__e"), middle)).alias("correlation"))
    return solved.select(channel, F.round("sigma", 5).alias("sigma"), F.round("correlation", 6).alias("correlation"))


def _arm(rows: DataFrame, name: str, group: str, item: str, k: int, *order: Column) -> DataFrame:
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)
    return placed.select(F.lit(name).alias("arm"), group, item, "place")


def frequency_arm(rows: DataFrame, group: str, item: str, key: str, k: int) -> DataFrame:
    """arm, group, item and place: the k items of each group whose key it has most often, the latest of equals first. Uses are counted before any
    item is placed, so a hot key is one row a task."""
    uses = rows.groupBy(group, key).agg(F.count("*").alias("__uses"))
    joined = rows.alias("r").join(uses.alias("u"), F.col(f"r.{group}").eqNullSafe(F.col(f"u.{group}")) & F.col(f"r.{key}").eqNullSafe(F.col(f"u.{key}"))).select("r.*", "u.__uses")
    return _arm(joined, "frequency", group, item, k, F.col("__uses").desc(), F.col(item).desc())


def random_arm(rows: DataFrame, group: str, item: str, k: int, seed: int) -> DataFrame:
    """arm, group, item and place: k items of each group by a lot that is the same in every run."""
    return _arm(rows, "random", group, item, k, F.sha2(F.concat(F.lit(f"{seed}|"), F.col(item).cast("string")), 256))


def krippendorff(votes: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: alpha of nominal values of units with two votes or more."""
    cells = votes.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count("*").alias("c"))
    sized = cells.withColumn("m", F.sum("c").over(Window.partitionBy(unit))).where("m > 1")
    observed = sized.agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"))
    margin = sized.groupBy(value).agg(F.sum("c").alias("v")).agg(F.sum(F.col("v") * (F.col("v") - 1)).alias("e"))
    both = observed.crossJoin(F.broadcast(margin))  # one row each
    disagree, expected = 1 - F.col("same") / F.col("n"), 1 - F.col("e") / (F.col("n") * (F.col("n") - 1))
    return both.select(F.round(1 - ratio(disagree, expected), 6).alias("alpha"))


def effect(rows: DataFrame, arm: str, value: str, a: str, b: str) -> DataFrame:
    """One row: d, Cohen's d of two arms with a pooled deviation."""
    of = lambda name, f: f(F.when(F.col(arm) == name, F.col(value)))
    t = rows.agg(of(a, F.count).alias("na"), of(b, F.count).alias("nb"), of(a, F.avg).alias("ma"), of(b, F.avg).alias("mb"), of(a, F.var_samp).alias("va"), of(b, F.var_samp).alias("vb"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return t.select(F.round(ratio(F.col("mb") - F.col("ma"), pooled), 6).alias("d"))


def known_cost(rows: DataFrame, group: str, cost: str) -> DataFrame:
    """group, total, rows, state: a sum of what is known, which is a lower bound where a row is unknown and null where all are."""
    known = F.count(cost)
    return rows.groupBy(group).agg(F.round(F.sum(cost), 4).alias("total"), F.count("*").alias("rows"), F.when(known == F.count("*"), "known").when(known > 0, "lower bound").otherwise("unobserved").alias("state"))


def _cuts(raw: bytes, size: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges of the windows of one UTF-8 text. Places where a character begins come from one pass over the bytes."""
    data = np.frombuffer(raw, np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))
    out, at = [], 0
    while at < len(raw):
        end = int(starts[np.searchsorted(starts, at + size, "right") - 1])  # the last character that fits whole
        if end <= at:
            end = int(starts[np.searchsorted(starts, at, "right")])
        if end < len(raw):
            first, last = np.searchsorted(starts, [at, end])
            low = int(starts[first + 3 * (last - first) // 4])
            for mark in (b"\n", b" "):
                cut = raw.rfind(mark, low, end)
                if cut > at:
                    end = cut + 1
                    break
        out.append((at, end))
        if end == len(raw):
            break
        back = int(starts[np.searchsorted(starts, max(end - overlap, at + 1))])
        at = back if at < back < end else end
    return out


def text_windows(df: DataFrame, key: str, text: str, size: int = 1600, overlap: int = 160) -> DataFrame:
    """key, window, char_start, char_end, byte_start, byte_end, text: windows of at most `size` UTF-8 bytes that overlap by at most `overlap`, cut
    at a line feed or blank in the last quarter where there is one, never within a character. Works on the bytes, in Arrow batches."""
    import pyarrow as pa

    kind = df.schema[key].dataType.simpleString()
    names = [key, "window", "char_start", "char_end", "byte_start", "byte_end", "text"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, places = [], []
                for i, raw in enumerate(part.column(1).to_pylist()):
                    if not raw:
                        continue
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                    for w, (a, b) in enumerate(_cuts(raw, size, overlap)):
                        rows.append((w, int(chars[a]), int(chars[b]), a, b, raw[a:b].decode()))
                        places.append(i)
                if rows:
                    ints = [pa.array(c, pa.int32()) for c in list(zip(*rows))[:5]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(places)), *ints, pa.array([r[5] for r in rows])], names=names)

    schema = f"`{key}` {kind}, window int, char_start int, char_end int, byte_start int, byte_end int, text string"
    return df.select(key, F.col(text).cast("string").cast("binary").alias("__raw")).mapInArrow(run, schema)


def vocabulary_scan(df: DataFrame, key: str, text: str, aliases: dict[str, str]) -> DataFrame:
    """key, start, end, value: the longest alias at each place from left to right, without overlaps, as whole words in any case."""
    import re

    pattern = "(?<!\\w)(?:" + "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a))) + ")(?!\\w)"
    folded = {k.lower(): v for k, v in aliases.items()}

    def run(frames):
        find = re.compile(pattern, re.I)
        for pdf in frames:
            out = [(k, m.start(), m.end(), folded[m[0].lower()]) for k, t in zip(pdf[key], pdf[text]) if t for m in find.finditer(t)]
            yield pdf.__class__(out, columns=[key, "start", "end", "value"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, start int, end int, value string")


def factorial(arms: dict[str, DataFrame], in_scope: Column, query: str) -> DataFrame:
    """arm, scoped, rows and items: every ranking with and without a scope."""
    out = None
    for name, ranked in arms.items():
        for scoped in (False, True):
            part = (ranked.where(in_scope) if scoped else ranked).select(F.lit(name).alias("arm"), F.lit(scoped).alias("scoped"), query)
            out = part if out is None else out.unionByName(part)
    return out.groupBy("arm", "scoped").agg(F.count("*").alias("rows"), F.countDistinct(query).alias("items"))
