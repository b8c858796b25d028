"""Exact tests, intervals and resampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F


def paired(rows: DataFrame, unit: str, arm: str, value: str, a: str, b: str) -> DataFrame:
    """unit, a and b of the units that both arms have."""
    of = lambda name, out: rows.where(F.col(arm) == name).groupBy(unit).agg(F.avg(value).alias(out))
    return of(a, "a").join(of(b, "b"), unit)


def complete_cases(rows: DataFrame, unit: str, arm: str) -> DataFrame:
    """The rows of the units that every arm has."""
    arms = rows.agg(F.countDistinct(arm).alias("__all"))
    full = rows.groupBy(unit).agg(F.countDistinct(arm).alias("__arms")).crossJoin(F.broadcast(arms)).where("__arms = __all")  # one row
    return rows.join(full.select(unit), unit, "left_semi")


def binomial_tail_half(k: Column, n: Column) -> Column:
    """P(X <= k) for n fair coins, by logarithms of its terms."""
    start = n * F.log(F.lit(0.5))
    step = lambda acc, j: F.struct((acc["t"] + F.log((n - j + 1) / j)).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - j + 1) / j))).alias("s"))
    places = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(places, F.struct(start.alias("t"), F.exp(start).alias("s")), step, lambda acc: acc["s"])


def mcnemar(pairs: DataFrame) -> DataFrame:
    """One row: b_only, a_only, p (exact, two-sided) of 0/1 pairs a, b; p is 1 without discordant pairs."""
    t = pairs.agg(F.sum((F.col("a") > F.col("b")).cast("bigint")).alias("a_only"), F.sum((F.col("b") > F.col("a")).cast("bigint")).alias("b_only"))
    k, n = F.least("a_only", "b_only"), F.col("a_only") + F.col("b_only")
    return t.select("a_only", "b_only", F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * binomial_tail_half(k, n)), 6)).otherwise(1.0).alias("p"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of a share; null for n = 0."""
    p = successes / n
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(F.round((mid - half) / scale, 6).alias("low"), F.round((mid + half) / scale, 6).alias("high")))


def wald(pairs: DataFrame, margin: float, z: float = 1.96) -> DataFrame:
    """One row: n, diff, low, high and state of the mean of b - a; a variance of 0 counts as a standard error of 1 / n."""
    d = F.col("b") - F.col("a")
    t = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.var_samp(d).alias("v"))
    se = F.when(F.coalesce("v", F.lit(0.0)) > 0, F.sqrt(F.col("v") / F.col("n"))).otherwise(1 / F.col("n"))
    t = t.withColumns({"low": F.col("m") - z * se, "high": F.col("m") + z * se})
    state = F.when(F.col("low") >= margin, "practical").when(F.col("low") > 0, "positive").when(F.col("high") < 0, "negative").when((F.col("low") > -margin) & (F.col("high") < margin), "equivalent").otherwise("inconclusive")
    return t.select("n", F.round("m", 6).alias("diff"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), state.alias("state"))


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Adds rank, adjusted and rejected; a test without p counts as p = 1; ties by name."""
    q = F.coalesce(p, F.lit(1.0))
    whole = Window.partitionBy(F.lit(0))
    w = whole.orderBy("__q", name)
    rows = tests.withColumn("__q", q).withColumns({"rank": F.row_number().over(w), "__m": F.count("*").over(whole)})
    scaled = F.least(F.lit(1.0), (F.col("__m") - F.col("rank") + 1) * F.col("__q"))
    rows = rows.withColumn("__s", scaled).withColumn("adjusted", F.round(F.max("__s").over(w), 6))
    return rows.withColumn("rejected", F.col("adjusted") <= alpha).drop("__q", "__m", "__s")


def splitmix(seed: int, n: int) -> np.ndarray:
    """n numbers of the splitmix64 stream of a seed (unsigned, modulo 2**64)."""
    x = np.uint64(seed % (1 << 64)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The distribution function of a Poisson variable of mean 1 at 0, 1, 2, ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


def drawn(*parts: Column | str | int) -> Column:
    """The first eight hex digits of SHA-256 of the parts, joined by bars: a number below 2**32 that is the same in every run. Of equal length,
    such strings compare as their numbers do, so none is converted."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 8)


def uniform(*parts: Column | str | int) -> Column:
    """drawn() as a number from 0 (inclusive) to 1."""
    return F.conv(drawn(*parts), 16, 10).cast("double") / 4294967296.0


def times(draw: Column) -> Column:
    """How often a resample takes a unit, from eight hex digits of a digest: Poisson of mean 1."""
    limits = [f"{math.ceil(t * (1 << 32)):08x}" for t in POISSON]
    out = F.when(draw < limits[0], 0)
    for k, limit in enumerate(limits[1:], 1):
        out = out.when(draw < limit, k)
    return out.otherwise(len(limits))


#: Draws that one digest of 64 hex digits decides: eight of eight digits each, or a sign for each of its bits.
EIGHT, SIGNS = 8, 256


def dealt(units: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """units with a row for each block of eight draws: block, and t0 to t7, how often each of them takes the unit. One digest a block."""
    blocks = units.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // EIGHT))))
    hashed = blocks.withColumn("__x", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"), F.col(unit).cast("string")), 256))
    return hashed.select(*units.columns, "block", *[times(F.substring("__x", EIGHT * j + 1, 8)).alias(f"t{j}") for j in range(EIGHT)])


def by_draw(sums: DataFrame, keys: list[str], names: list[str], draws: int) -> DataFrame:
    """keys, draw and names from a row a block, with columns <name>0 to <name>7."""
    each = F.explode(F.array(*[F.struct((F.col("block") * EIGHT + j).alias("draw"), *[F.col(f"{n}{j}").alias(n) for n in names]) for j in range(EIGHT)])).alias("x")
    return sums.select(*keys, each).select(*keys, "x.*").where(F.col("draw") < draws)


def resampled(units: DataFrame, by: list[str], unit: str, num: Column, den: Column, draws: int, seed: int) -> DataFrame:
    """by, draw and value: sum(times * num) / sum(times * den) of each draw.

    Each unit decides by its own hash how often a draw takes it, so every task resamples its rows alone and sends on two sums a group and
    draw; no group is gathered. A digest serves eight draws, whose sums stand side by side in a row.
    """
    rows = dealt(units.select(*by, F.col(unit).alias("__u"), num.alias("__n"), den.alias("__d")), "__u", draws, seed)
    sums = rows.groupBy(*by, "block").agg(*[F.sum(F.col(f"t{j}") * F.col(c)).alias(f"{n}{j}") for j in range(EIGHT) for n, c in (("n", "__n"), ("d", "__d"))])
    return by_draw(sums, by, ["n", "d"], draws).select(*by, "draw", F.when(F.col("d") != 0, F.col("n") / F.col("d")).alias("value")).where("value is not null")


def interval(values: DataFrame, by: list[str], level: float = 0.95) -> DataFrame:
    """by, low and high: the middle `level` of the draws' values, by linear quantiles."""
    tail = (1 - level) / 2
    q = lambda p: F.round(F.expr(f"percentile(value, {p})"), 6)
    return values.groupBy(*by).agg(q(tail).alias("low"), q(1 - tail).alias("high"))


def bootstrap(rows: DataFrame, group: str, order: str, value: str, draws: int = 200, seed: int = 7, block: int = 1) -> DataFrame:
    """group, n, mean, low and high: the 95 % interval of the mean by resampling rows, or runs of `block` neighbours in order (moving
    blocks: the sums of every run are one window over the rows, and runs are what is drawn)."""
    known = rows.where(F.col(value).isNotNull())
    if block > 1:
        run = Window.partitionBy(group).orderBy(order).rowsBetween(0, block - 1)
        units = known.select(group, F.col(order).alias("__o"), F.sum(value).over(run).alias("__s"), F.count("*").over(run).alias("__c"))
        draws_ = resampled(units, [group], "__o", F.col("__s"), F.col("__c"), draws, seed)
    else:
        draws_ = resampled(known, [group], order, F.col(value), F.lit(1), draws, seed)
    means = known.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return means.join(interval(draws_, [group]), group, "left")


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 200, seed: int = 11, pooled: bool = False) -> DataFrame:
    """One row: clusters, mean, low and high of the mean of the clusters' means (pooled: of all rows), by resampling whole clusters."""
    each = rows.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    num, den = (F.col("s"), F.col("c")) if pooled else (F.col("s") / F.col("c"), F.lit(1))
    values = resampled(each.withColumn("__all", F.lit(0)), ["__all"], cluster, num, den, draws, seed)
    mean = each.agg(F.count("*").alias("clusters"), F.round(F.sum(num) / F.sum(den), 6).alias("mean"))
    return mean.crossJoin(F.broadcast(interval(values, ["__all"]).drop("__all")))  # one row


def stratified_bootstrap(pairs: DataFrame, stratum: str, unit: str, draws: int = 200, seed: int = 13) -> DataFrame:
    """One row: diff, low and high of the mean over strata of the mean of b - a, by resampling inside each stratum."""
    d = (F.col("b") - F.col("a")).cast("double")
    values = resampled(pairs, [stratum], unit, d, F.lit(1), draws, seed).groupBy("draw").agg(F.avg("value").alias("value")).withColumn("__all", F.lit(0))
    diff = pairs.groupBy(stratum).agg(F.avg(d).alias("m")).agg(F.round(F.avg("m"), 6).alias("diff"))
    return diff.crossJoin(F.broadcast(interval(values, ["__all"]).drop("__all")))  # one row


#: Rows of an order to a chunk, in which places are told one by one.
CHUNK = 4096


def fired_difference(scores: DataFrame, unit: str, a: str, b: str, hit: str, q: float, draws: int = 200, seed: int = 17) -> DataFrame:
    """One row: diff, low and high of the hits of a's fired share q less those of b's, the fire sets being found anew in each resample: a
    unit taken k times stands k times in the order.

    The units are put in order once, by ranges. A draw sums up chunks of the order; where its fire set ends inside a chunk, that chunk alone is
    gone through, so no task orders a sample.
    """
    from .measures import running

    def hits(score: str) -> DataFrame:
        placed = running(scores.select(unit, score, F.col(hit).cast("int").alias("hit")), score, {"place": F.lit(1)}, tie=unit, descending=True)
        placed = placed.select(F.col(unit).alias("__u"), "hit", "place", F.floor((F.col("place") - 1) / CHUNK).alias("chunk"))
        rows = dealt(placed, "__u", draws, seed)
        sums = rows.groupBy("chunk", "block").agg(*[x for j in range(EIGHT) for x in (F.sum(f"t{j}").alias(f"t{j}"), F.sum(F.col(f"t{j}") * F.col("hit")).alias(f"h{j}"))])
        own = placed.groupBy("chunk").agg(F.count("*").alias("t"), F.sum("hit").alias("h")).select("chunk", F.lit(draws).alias("draw"), "t", "h")  # the last draw is the sample itself
        chunks = by_draw(sums, ["chunk"], ["t", "h"], draws).select("chunk", "draw", "t", "h").unionByName(own)
        along, whole = Window.partitionBy("draw").orderBy("chunk"), Window.partitionBy("draw")  # a row a chunk
        ends = chunks.withColumns({"total": F.sum("t").over(whole), "upto": F.sum("t").over(along)}).withColumn("most", F.ceil(F.round(F.lit(q) * F.col("total"), 9))).withColumn("before", F.col("upto") - F.col("t"))
        inside = ends.where("upto <= most").groupBy("draw").agg(F.sum("h").alias("h"))
        cut = ends.where("before < most and upto > most").select("draw", "chunk", "before", "most")
        last = by_draw(rows.select("chunk", "place", "hit", "block", *[f"t{j}" for j in range(EIGHT)]), ["chunk", "place", "hit"], ["t"], draws).select("chunk", "place", "hit", "draw", "t").unionByName(placed.select("chunk", "place", "hit", F.lit(draws).alias("draw"), F.lit(1).alias("t")))
        last = last.join(cut, ["draw", "chunk"]).where("t > 0").withColumn("at", F.col("before") + F.sum("t").over(Window.partitionBy("draw", "chunk").orderBy("place")) - F.col("t"))
        rest = last.groupBy("draw").agg(F.sum(F.greatest(F.lit(0), F.least(F.col("t"), F.col("most") - F.col("at"))) * F.col("hit")).alias("h"))
        sizes = chunks.groupBy("draw").agg(F.sum("t").alias("t")).where("t > 0")
        every = inside.unionByName(rest).groupBy("draw").agg(F.sum("h").alias("h"))
        return sizes.join(every, "draw", "left").select("draw", (F.coalesce("h", F.lit(0)) / F.col("t")).alias(f"hits_{score}"))

    both = hits(a).join(hits(b), "draw").withColumn("value", F.col(f"hits_{a}") - F.col(f"hits_{b}")).withColumn("__all", F.lit(0))
    diff = both.where(F.col("draw") == draws).select(F.round("value", 6).alias("diff"))
    return diff.crossJoin(F.broadcast(interval(both.where(F.col("draw") < draws), ["__all"]).drop("__all")))  # one row


def sign_flips(pairs: DataFrame, unit: str, draws: int = 2000, seed: int = 3) -> DataFrame:
    """One row: diff and p of the mean difference under random signs (two-sided, the sample counted)."""
    d = (F.col("b") - F.col("a")).cast("double")
    seen = pairs.agg(F.avg(d).alias("m"), F.count("*").alias("n"))
    blocks = pairs.select(F.col(unit).alias("__u"), d.alias("d")).where("d <> 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // SIGNS))))
    hashed = blocks.withColumn("__x", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("block").cast("string"), F.col("__u").cast("string")), 256))
    digits = hashed.select("d", "block", F.posexplode(F.split("__x", "")).alias("digit", "c")).select("d", "block", "digit", (F.expr("locate(c, '0123456789abcdef')") - 1).alias("v"))
    signed = digits.groupBy("block", "digit").agg(*[F.sum(F.when(F.col("v").bitwiseAND(1 << k) != 0, F.col("d")).otherwise(-F.col("d"))).alias(f"s{k}") for k in range(4)])
    flipped = signed.select(F.explode(F.array(*[F.struct((F.col("block") * SIGNS + F.col("digit") * 4 + k).alias("draw"), F.col(f"s{k}").alias("s")) for k in range(4)])).alias("x")).select("x.*").where(F.col("draw") < draws)
    extreme = flipped.crossJoin(F.broadcast(seen)).agg(F.sum((F.abs(F.col("s") / F.col("n")) >= F.abs("m") - 1e-12).cast("int")).alias("k"))  # one row
    counted = seen.crossJoin(F.broadcast(extreme))  # one row
    # Without any difference every draw is as extreme as the sample.
    return counted.select(F.round("m", 6).alias("diff"), F.round((1 + F.coalesce("k", F.lit(draws))) / (draws + 1), 6).alias("p"))


def log_choose(n: Column, k: Column) -> Column:
    """ln of n over k, as a sum of logarithms."""
    places = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(places, F.lit(0.0), lambda acc, j: acc + F.log((n - k + j) / j))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for n trials of chance p (0 < p < 1), each term from the one before."""
    step = lambda acc, j: F.struct((acc["t"] + F.log((n - j + 1) / j) + F.log(p / (1 - p))).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - j + 1) / j) + F.log(p / (1 - p)))).alias("s"))
    start = n * F.log(1 - p)
    places = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < 0, 0.0).otherwise(F.aggregate(places, F.struct(start.alias("t"), F.exp(start).alias("s")), step, lambda acc: acc["s"]))


def clopper_pearson(k: Column, n: Column, alpha: float = 0.05, steps: int = 40) -> Column:
    """(low, high) of a share, exact: by halving, the chance at which k or more (k or fewer) successes have probability alpha / 2. Null for
    n = 0; 0 without successes, 1 without failures."""
    halve = lambda small: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("l"), F.lit(1.0).alias("h")), lambda acc, _: F.when(small((acc["l"] + acc["h"]) / 2), F.struct(((acc["l"] + acc["h"]) / 2).alias("l"), acc["h"].alias("h"))).otherwise(F.struct(acc["l"].alias("l"), ((acc["l"] + acc["h"]) / 2).alias("h"))), lambda acc: (acc["l"] + acc["h"]) / 2)
    low = F.when(k == 0, 0.0).otherwise(halve(lambda p: 1 - binomial_tail(k - 1, n, p) < alpha / 2))
    high = F.when(k == n, 1.0).otherwise(halve(lambda p: binomial_tail(k, n, p) > alpha / 2))
    return F.when(n > 0, F.struct(F.round(low, 6).alias("low"), F.round(high, 6).alias("high")))


def zero_failure_bound(n: Column, alpha: float = 0.05) -> Column:
    """The greatest failure rate that n trials without a failure leave possible."""
    return F.when(n > 0, F.round(1 - F.pow(F.lit(alpha), 1 / n), 6))


def least_discordant(alpha: float = 0.05) -> int:
    """The fewest pairs, all discordant one way, that an exact two-sided sign test rejects."""
    n = 1
    while 2 * 0.5**n > alpha:
        n += 1
    return n


def sign_test_power(n: int, p: float, alpha: float = 0.05) -> float:
    """The chance that the exact two-sided sign test rejects with n discordant pairs of which each goes one way with chance p."""
    tail = lambda k: sum(math.comb(n, j) for j in range(k + 1)) / 2**n
    cut = max((k for k in range(n // 2 + 1) if 2 * tail(k) <= alpha), default=-1)
    chance = lambda k: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return round(sum(chance(k) + chance(n - k) for k in range(cut + 1)), 6) if cut >= 0 else 0.0


def cluster_interval(rows: DataFrame, cluster: str, value: str, t: float = 1.96) -> DataFrame:
    """One row: clusters, mean, se, low, high and design: the mean of the clusters' means with its standard error, and the design effect
    1 + (size - 1) * icc that the rows' dependence amounts to."""
    from .measures import icc

    each = rows.groupBy(cluster).agg(F.avg(value).alias("m"), F.count(value).alias("c")).where("c > 0")
    stats = each.agg(F.count("*").alias("clusters"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("se"), F.avg("c").alias("size"))
    both = stats.crossJoin(F.broadcast(icc(rows, cluster, value)))  # one row
    return both.select("clusters", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round(F.col("mean") - t * F.col("se"), 6).alias("low"), F.round(F.col("mean") + t * F.col("se"), 6).alias("high"), F.round(1 + (F.col("size") - 1) * F.col("icc"), 6).alias("design"))


def rolling_origin(rows: DataFrame, key: str, published: str, known: str, kind: str, outcome: str, shrink: float = 5.0) -> DataFrame:
    """key, n, guess and error: each outcome predicted from those that were known when its row was published: their mean, moved towards the
    mean of its kind by n / (n + shrink). Null guesses where nothing was known.

    Outcomes and questions are one stream in time, summed by two windows; no row meets all earlier ones.
    """
    asks = rows.select(F.col(published).alias("__t"), F.lit(0).alias("__o"), kind, F.lit(0).alias("__c"), F.lit(0.0).alias("__v"), F.col(key).alias("key"), F.col(outcome).alias("outcome"))
    facts = rows.where(F.col(outcome).isNotNull()).select(F.col(known).alias("__t"), F.lit(1).alias("__o"), kind, F.lit(1).alias("__c"), F.col(outcome).cast("double").alias("__v"), F.lit(None).cast(rows.schema[key].dataType).alias("key"), F.lit(None).cast("double").alias("outcome"))
    every = asks.unionByName(facts)
    # Each kind's running sums, then those of all kinds at the question's time as the sum of the kinds' increments by day.
    own = Window.partitionBy(kind).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = every.withColumns({"kn": F.sum("__c").over(own), "ks": F.sum("__v").over(own)})
    steps = facts.groupBy("__t").agg(F.sum("__c").alias("c"), F.sum("__v").alias("v"))
    times_ = steps.select("__t", F.lit(1).alias("__o"), "c", "v").unionByName(asks.select("__t", F.lit(0).alias("__o"), F.lit(0).alias("c"), F.lit(0.0).alias("v")).distinct())
    whole = Window.partitionBy(F.lit(0)).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # distinct times alone
    all_ = times_.withColumns({"n": F.sum("c").over(whole), "s": F.sum("v").over(whole)}).where("__o = 0").select("__t", "n", "s").distinct()
    joined = summed.where("__o = 0").join(all_, "__t")
    share = F.col("kn") / (F.col("kn") + shrink)
    base = F.col("s") / F.col("n")
    guess = F.when(F.col("n") > 0, F.when(F.col("kn") > 0, share * F.col("ks") / F.col("kn") + (1 - share) * base).otherwise(base))
    return joined.select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n"), F.round(guess, 9).alias("guess"), F.round(F.abs(guess - F.col("outcome")), 9).alias("error"))


def simulate_rule(n_sims: DataFrame, clusters: int, size: int, base: Column, effect: float, spread: float, rule, seed: int = 23) -> DataFrame:
    """sim, successes and fires: simulated programs of `clusters` clusters of `size` trials whose chances are spread around base + effect,
    and whether a rule (a Column of successes and trials) fires. n_sims: a column sim, and what base is made of. Every number is a hash of its place."""
    cells = n_sims.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1)))).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + effect + F.lit(spread) * (2 * uniform(seed, "c", F.col("sim"), F.col("cluster")) - 1)))
    hits = cells.groupBy("sim").agg(F.sum((uniform(seed, "t", F.col("sim"), F.col("cluster"), F.col("trial")) < chance).cast("bigint")).alias("successes"))
    return hits.withColumn("fires", rule(F.col("successes"), F.lit(clusters * size)))
