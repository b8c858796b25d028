"""Budgeted selection. Prefix fills are windows; order-dependent fills are folds over one group's short list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def prefix_fill(ranked: DataFrame, group: str, rank: str, cost: str, budget: int) -> DataFrame:
    """Rows in rank order up to the first that does not fit; adds spent."""
    w = Window.partitionBy(group).orderBy(rank)
    return ranked.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def byte_prefix(ranked: DataFrame, group: str, rank: str, text: str, budget: int) -> DataFrame:
    """prefix_fill() by UTF-8 bytes."""
    return prefix_fill(ranked.withColumn("bytes", F.octet_length(text)), group, rank, "bytes", budget)


def skip_fill(ranked: DataFrame, group: str, rank: str, key: str, cost: str, budget: int) -> DataFrame:
    """group, taken (keys in order) and spent: rows that overflow are skipped, later ones may still fit."""
    listed = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(key).alias("k"), F.col(cost).cast("bigint").alias("c")))).alias("rows"))
    kind = ranked.schema[key].dataType.simpleString()
    start = F.struct(F.lit(0).cast("bigint").alias("spent"), F.array().cast(f"array<{kind}>").alias("taken"))
    fold = lambda acc, x: F.when(acc["spent"] + x["c"] <= budget, F.struct((acc["spent"] + x["c"]).alias("spent"), F.concat(acc["taken"], F.array(x["k"])).alias("taken"))).otherwise(acc)
    return listed.withColumn("fill", F.aggregate("rows", start, fold)).select(group, "fill.taken", "fill.spent")


def fair_share(items: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Adds share: water-filling of the budget over the group's pieces; what does not divide goes one each in order.

    The level is found from the pieces ordered by size: pieces below it get their size, the others the level.
    """
    by_size = Window.partitionBy(group).orderBy(size, order)
    whole = Window.partitionBy(group)
    rows = items.withColumns({"__n": F.count("*").over(whole), "__i": F.row_number().over(by_size), "__below": F.coalesce(F.sum(size).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    left = F.lit(budget) - F.col("__below")
    level = F.floor(left / (F.col("__n") - F.col("__i") + 1))
    rows = rows.withColumn("__level", F.when(level < F.col(size), level)).withColumn("__rest", F.when(level < F.col(size), left - level * (F.col("__n") - F.col("__i") + 1)))
    first = F.struct("__i", "__level", "__rest")
    rows = rows.withColumn("__cut", F.min(F.when(F.col("__level").isNotNull(), first)).over(whole))
    above = F.col("__cut").isNotNull() & (F.col("__i") >= F.col("__cut.__i"))
    rows = rows.withColumn("__over", above).withColumn("__turn", F.row_number().over(Window.partitionBy(group, "__over").orderBy(order)))
    share = F.when(F.col("__over"), F.least(F.col(size), F.greatest(F.lit(0), F.col("__cut.__level")) + F.when(F.col("__turn") <= F.col("__cut.__rest"), 1).otherwise(0))).otherwise(F.col(size))
    return rows.select(*items.columns, share.cast("bigint").alias("share"))


def context_bundle(states: DataFrame, hits: DataFrame, group: str, rank: str, text: str, budget: int, state_share: float = 0.4) -> DataFrame:
    """group, section and text: states up to their share of the budget, then hits with what is left, both as prefixes."""
    a = prefix_fill(states.withColumn("chars", F.length(text)), group, rank, "chars", int(budget * state_share))
    used = a.groupBy(group).agg(F.max("spent").alias("used"))
    w = Window.partitionBy(group).orderBy(rank)
    b = hits.withColumn("spent", F.sum(F.length(text)).over(w)).join(used, group, "left").where(F.col("spent") <= budget - F.coalesce("used", F.lit(0)))
    section = lambda df, name: df.select(group, F.lit(name).alias("section"), rank, text)
    return section(a, "state").unionByName(section(b, "hits"))


def balanced(items: DataFrame, key: str, cited: Column, recent: Column, salt: str, n: int) -> DataFrame:
    """n distinct rows: a third by citations, a third by recency, the rest by a stable hash; adds why."""
    third = n // 3
    one = items.orderBy(cited.desc(), key).limit(third).withColumn("why", F.lit("cited"))
    left = items.join(one.select(key), key, "left_anti")
    two = left.orderBy(recent.desc(), key).limit(third).withColumn("why", F.lit("recent"))
    rest = left.join(two.select(key), key, "left_anti").orderBy(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt)), 256)).limit(n - 2 * third)
    return one.unionByName(two).unionByName(rest.withColumn("why", F.lit("hash")))


def quota_counts(supply: DataFrame, group: str, weight: str, n: int) -> DataFrame:
    """Adds quota: largest remainders of n * weight / total, ties by group."""
    whole = Window.partitionBy(F.lit(0))
    exact = F.lit(n) * F.col(weight) / F.sum(weight).over(whole)
    rows = supply.withColumns({"__e": exact, "__f": F.floor(exact)})
    rows = rows.withColumn("__left", F.lit(n) - F.sum("__f").over(whole)).withColumn("__r", F.row_number().over(whole.orderBy(F.round(F.col("__f") - F.col("__e"), 9), group)))
    return rows.select(*supply.columns, (F.col("__f") + F.when(F.col("__r") <= F.col("__left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def moved_shortfall(wanted: list[int], supply: list[int]) -> list[int]:
    """Wanted counts of a row of bins, cut to their supply; what a bin lacks moves to the nearest bins that have more (ties to the lower)."""
    out = [min(w, s) for w, s in zip(wanted, supply)]
    for i, (w, s) in enumerate(zip(wanted, supply)):
        lacks = max(0, w - s)
        for j in sorted(range(len(out)), key=lambda j: (abs(i - j), j)):
            more = min(lacks, max(0, supply[j] - max(wanted[j], out[j])))
            out[j], lacks = out[j] + more, lacks - more
    return out


def decile_sample(rows: DataFrame, key: str, value: str, n: int, bins: int = 10, seed: int = 31) -> DataFrame:
    """rows' key and value, bin and place of n rows, as many of each tenth of the value's order as of any other (largest remainders, first bins first;
    a short bin's rest moves to the nearest ones). The order by place mixes the bins: in any prefix each has its share, to less than one row.

    Rows are put in order by ranges; within a bin they are taken by a hash of the key. The driver holds a count a bin.
    """
    from .measures import running

    known = rows.where(F.col(value).isNotNull()).select(key, value)
    total = known.count()
    placed = running(known, value, {"__place": F.lit(1)}, tie=key).withColumn("bin", F.floor((F.col("__place") - 1) * bins / F.lit(max(total, 1))).cast("int"))
    counts = dict(placed.groupBy("bin").agg(F.count("*")).collect())  # a row a bin
    supply = [counts.get(b, 0) for b in range(bins)]
    wanted = moved_shortfall([n // bins + (b < n % bins) for b in range(bins)], supply)
    mark = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    ordered = running(placed.withColumn("__h", F.conv(F.substring(mark, 1, 8), 16, 10).cast("bigint")), "__h", {"__i": F.lit(1)}, tie=key, by=("bin",))
    quota = F.element_at(F.array(*[F.lit(w) for w in wanted]), F.col("bin") + 1)
    taken = ordered.where(F.col("__i") <= quota).withColumn("__spot", (F.col("__i") - 0.5) / quota)
    return taken.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("__spot", 9), "bin"))).select(key, value, "bin", "place")  # n rows


def token_drop(items: DataFrame, group: str, rank: str, tokens: Column, overhead: int, budget: int) -> DataFrame:
    """The items that stay when whole ones are dropped, lowest ranked first, until the block (overhead and items) fits; adds block."""
    w = Window.partitionBy(group).orderBy(rank)
    return items.withColumn("block", F.lit(overhead) + F.sum(tokens).over(w)).where(F.col("block") <= budget)


#: The arms of a pack: orders (by rank; current before supporting before stale; backwards) and formats (text alone, with its source inline,
#: with a short handle and a footer of sources).
ORDERS, FORMS = ("ranked", "governed", "reversed"), ("text", "inline", "footer")


def pack(items: DataFrame, case: str, rank: str, bucket: str, record: str, text: str, source: str, arms: list[tuple[str, str, int]]) -> DataFrame:
    """arm, form, budget, case, record, place, bytes, spent, included and reason of every candidate of a case under every arm (order, format,
    budget in bytes).

    Items are taken in order while they fit; the first that does not ends the pack. The ledger says of each omitted item why: budget (it
    did not fit), after (an earlier one did not). The footer counts each different source once, where it first stands. All arms are
    one pass: items are exploded by arm, not ranked anew for each.
    """
    if any(order not in ORDERS or form not in FORMS for order, form, _ in arms):
        raise ValueError("unknown arm")
    every = F.array(*[F.struct(F.lit(o).alias("arm"), F.lit(f).alias("form"), F.lit(b).alias("budget")) for o, f, b in arms])
    rows = items.withColumn("__a", F.explode(every)).select("*", "__a.*").drop("__a")
    level = F.when(F.col(bucket) == "current", 0).when(F.col(bucket) == "supporting", 1).otherwise(2)
    first = F.when(F.col("arm") == "governed", level).otherwise(0)
    second = F.when(F.col("arm") == "reversed", -F.col(rank)).otherwise(F.col(rank))
    group = [case, "arm", "form", "budget"]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(first, second)))
    shown = F.when(F.col("form") == "text", F.col(text)).when(F.col("form") == "inline", F.concat(F.lit("["), source, F.lit("#"), F.col(record).cast("string"), F.lit("] "), text)).otherwise(F.concat(F.lit("[S] "), text))
    new = F.row_number().over(Window.partitionBy(*group, source).orderBy("place")) == 1
    rows = rows.withColumn("bytes", F.octet_length(shown) + 1 + F.when((F.col("form") == "footer") & new, F.octet_length(source) + 6).otherwise(0))
    w = Window.partitionBy(*group).orderBy("place")
    rows = rows.withColumn("spent", F.sum("bytes").over(w))
    fits, before = F.col("spent") <= F.col("budget"), F.coalesce(F.lag("spent").over(w), F.lit(0)) <= F.col("budget")
    return rows.select("arm", "form", "budget", case, record, "place", "bytes", "spent", fits.alias("included"), F.when(~fits & before, "budget").when(~fits, "after").alias("reason"))


def pack_integrity(packed: DataFrame, needed: DataFrame, case: str, record: str) -> DataFrame:
    """case, required, kept and retention: how many of a case's needed records the pack holds; null without any."""
    kept = needed.select(case, record).distinct().join(packed.where("included").select(case, record, F.lit(1).alias("__in")), [case, record], "left")
    t = kept.groupBy(case).agg(F.count("*").alias("required"), F.coalesce(F.sum("__in"), F.lit(0)).cast("bigint").alias("kept"))
    return t.select(case, "required", "kept", F.round(F.col("kept") / F.col("required"), 6).alias("retention"))


def serialised(packed: DataFrame, case: str, place: str, text: str, source: str) -> DataFrame:
    """case and body: the texts in order, each with a handle S01, S02, ... of its source by first appearance, and a footer of the handles."""
    first = packed.groupBy(case, source).agg(F.min(place).alias("__first"))
    handles = first.withColumn("__h", F.concat(F.lit("S"), F.lpad(F.row_number().over(Window.partitionBy(case).orderBy("__first")).cast("string"), 2, "0")))
    lines = packed.join(handles, [case, source]).groupBy(case).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.concat(F.lit("["), "__h", F.lit("] "), text).alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    foot = handles.groupBy(case).agg(F.array_join(F.sort_array(F.collect_list(F.concat("__h", F.lit(" = "), source))), "\n").alias("foot"))
    return lines.join(foot, case).select(case, F.concat("lines", F.lit("\n--\n"), "foot").alias("body"))


def current_and_history(rows: DataFrame, case: str, key: str, at: str, text: str) -> DataFrame:
    """case, section, place and text: of each state key the newest row is current, the others are history; a key whose newest rows tie is left
    as it stands (section as given)."""
    newest = Window.partitionBy(case, key)
    marked = rows.withColumn("__top", F.max(at).over(newest)).withColumn("__ties", F.sum((F.col(at) == F.col("__top")).cast("int")).over(newest))
    section = F.when(F.col("__ties") > 1, "as given").when(F.col(at) == F.col("__top"), "current").otherwise("history")
    order = Window.partitionBy(case, "section").orderBy(F.col(at).desc(), key, text)
    return marked.withColumn("section", section).select(case, "section", F.row_number().over(order).alias("place"), text)


def score_note(ranked: DataFrame, case: str, score: str, margin: float) -> DataFrame:
    """case and note: one line where the first two scores differ by less than `margin`; other cases have none."""
    two = ranked.groupBy(case).agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("b"))
    close = two.where(F.col("b").isNotNull() & (F.col("a") - F.col("b") < margin))
    return close.select(case, F.concat(F.lit("the first two of the context are within "), F.lit(str(margin))).alias("note"))


def placebo(targets: DataFrame, fillers: DataFrame, case: str, tokens: str, filler: str) -> DataFrame:
    """case, filler and gap: of the fillers the one whose tokens come closest to the case's (ties by filler).

    Fillers are ordered by size; a case meets the nearest ones below and above alone, so no case is compared with all of them.
    """
    sizes = fillers.groupBy(tokens).agg(F.min(filler).alias("__f"))
    marks = sizes.select(F.col(tokens).alias("__t"), F.struct(F.col(tokens).alias("t"), F.col("__f").alias("f")).alias("__x"), F.lit(None).cast(targets.schema[case].dataType).alias(case))
    asks = targets.select(F.col(tokens).alias("__t"), F.lit(None).cast(marks.schema["__x"].dataType).alias("__x"), F.col(case))
    line = Window.partitionBy(F.lit(0)).orderBy("__t", F.col(case).asc_nulls_first())  # distinct sizes and cases
    both = marks.unionByName(asks).withColumns({"lo": F.last("__x", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "hi": F.first("__x", ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("__t"))
    best = F.when(F.col("hi").isNull() | (gap("lo") < gap("hi")) | ((gap("lo") == gap("hi")) & (F.col("lo.f") <= F.col("hi.f"))), F.col("lo")).otherwise(F.col("hi"))
    best = F.when(F.col("lo").isNull(), F.col("hi")).otherwise(best)
    return both.where(F.col(case).isNotNull()).withColumn("__b", best).select(case, F.col("__b.f").alias("filler"), F.abs(F.col("__b.t") - F.col("__t")).alias("gap"))


def walkthrough(steps: DataFrame, item: str, step: str, action: str, observation: str, obs_chars: int) -> DataFrame:
    """item and body: one line an action and one an observation, the latter cut to `obs_chars` characters."""
    cut = F.when(F.length(observation) > obs_chars, F.concat(F.substring(observation, 1, obs_chars), F.lit("..."))).otherwise(F.col(observation))
    lines = F.concat(F.lit("> "), F.col(action), F.lit("\n"), cut)
    return steps.groupBy(item).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), lines.alias("t")))), lambda x: x["t"]), "\n").alias("body"))


def outline_of(steps: DataFrame, item: str, step: str, action: str) -> DataFrame:
    """item and body: the actions alone, numbered."""
    numbered = F.concat(F.col(step).cast("string"), F.lit(". "), F.col(action))
    return steps.groupBy(item).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), numbered.alias("t")))), lambda x: x["t"]), "\n").alias("body"))


#: Formatters by name, each (steps, item, step, action, observation) -> (item, body). Others are added with register_formatter().
FORMATTERS = {
    "walkthrough": lambda d, i, s, a, o: walkthrough(d, i, s, a, o, 80),
    "outline": lambda d, i, s, a, o: outline_of(d, i, s, a),
}


def register_formatter(name: str, formatter) -> None:
    if name in FORMATTERS:
        raise ValueError(f"a formatter {name} exists")
    FORMATTERS[name] = formatter


def chronological(rows: DataFrame, case: str, at: str, key: str, text: str) -> DataFrame:
    """case and context: the texts in order of time, then key."""
    return rows.groupBy(case).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("a"), F.col(key).alias("k"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("context"))
