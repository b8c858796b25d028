"""Quality rules with risk-controlled thresholds (DataFrame functions only).

The base rules are fixed counts. On top of them every rule of RULES rejects documents whose value exceeds a cutoff, and the
cutoffs are chosen on labelled documents. In each stratum a fixed sequence of rule sets is walked, each a step stricter than the one
before: the grids of the rules one after the other, from the rule that clean prose breaks least to the one that it breaks most, and each
from its loosest cutoff to its tightest. A step is tested jointly: it holds if the exact (Clopper-Pearson) upper bound on the share of
good documents that any rule of the set rejects is at most `risk`. The walk ends at the first step that does not hold, so no
correction is due for the number of steps; over strata the confidence is split by their good documents (weighted Bonferroni), so that with
probability 1 - delta no stratum's good documents are rejected at more than the rate `risk`. Where the first step does not hold, the rules are
idle: a stratum needs ln(delta * its share) / ln(1 - risk) good documents for it, 149 if it is the only one.

Defined results: null and empty texts have no words and fail the base rules; a null stratum is a stratum of its own; a
document with several labels is good only if all say so; labels without a document are ignored; without labels, or with an
empty table, no rule beyond the base acts; columns that clash with the added ones are replaced; very long texts are counted whole;
repeated rows are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, persist

# The symbols, the base limits, and the grid of each rule's cutoffs, in the order of the walk.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
RULES = {
    "symbol_share": (0.2, 0.15, 0.1, 0.05, 0.02),
    "shout_share": (0.6, 0.4, 0.2, 0.1),
    "upper_share": (0.7, 0.5, 0.3, 0.2),
    "dup_line_share": (0.5, 0.3, 0.2, 0.1),
    "repeat_share": (0.15, 0.1, 0.05, 0.02),
}
STEPS = [(rule, cutoff) for rule, grid in RULES.items() for cutoff in grid]
UPPER = "".join(chr(c) for c in range(0x41, 0x5B)) + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper")


def repeated_words(words: Column, width: int = WINDOW):
    """(pairs, covered): of the hashes of words, the (hash, place) of every window of `width` of them, and the function from them to the number of words
    that lie in a window that occurs twice or more."""
    hashes = F.when(
        F.size(words) > width,
        F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.struct(F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(width)]).alias("h"), i.alias("i"))),
    )

    def covered(pairs: Column) -> Column:
        # In sorted order equal windows are neighbours. The sorted array stands outside every lambda: inside it would be sorted anew for each element.
        ordered, rest = F.sort_array(pairs), F.size(pairs) - 1
        twins = F.zip_with(F.slice(ordered, F.lit(1), rest), F.slice(ordered, F.lit(2), rest), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
        hits = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
        return F.aggregate(
            hits,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i + (width - 1) - acc["upto"])).alias("n"), (i + (width - 1)).alias("upto")),
            lambda acc: acc["n"],
        )

    return hashes, covered


def count_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS (all long) to the rows; the text stays."""
    keep = [c for c in docs.columns if c not in COUNTS]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    without = lambda chars: F.length(F.translate(t, chars, ""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumns({"__t": t, "__words": F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))})
    pairs, covered = repeated_words(F.col("__hashes"))
    rows = rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w))).withColumn("__pairs", pairs)
    distinct = F.size(F.array_distinct(F.transform("__pairs", lambda x: x["h"])))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    rows = rows.withColumn("__lines", lines)
    spaceless = F.length(F.translate("__t", " \t\n\x0b\f\r", ""))
    whole = F.length("__t")
    less = lambda chars: (whole - F.length(F.translate("__t", chars, ""))).cast("bigint")
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__words").cast("bigint").alias("n_words"),
        spaceless.cast("bigint").alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("__pairs").isNull() | (distinct == F.size("__pairs")), F.lit(0).cast("bigint")).otherwise(covered(F.col("__pairs"))).alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        less("!").alias("n_shouts"),
        less(UPPER).alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """Each rule's value from the counts; 0 where its base is 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "shout_share": share("n_shouts", "n_words"), "upper_share": share("n_upper", "word_chars"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at p, by the recurrence of its terms' logarithms. Only asked for k < n * p."""
    ratio = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    return F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), F.exp(first).alias("s")),
        lambda acc, j: F.struct((acc["t"] + F.log((n - j + 1) / j * ratio)).alias("t"), (acc["s"] + F.exp(acc["t"] + F.log((n - j + 1) / j * ratio))).alias("s")),
        lambda acc: acc["s"],
    )


def first_step() -> Column:
    """The first step of the walk whose rule set rejects a document, from its rules' values; null if none does."""
    begins, each = 0, []
    for rule, grid in RULES.items():
        passed = reduce(lambda x, y: x + y, [(F.col(rule) <= cutoff).cast("int") for cutoff in grid])
        each.append(F.when(F.col(rule) > grid[-1], begins + passed))
        begins += len(grid)
    return F.least(*each)  # nulls are passed over


def select_cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", label: str = "quality", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, rule and cutoff: the tightest cutoff of each rule in the steps that hold. One row of counts a stratum."""
    good = labels.groupBy(F.col(f"`{doc_id}`").alias("__id")).agg(F.min(F.col(f"`{label}`")).alias("__good")).where("__good = 1")
    held = features.where(~base_failed()).join(good, features[doc_id] == F.col("__id")).select(F.col(f"`{stratum}`").alias("stratum"), *[v.alias(k) for k, v in rule_values().items()])
    stepped = held.select("stratum", first_step().alias("step"))
    counts = stepped.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("step") <= i, 1)).alias(f"k{i}") for i in range(len(STEPS))])
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(cutoff)).alias("cutoff"), F.col(f"k{i}").alias("k")) for i, (rule, cutoff) in enumerate(STEPS)])
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row a stratum; taken before the steps are exploded, which would count each stratum once a step
    counts = counts.select("stratum", "n", share.alias("share"), each.alias("steps"))
    flat = counts.select("stratum", "n", "share", F.explode("steps").alias("step")).select("stratum", "n", "share", "step.*")
    # The counts grow along the walk, and the bounds with them: the steps that hold are those before the first that does not.
    tail = F.when(F.col("k") < F.col("n") * risk, binomial_tail(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    return flat.where(tail <= delta * F.col("share")).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def verdicts(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept."""
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cutoffs"))
    names = [c for c in features.columns if c not in ("base_failed", "kept")]
    joined = features.join(by_stratum, features[stratum].eqNullSafe(by_stratum["stratum"]), "left")
    over = reduce(lambda a, b: a | b, [F.coalesce(v > F.try_element_at("__cutoffs", F.lit(k)), F.lit(False)) for k, v in rule_values().items()])
    return joined.select(*[features[c] for c in names], base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed and kept of every document."""
    counted = persist(count_features(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{stratum}`").cast("string").alias(stratum), F.col(f"`{text}`")), text).drop(text), "quality")
    return verdicts(counted, select_cutoffs(counted, labels, stratum, doc_id, risk=risk, delta=delta), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, all columns as they were.

    The counts are written with the rows: a filter on them would otherwise be pushed below them and take each several times.
    """
    names = docs.columns
    aside = {c: f"__own_{c}" for c in names if c in COUNTS or c in ("base_failed", "kept")}
    counted = persist(count_features(docs.withColumnsRenamed(aside), text), "quality")
    kept = verdicts(counted, select_cutoffs(counted, labels, stratum, risk=risk, delta=delta), stratum).where("kept")
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in names])
