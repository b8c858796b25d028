"""Small languages compiled to Columns: metadata predicates, three-valued conditions, closure and obligation policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Comparisons of the metadata language.
COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v), "nin": lambda c, v: ~c.isin(*v), "contains": lambda c, v: c.contains(v), "icontains": lambda c, v: F.lower(c).contains(v.lower()),
}


def metadata_filter(spec: dict) -> Column:
    """A predicate from {"field": value | "*" | {op: value}}, with AND, OR and NOT lists; fields of one dict hold together."""
    parts = []
    for key, value in spec.items():
        if key in ("AND", "OR", "NOT"):
            inner = [metadata_filter(x) for x in value]
            joined = reduce((lambda a, b: a & b) if key == "AND" else (lambda a, b: a | b), inner)
            parts.append(~joined if key == "NOT" else joined)
        elif value == "*":
            parts.append(F.col(key).isNotNull())
        elif isinstance(value, dict):
            unknown = set(value) - set(COMPARE)
            if unknown:
                raise ValueError(f"unknown comparison: {sorted(unknown)}")
            parts += [COMPARE[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


EPSILON = 1e-12


def expression(node) -> Column:
    """A number, a metric's name, or {"add" | "sub" | "mul": [a, b]} or {"abs": a}."""
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    if isinstance(node, str):
        return F.col(node).cast("double")
    (op, args), = node.items()
    if op == "abs":
        return F.abs(expression(args))
    a, b = map(expression, args)
    return {"add": a + b, "sub": a - b, "mul": a * b}[op]


def condition(node: dict) -> Column:
    """all / any / not over comparisons {"lt" | "le" | "gt" | "ge" | "eq": [a, b]}; a missing metric makes it null (Kleene)."""
    (op, args), = node.items()
    if op in ("all", "any"):
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), map(condition, args))
    if op == "not":
        return ~condition(args)
    a, b = map(expression, args)
    d = a - b
    return {"lt": d < -EPSILON, "le": d <= EPSILON, "gt": d > EPSILON, "ge": d >= -EPSILON, "eq": F.abs(d) <= EPSILON}[op]


def closure(found: Column, complete: Column, policy: str) -> Column:
    """The answer of a look-up that may be incomplete: found; else closed worlds say no, open ones unknown, certified ones no only where
    the source is known to be complete."""
    miss = {"closed": F.lit("no"), "open": F.lit("unknown"), "certificate": F.when(complete, "no").otherwise("unknown")}[policy]
    return F.when(found, "yes").otherwise(miss)


def obligations(evidence: DataFrame, required: DataFrame, case: str, need: str) -> DataFrame:
    """case, missing, contradicted, invalid (counts) and action. Only current, authorised evidence with provenance counts; a need with
    any other evidence alone is invalid."""
    ok = F.col("current") & F.col("authorised") & F.col("provenance").isNotNull()
    each = evidence.groupBy(case, need).agg(F.max((ok & (F.col("polarity") > 0)).cast("int")).alias("yes"), F.max((ok & (F.col("polarity") < 0)).cast("int")).alias("no"), F.max((~ok).cast("int")).alias("bad"))
    state = required.join(each, [case, need], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    yes, no, bad = zero("yes"), zero("no"), zero("bad")
    flag = lambda c: F.sum(c.cast("bigint"))
    out = state.groupBy(case).agg(flag((yes == 0) & (no == 0) & (bad == 0)).alias("missing"), flag(no == 1).alias("contradicted"), flag((yes == 0) & (no == 0) & (bad == 1)).alias("invalid"))
    return out.withColumn("action", F.when(F.col("contradicted") > 0, "reject").when(F.col("missing") + F.col("invalid") > 0, "ask").otherwise("accept"))


def polarity(evidence: DataFrame, case: str) -> DataFrame:
    """case, positives, negatives and conflict over current, authorised evidence."""
    ok = evidence.where("current and authorised")
    p, n = F.sum((F.col("polarity") > 0).cast("bigint")), F.sum((F.col("polarity") < 0).cast("bigint"))
    return ok.groupBy(case).agg(p.alias("positives"), n.alias("negatives"), ((p > 0) & (n > 0)).alias("conflict"))


def majority(runs: DataFrame, case: str, vote: str, needed: int) -> DataFrame:
    """case and verdict: a vote that `needed` runs share, else null."""
    counts = runs.groupBy(case).agg(F.sum(F.col(vote).cast("int")).alias("y"), F.sum((~F.col(vote)).cast("int")).alias("n"))
    return counts.select(case, F.when(F.col("y") >= needed, True).when(F.col("n") >= needed, False).alias("verdict"))
