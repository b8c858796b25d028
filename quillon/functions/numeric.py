"""Numbers as Columns: quantising, link functions, the inverse normal, Zipf weights, appraisals."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf


def quantised(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


@pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The inverse of the normal distribution function; null outside of (0, 1)."""
    inverse = NormalDist().inv_cdf
    return p.map(lambda x: inverse(x) if x is not None and 0 < x < 1 else None).astype("float64")


def zipf(rank: Column, n: int, s: float = 1.0) -> Column:
    """The share of the rank-th of n kinds whose shares fall as rank ** -s."""
    total = sum(k**-s for k in range(1, n + 1))
    return F.when(rank.between(1, n), F.pow(rank.cast("double"), F.lit(-s)) / total)


def appraised(features: dict[str, Column], weights: dict[str, float], bias: float = 0.0, link: str = "logistic") -> Column:
    """A weighted sum of features through a link (logistic, tanh or linear); unknown features count as 0."""
    total = F.lit(bias)
    for name, w in weights.items():
        total = total + F.coalesce(features[name].cast("double"), F.lit(0.0)) * w
    return quantised({"logistic": logistic, "tanh": F.tanh, "linear": lambda x: x}[link](total))


def hashed_normal(*parts: Column | str | int) -> Column:
    """A number of mean 0 and variance 1 that is the same in every run: eight evenly spread numbers of one digest, summed up and scaled."""
    mark = F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)
    total = F.lit(0.0)
    for k in range(8):
        total = total + F.conv(F.substring(mark, 8 * k + 1, 8), 16, 10).cast("double") / 4294967296.0
    return (total - 4) / F.sqrt(F.lit(8 / 12))


def chi_square_p(x: Column, dof: Column, terms: int = 400) -> Column:
    """The chance of a chi-square of so many degrees of freedom (1 to 100) being x or more: 1 less the regularised incomplete gamma function, by its series.
    Values beyond 400 count as 0."""
    a, half = dof / 2, x / 2
    # ln gamma(a + 1): from gamma(1) = 1 or gamma(1 / 2) = sqrt(pi), multiplied upwards.
    odd = dof.cast("bigint") % 2 == 1
    places = F.sequence(F.lit(1), F.greatest(F.floor(a + 0.5).cast("int"), F.lit(1)))
    log_gamma = F.aggregate(places, F.when(odd, F.lit(0.5723649429247001)).otherwise(0.0), lambda acc, i: acc + F.when(F.when(odd, i - 0.5).otherwise(i.cast("double")) <= a, F.log(F.when(odd, i - 0.5).otherwise(i.cast("double")))).otherwise(0.0))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda acc, i: F.struct((acc["t"] * half / (a + i)).alias("t"), (acc["s"] + acc["t"] * half / (a + i)).alias("s")), lambda acc: acc["s"])
    low = F.exp(a * F.log(half) - half - log_gamma) * series
    return F.when(x <= 0, 1.0).when(x > 400, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - low))
