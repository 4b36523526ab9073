"""Column statistics and correlations (A1, A2) as single aggregate passes.

Each result is produced by one global aggregate whose output is an array of
structs, inlined to long rows - the numbers never pass through the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import round_half_up
from ..functions.quantiles import quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _q(c: str, exact: bool, known: dict | None):
    if known is not None:
        return F.array(*[F.lit(known[(c, p)]).cast("double") for p in QUARTILES])
    return F.percentile_approx(F.col(c), F.array(*[F.lit(p) for p in QUARTILES]), 10000)


def column_stats(df: DataFrame, features: list[str], decimals: int | None = 4, exact: bool = True) -> DataFrame:
    """A1: (position, feature, mean, std, min, max, median, q25, q75); std is the sample std,
    quartiles interpolate linearly. ``exact=False`` swaps in bounded-memory sketches."""
    r = (lambda c: round_half_up(c, decimals)) if decimals is not None else (lambda c: c)
    # exact quartiles with bounded memory
    known = quantiles(df, features, list(QUARTILES)) if exact else None
    items = []
    for i, c in enumerate(features):
        q = _q(c, exact, known)
        items.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("feature"),
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            q.alias("q")))
    wide = df.agg(F.array(*items).alias("s")).select(F.inline("s"))
    return wide.select(
        "position", "feature", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
        r(F.col("min")).alias("min"), r(F.col("max")).alias("max"),
        r(F.col("q")[1]).alias("median"), r(F.col("q")[0]).alias("q25"), r(F.col("q")[2]).alias("q75"))


def correlation_long(df: DataFrame, features: list[str], cap: int | None = None,
                     decimals: int | None = 4) -> DataFrame:
    """A2: Pearson correlation of the first ``cap`` features (else all), full symmetric long form
    (f1, f2, r) with a unit diagonal; all pairs in one aggregate pass."""
    cols = features[:cap]
    r = (lambda c: round_half_up(c, decimals)) if decimals is not None else (lambda c: c)
    items = []
    for i, a in enumerate(cols):
        items.append(F.struct(F.lit(a).alias("f1"), F.lit(a).alias("f2"), F.lit(1.0).alias("r")))
        for b in cols[i + 1:]:
            k = F.corr(a, b)
            items.append(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), k.alias("r")))
            items.append(F.struct(F.lit(b).alias("f1"), F.lit(a).alias("f2"), k.alias("r")))
    long = df.agg(F.array(*items).alias("s")).select(F.inline("s"))
    return long.select("f1", "f2", r(F.col("r")).alias("r"))
