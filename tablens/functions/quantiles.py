"""Exact quantiles with bounded memory, one way at every size.

Values are counted per (group, column, value), which collapses hot values before the shuffle; the
counts are range-sorted; every sorted partition knows how many values lie before it; the rows
that hold the wanted ranks are picked and interpolated (position p * (n - 1), linear between the
neighbouring ranks). No task holds a column, and only results reach the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def grouped_quantiles(df: DataFrame, by: str | None, cols: list[str], probs: list[float]) -> DataFrame:
    """(by, position, q array<double>) over the non-null, non-NaN values of each column; ``position`` is the
    column's place in ``cols``. Columns without values give no row."""
    key = F.lit(0) if by is None else F.col(by)
    value = F.array(*[F.struct(F.lit(i).alias("position"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    counted = (df.select(key.alias("by"), F.inline(value)).where(F.col("v").isNotNull() & ~F.isnan("v"))
               .groupBy("by", "position", "v").agg(F.count(F.lit(1)).alias("n")))
    at = durable(counted.orderBy("by", "position", "v").withColumn("pid", F.spark_partition_id()))
    group = ["by", "position"]
    parts = at.groupBy("pid", *group).agg(F.sum("n").alias("m"))
    before = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pid", *group, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"),
                         F.sum("m").over(Window.partitionBy(*group)).alias("total"))
    # only parts that span a wanted rank are read on; the others' counts have done their work
    spans = F.lit(False)
    for p in probs:
        rank = F.lit(float(p)) * (F.col("total") - 1)
        spans = spans | ((F.ceil(rank) >= F.col("offset")) & (F.floor(rank) < F.col("offset") + F.col("m")))
    parts = parts.where(spans)
    same = (F.col("a.pid") == F.col("b.pid")) & F.col("a.by").eqNullSafe(F.col("b.by")) & (F.col("a.position") == F.col("b.position"))
    rows = at.alias("a").join(parts.alias("b"), same).select("a.*", "offset", "total")
    running = F.sum("n").over(Window.partitionBy("pid", *group).orderBy("v"))
    rows = rows.withColumn("hi", F.col("offset") + running).withColumn("lo", F.col("hi") - F.col("n"))
    place = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    within = lambda rank: (rank >= F.col("lo")) & (rank < F.col("hi"))
    wanted = F.lit(False)
    for p in place:
        wanted = wanted | within(F.floor(p)) | within(F.ceil(p))
    low = [F.max(F.when(within(F.floor(p)), F.col("v"))) for p in place]
    high = [F.max(F.when(within(F.ceil(p)), F.col("v"))) for p in place]
    share = [F.max(p - F.floor(p)) for p in place]
    q = F.array(*[a + s * (b - a) for a, b, s in zip(low, high, share)])
    return rows.where(wanted).groupBy(*group).agg(q.alias("q"))


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    """{(col, p): value} over the non-null values of each column (None for an empty column)."""
    out = {(c, p): None for c in cols for p in probs}
    if cols:
        for r in grouped_quantiles(df, None, cols, probs).collect():      # one row per column
            out.update({(cols[r["position"]], p): v for p, v in zip(probs, r["q"])})
    return out
