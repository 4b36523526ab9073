"""Cluster profiles (A3-A6): sizes, centroids, distinguishing features, anomaly share.

Inputs carry the cluster label next to the raw feature columns, so profiling is a
plain ``groupBy(cluster)`` with partial aggregation - no join back to the rows.
The cluster-level tables are tiny (one row per cluster or per cluster x feature).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import round_half_up

TOP_FEATURES = 5


def cluster_sizes(labelled: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A3: (cluster_id, size, percentage); percentage of all rows, 1 decimal; noise -1 is a group."""
    g = labelled.groupBy(F.col(cluster_col).cast("int").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())   # over the per-cluster table only
    return g.select("cluster_id", "size", round_half_up(F.col("size") * 100.0 / total, 1).alias("percentage"))


def _cluster_means(labelled: DataFrame, features: list[str], cluster_col: str) -> DataFrame:
    items = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.avg(c).alias("cluster_mean"))
             for i, c in enumerate(features)]
    return (labelled.groupBy(F.col(cluster_col).cast("int").alias("cluster_id"))
            .agg(F.array(*items).alias("s")).select("cluster_id", F.inline("s")))


def _overall(labelled: DataFrame, features: list[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("overall_mean"),
                      F.stddev_pop(c).alias("overall_std")) for c in features]
    return labelled.agg(F.array(*items).alias("s")).select(F.inline("s"))


def cluster_centroids(labelled: DataFrame, features: list[str], cluster_col: str = "cluster",
                      decimals: int | None = 4) -> DataFrame:
    """A4: (cluster_id, position, feature, value) - mean per cluster in original units."""
    m = _cluster_means(labelled, features, cluster_col)
    v = round_half_up(F.col("cluster_mean"), decimals) if decimals is not None else F.col("cluster_mean")
    return m.select("cluster_id", "position", "feature", v.alias("value"))


def top_features(labelled: DataFrame, features: list[str], cluster_col: str = "cluster", n: int = TOP_FEATURES,
                 decimals: int | None = 4) -> DataFrame:
    """A5: per cluster the n features whose scaled cluster mean lies farthest from the scaled
    overall mean. Scaling is linear, so |mean_c(z)| = |mean_c(x) - mean(x)| / std_pop(x):
    no scaled copy of the rows is needed. Ties go to the earlier feature."""
    m = _cluster_means(labelled, features, cluster_col)
    o = F.broadcast(_overall(labelled, features))        # one row per feature
    j = m.join(o, "feature")
    dev = F.abs(F.col("cluster_mean") - F.col("overall_mean")) / F.col("overall_std")
    j = j.withColumn("z_signed", (F.col("cluster_mean") - F.col("overall_mean")) / F.col("overall_std"))
    j = j.withColumn("z_deviation", dev)
    w = Window.partitionBy("cluster_id").orderBy(F.col("z_deviation").desc(), F.col("position"))
    r = (lambda c: round_half_up(F.col(c), decimals)) if decimals is not None else F.col
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("cluster_id", "rank", "feature", r("cluster_mean").alias("cluster_mean"),
                    r("overall_mean").alias("overall_mean"), r("z_deviation").alias("z_deviation"),
                    r("z_signed").alias("z_signed")))


def anomaly_share(flags: DataFrame, flag_col: str = "anomaly") -> DataFrame:
    """(anomalies, rows, share_pct) with the share in percent, 1 decimal."""
    return flags.agg(F.sum(F.col(flag_col).cast("long")).alias("anomalies"), F.count(F.lit(1)).alias("rows")) \
        .select("anomalies", "rows", round_half_up(F.col("anomalies") * 100.0 / F.col("rows"), 1).alias("share_pct"))
