"""Chart series (C1-C9): the tables behind the nine charts. Drawing is not done here.

Samples are top-k by a stable hash of the id (``orderBy(hash).limit(n)`` runs as a
per-partition top-k plus a merge), so they do not change with the partitioning."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import stable_hash
from ..functions.quantiles import grouped_quantiles



def _name(c):
    return F.when(c == -1, F.lit("Noise")).otherwise(F.concat(F.lit("Cluster "), c.cast("string")))


def sample_rows(df: DataFrame, id_col: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """T5: n rows without replacement, repeatable (smallest hashes of the id); all without ``n``."""
    if n is None:
        return df
    return df.orderBy(stable_hash(F.col(id_col), seed=seed), F.col(id_col)).limit(n)


def scatter_2d(rows: DataFrame, id_col: str, n: int | None = None) -> DataFrame:
    """(id, pc1, pc2, cluster, series)."""
    return sample_rows(rows, id_col, n).select(id_col, "pc1", "pc2", "cluster", _name(F.col("cluster")).alias("series"))


def scatter_3d(rows: DataFrame, id_col: str, n: int | None = None) -> DataFrame:
    """pc3 = 0 when there are only two components."""
    pc3 = F.col("pc3") if "pc3" in rows.columns else F.lit(0.0)
    return sample_rows(rows, id_col, n).select(id_col, "pc1", "pc2", F.coalesce(pc3, F.lit(0.0)).alias("pc3"),
                                               "cluster", _name(F.col("cluster")).alias("series"))


def cluster_bars(sizes: DataFrame) -> DataFrame:
    """(series, size, text) with the share as 'x%'."""
    return sizes.select(_name(F.col("cluster_id")).alias("series"), "size",
                        F.concat(F.col("percentage").cast("string"), F.lit("%")).alias("text"))


def feature_boxes(labelled: DataFrame, features: list[str], cluster_col: str = "cluster", limit: int | None = None) -> DataFrame:
    """C4: per cluster and feature (the first ``limit`` of them, else all): five-number summary and the
    centroid. One path for clusters of any size."""
    feats = features[:limit]
    names = ("min", "q1", "median", "q3", "max")
    q = grouped_quantiles(labelled, cluster_col, feats, [0.0, 0.25, 0.5, 0.75, 1.0])
    means = labelled.groupBy(F.col(cluster_col).alias("__k")).agg(F.array(*[F.avg(c) for c in feats]).alias("__m"))
    return q.join(means, F.col("by").eqNullSafe(F.col("__k"))).select(
        F.col("by").alias("cluster_id"), "position", F.get(F.array(*[F.lit(c) for c in feats]), F.col("position")).alias("feature"),
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)], F.get("__m", F.col("position")).alias("mean"))


def heatmap(corr: DataFrame) -> DataFrame:
    """(f1, f2, r) with missing values as 0."""
    return corr.select("f1", "f2", F.coalesce(F.nanvl(F.col("r"), F.lit(None)), F.lit(0.0)).alias("r"))


def quality(sizes: DataFrame, silhouette: float | None) -> DataFrame:
    """Per-cluster sizes next to the overall silhouette (or 'N/A')."""
    text = "N/A" if silhouette is None else f"{silhouette:.3f}"
    return sizes.select(_name(F.col("cluster_id")).alias("series"), "size", F.lit(text).alias("silhouette"))


def parallel_coordinates(centroids: DataFrame, limit: int | None = None) -> DataFrame:
    """Centroid per cluster on the first ``limit`` features (else all)."""
    return centroids if limit is None else centroids.where(F.col("position") < limit)


def anomaly_overlay(rows: DataFrame, id_col: str, n: int | None = None) -> DataFrame:
    """All anomalies, plus normals sampled to fill up to n; all normals without ``n``, and
    when the anomalies alone reach n (there is nothing to fill up to)."""
    a, normals = rows.where(F.col("anomaly") == 1), rows.where(F.col("anomaly") == 0)
    if n is not None:
        room = n - a.count()
        normals = sample_rows(normals, id_col, room) if room > 0 else normals
    return a.unionByName(normals).select(id_col, "pc1", "pc2", "anomaly")


def distributions(stats: DataFrame, limit: int | None = None) -> DataFrame:
    """First ``limit`` features (else all): min, q25, median, q75, max, mean; features with empty stats skipped."""
    return (stats if limit is None else stats.where(F.col("position") < limit)).where(
        F.col("min").isNotNull() & F.col("max").isNotNull()).select(
        "position", "feature", "min", "q25", "median", "q75", "max", "mean")
