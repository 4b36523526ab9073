"""Flagship: profile a table, prepare its features, cluster with k-means and describe each cluster."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile
from ..session import table
from .pipeline import analyze


def flagship(spark: SparkSession, sf_dir: str, table_name: str = "customer", id_col: str = "c_custkey",
             algorithm: str = "kmeans", k: int | None = None) -> DataFrame:
    """Per-cluster description: size, share and the top distinguishing features."""
    df = table(spark, sf_dir, table_name)
    pv = profile.preview_columns(df)
    numeric = [c for c in pv.numeric_columns if c != id_col]
    a = analyze(df, id_col, table_name, algorithm, k, numeric, pv.categorical_columns)
    return a.sizes.join(a.top, "cluster_id").orderBy("cluster_id", "rank")
