"""The whole analysis (M10): missing census -> preparation -> PCA -> clustering ->
profiles -> anomalies -> statistics. Row-level results stay DataFrames; only small
summaries are materialised."""
from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import iforest, models, prep, profile, profiles, stats
from ..operators import density

ALGORITHMS = ("kmeans", "dbscan")
# Accepted anomaly share.
CONTAMINATION_MIN, CONTAMINATION_MAX = 0.01, 0.5


@dataclass
class Analysis:
    id: str
    title: str
    algorithm: str
    params: dict
    n_rows: int
    n_clusters: int
    silhouette: float | None
    names: list[str]
    encoding: list[dict]
    dropped: list[dict]
    original_column_count: int
    rows: DataFrame                 # id, cluster, pc1.., score, anomaly
    missing: DataFrame
    sizes: DataFrame
    centroids: DataFrame
    top: DataFrame
    column_stats: DataFrame
    correlation: DataFrame
    prepared: prep.Prepared = field(repr=False, default=None)
    extra: dict = field(default_factory=dict)

    def release(self) -> None:
        """Drop the cached matrix, labels and features once the results have been used
        (the result frames are lazy views over them)."""
        for df in self.extra.get("cached", []):
            df.unpersist()
        if self.prepared is not None:
            self.prepared.unpersist()

    def centroids_decoded(self) -> DataFrame:
        """Centroids with label-encoded features turned back into their category."""
        maps = self.prepared.label_maps if self.prepared is not None else None
        if maps is None:
            return self.centroids.withColumn("category", F.lit(None).cast("string"))
        return prep.decode_labels(self.centroids, maps)


def cluster(m: DataFrame, id_col: str, n: int, algorithm: str = "kmeans", k: int | None = None, eps: float | None = None):
    """Dispatch: (labelled matrix, n_clusters, params)."""
    if algorithm == "kmeans":
        if k is None:
            k, _, fit = models.choose_k(m, id_col, n)
            labelled = models.label_rows(m, fit.centres, numbering=models.numbering_by_size(m, fit.centres))
        else:
            labelled, fit = models.kmeans(m, id_col, k)
        return labelled, k, {"n_clusters": k, "n_init": models.KMEANS_RESTARTS, "converged": fit.converged}
    if algorithm == "dbscan":
        min_samples = max(5, n // 100)
        index = density.cells_of(m, id_col)
        eps = density.auto_eps(m, id_col, min_samples, n, index) if eps is None else eps
        labelled, n_clusters = density.dbscan(m, id_col, eps, min_samples, index=index)
        return labelled, n_clusters, {"eps": round(eps, 4), "min_samples": min_samples}
    raise ValueError(f"Unknown algorithm: {algorithm}")


def analyze(df: DataFrame, id_col: str | None = None, name: str = "dataset", algorithm: str = "kmeans",
            k: int | None = None, numeric: list[str] | None = None, categorical: list[str] | None = None,
            contamination: float = 0.05, eps: float | None = None) -> Analysis:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"Unknown algorithm: {algorithm}")
    if not CONTAMINATION_MIN <= contamination <= CONTAMINATION_MAX:
        raise ValueError(f"contamination must be between {CONTAMINATION_MIN} and {CONTAMINATION_MAX}")
    if k is not None and k < 2:
        k = None                  # fewer than two clusters asked for: choose k automatically
    missing = profile.missing_values(df)
    p = prep.prepare_features(df, id_col, numeric, categorical)
    m = models.matrix(p)
    n = p.n_rows
    loadings, _ = models.pca_fit(p, m)
    labelled, n_clusters, params = cluster(m, p.id_col, n, algorithm, k, eps)
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
    sil = models.silhouette(labelled, p.id_col)
    with_pcs = labelled.select("*", *models.pc_columns(p, loadings))
    pcs = [f"pc{j + 1}" for j in range(loadings.shape[1])]
    rows = iforest.detect_anomalies(with_pcs, p.id_col, n, contamination, keep=["cluster", *pcs])
    return Analysis(
        id=str(uuid.uuid4()), title=f"{algorithm.upper()} Analysis of {name}", algorithm=algorithm,
        params=params, n_rows=n, n_clusters=n_clusters, silhouette=sil, names=p.names, encoding=p.encoding,
        dropped=p.dropped, original_column_count=len(df.columns), rows=rows, missing=missing,
        sizes=profiles.cluster_sizes(labelled), centroids=profiles.cluster_centroids(labelled, p.names),
        top=profiles.top_features(labelled, p.names), column_stats=stats.column_stats(p.features, p.names),
        correlation=stats.correlation_long(p.features, p.names), prepared=p,
        extra={"cached": [m, labelled]})


def charts(a: Analysis) -> dict:
    """C1-C9 for one analysis: name -> series DataFrame (drawing is left to the caller)."""
    from ..operators import series
    sizes = a.sizes
    return {
        "scatter_2d": series.scatter_2d(a.rows, a.prepared.id_col),
        "scatter_3d": series.scatter_3d(a.rows, a.prepared.id_col),
        "cluster_sizes": series.cluster_bars(sizes),
        "feature_boxes": series.feature_boxes(
            a.prepared.features.join(a.rows.select(a.prepared.id_col, "cluster"), a.prepared.id_col), a.names),
        "correlation_heatmap": series.heatmap(a.correlation),
        "clustering_quality": series.quality(sizes, a.silhouette),
        "parallel_coordinates": series.parallel_coordinates(a.centroids),
        "anomaly_overlay": series.anomaly_overlay(a.rows, a.prepared.id_col),
        "feature_distributions": series.distributions(a.column_stats),
    }


def save_analysis(store, a: Analysis, dataset: dict | None = None) -> str:
    """W2 for a whole analysis: one run row (configuration and small summaries as JSON), one
    chart row per series in display order, and the row-level result written as a Parquet
    table under the run (row arrays never go through the driver)."""
    dataset = dataset or {}
    sizes = [r.asDict() for r in a.sizes.orderBy("cluster_id").collect()]          # one row per cluster
    top = [r.asDict() for r in a.top.orderBy("cluster_id", "rank").collect()]      # <= 5 per cluster
    stats = [r.asDict() for r in a.column_stats.orderBy("position").collect()]     # one row per feature
    missing = {r["column"]: r["missing"] for r in a.missing.collect()}             # one row per column
    rows_path = f"{store.root}/rows/{a.id}"
    a.rows.write.mode("overwrite").parquet(rows_path)
    series = charts(a)
    chart_rows = [{"chart_type": name, "title": name.replace("_", " ").title(),
                   "plotly_json": json.dumps({"series_path": f"{store.root}/charts/{a.id}/{name}"})}
                  for name in series]
    for name, df in series.items():
        df.write.mode("overwrite").parquet(f"{store.root}/charts/{a.id}/{name}")
    run = {"id": a.id, "title": a.title, "dataset_source": dataset.get("source"), "dataset_id": dataset.get("id"),
           "dataset_name": dataset.get("name"), "dataset_url": dataset.get("url", ""), "num_rows": a.n_rows,
           "num_columns": len(a.names), "column_names": a.names,
           "analysis_config": {"algorithm": a.algorithm, "params": a.params, "columns": a.names,
                               "encoding_info": a.encoding},
           "analysis_result": {"n_clusters": a.n_clusters, "silhouette_score": a.silhouette, "cluster_sizes": sizes,
                               "top_features": top, "column_stats": stats, "missing_values": missing,
                               "dropped_columns": a.dropped, "original_column_count": a.original_column_count,
                               "rows_path": rows_path}}
    return store.save(run, chart_rows)
