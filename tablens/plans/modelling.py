"""Registered queries for the models (M1-M8) and the whole analysis.

Seeded models (k-means, isolation forest) cannot match another engine's random streams, so they
have no SQL twin. Parts that SQL can state exactly have twins: the linear silhouette for given
labels, assignment to given centres, one k-means step, k-th neighbour distances, core flags and
DBSCAN labels for a given eps.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import density, iforest, models, prep
from ..session import table
from .pipeline import analyze
from .registry import query, r4, rounded

CUSTOMER_NUMERIC = ["c_acctbal", "c_nationkey"]
CUSTOMER_CATEGORICAL = ["c_mktsegment", "c_name"]


def _customer(spark, sf):
    p = prep.prepare_features(table(spark, sf, "customer"), "c_custkey", CUSTOMER_NUMERIC, CUSTOMER_CATEGORICAL)
    return p, models.matrix(p)


def _embeddings_matrix(spark, sf):
    """Raw embedding vectors as the matrix (no scaling): id ``vec_id``, given ``cluster``."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias(models.Z))


@query("kmeans_customer")
def kmeans_customer(spark, sf):
    """M2 + M3: k chosen by silhouette sweep with 3 restarts for each k, 5 for the chosen one; one label per customer."""
    p, m = _customer(spark, sf)
    centres = models.choose_k(m, "c_custkey", p.n_rows).fit.centres
    return models.label_rows(m, centres, numbering=models.numbering_by_size(m, centres)).select("c_custkey", "cluster")


@query("pca_customer")
def pca_customer(spark, sf):
    """M1: three principal coordinates per customer."""
    p, m = _customer(spark, sf)
    pts, _, _ = models.pca_points(p, m)
    return rounded(pts)


@query("dbscan_customer")
def dbscan_customer(spark, sf):
    """M4 + M5: auto eps, min_samples = max(5, n // 100); noise is -1."""
    p, m = _customer(spark, sf)
    ms = max(5, p.n_rows // 100)
    index = density.cells_of(m, "c_custkey")
    eps = density.auto_eps(m, "c_custkey", ms, p.n_rows, index)
    out, _ = density.dbscan(m, "c_custkey", eps, ms, index=index)
    return out.select("c_custkey", "cluster")


@query("iforest_lineitem")
def iforest_lineitem(spark, sf):
    """M8 over every lineitem row: decision score and the 5% flag."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                                             "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    p = prep.prepare_features(li, "id")
    m = models.matrix(p)
    return rounded(iforest.detect_anomalies(m, "id", p.n_rows, 0.05))


#: A fixed forest over (l_quantity, l_extendedprice, l_discount, l_tax): tree, node, feature, threshold, left, right, size, depth.
FOREST = [
    (0, 0, 0, 25.5, 1, 2, 256, 0), (0, 1, 1, 9000.0, 3, 4, 120, 1), (0, 2, 2, 0.045, 5, 6, 136, 1),
    (0, 3, -1, 0.0, -1, -1, 20, 2), (0, 4, 3, 0.025, 7, 8, 100, 2), (0, 5, -1, 0.0, -1, -1, 60, 2), (0, 6, -1, 0.0, -1, -1, 76, 2),
    (0, 7, -1, 0.0, -1, -1, 1, 3), (0, 8, -1, 0.0, -1, -1, 99, 3),
    (1, 0, 1, 50000.0, 1, 2, 256, 0), (1, 1, 0, 3.5, 3, 4, 200, 1), (1, 2, -1, 0.0, -1, -1, 56, 1),
    (1, 3, -1, 0.0, -1, -1, 2, 2), (1, 4, -1, 0.0, -1, -1, 198, 2),
    (2, 0, 3, 0.065, 1, 2, 256, 0), (2, 1, -1, 0.0, -1, -1, 190, 1), (2, 2, 2, 0.085, 3, 4, 66, 1),
    (2, 3, -1, 0.0, -1, -1, 50, 2), (2, 4, -1, 0.0, -1, -1, 16, 2),
]


@query("iforest_fixed_lineitem", f"""
WITH RECURSIVE f(tree, node, feature, threshold, l, r, size, depth) AS (VALUES {", ".join(map(str, FOREST))}),
x AS (SELECT l_orderkey * 8 + l_linenumber AS id, row_number() OVER () AS place, [l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[] AS v FROM lineitem),
w AS (SELECT id, place, v, tree, node, feature, threshold, l, r, size, depth FROM x, f WHERE node = 0
  UNION ALL SELECT w.id, w.place, w.v, f.tree, f.node, f.feature, f.threshold, f.l, f.r, f.size, f.depth
  FROM w JOIN f ON f.tree = w.tree AND f.node = CASE WHEN w.v[w.feature + 1] < w.threshold THEN w.l ELSE w.r END WHERE w.feature >= 0),
p AS (SELECT id, avg(depth + CASE WHEN size > 2 THEN 2 * (ln(size - 1) + 0.5772156649015329) - 2.0 * (size - 1) / size WHEN size = 2 THEN 1.0 ELSE 0.0 END) AS p
  FROM w WHERE feature < 0 GROUP BY id, place),
s AS (SELECT id, -pow(2, -p / (2 * (ln(255) + 0.5772156649015329) - 2.0 * 255 / 256)) AS raw FROM p)
SELECT id, {r4('raw', 6)} AS raw FROM s""")
def iforest_fixed_lineitem(spark, sf):
    """M8, scoring: every lineitem row under a given table of nodes."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(
        *[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias(models.Z))
    nodes = pd.DataFrame(FOREST, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    return rounded(iforest.scores(li, nodes, 256, ["id"]), 6)


PCA_COLUMNS = ["n_chars", "words", "lines", "digits"]


@query("pca_axis_documents", f"""
WITH RECURSIVE d AS (SELECT n_chars, length(text) - length(replace(text, ' ', '')) AS words, length(text) - length(replace(text, chr(10), '')) AS lines,
  length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits FROM documents),
x AS (SELECT {", ".join(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ())::DOUBLE AS x{i}" for i, c in enumerate(PCA_COLUMNS))} FROM d),
c AS (SELECT [{", ".join("[" + ", ".join(f"covar_samp(x{i}, x{j})" for j in range(4)) + "]" for i in range(4))}] AS c FROM x),
s AS (SELECT 0 AS step, [0.9, 0.7, 0.5, 0.3]::DOUBLE[] AS v FROM c
  UNION ALL SELECT step + 1, list_transform(w, lambda a: a / sqrt(list_inner_product(w, w))) FROM (
    SELECT step, list_transform(c, lambda line: list_inner_product(line, v)) AS w FROM s, c WHERE step < 200)),
l AS (SELECT v, list_inner_product(v, list_transform(c, lambda line: list_inner_product(line, v))) / (c[1][1] + c[2][2] + c[3][3] + c[4][4]) AS share,
  list_transform(v, lambda a: abs(a)) AS size FROM s, c WHERE step = 200),
u AS (SELECT unnest(range(4))::INT AS position, unnest(v) * sign(v[list_position(size, list_max(size))]) AS loading, share FROM l)
SELECT position, {r4('loading')} AS loading, {r4('share')} AS share FROM u""")
def pca_axis_documents(spark, sf):
    """M1: the first principal axis of four standardised counts of each text, and its share of the variance."""
    size = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    d = table(spark, sf, "documents").select("doc_id", "n_chars", size(" ").alias("words"), size("\n").alias("lines"), size("[0-9]").alias("digits"))
    p = prep.prepare_features(d, "doc_id")
    m = models.matrix(p)
    v, share = models.principal_axes(m, 1)
    m.unpersist()
    p.unpersist()
    return rounded(spark.createDataFrame([(i, float(a), float(share[0])) for i, a in enumerate(v[:, 0])],
                                         "position int, loading double, share double"))


@query("analysis_rows_customer")
def analysis_rows_customer(spark, sf):
    """The row-level result of the whole analysis (cluster, pc1-3, score, flag)."""
    a = analyze(table(spark, sf, "customer"), "c_custkey", "customer", "kmeans", None,
                CUSTOMER_NUMERIC, CUSTOMER_CATEGORICAL)
    return rounded(a.rows)


EMB_SQL = "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings"


#: Linear silhouette (squared Euclidean) of every embedding for its given label; used by two queries.
SILHOUETTE_SQL = f"""
WITH e AS ({EMB_SQL}),
u AS (SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
m AS (SELECT label, i, avg(x) AS mean FROM u GROUP BY label, i),
z AS (SELECT label, count(*) AS n, avg(list_inner_product(v, v)) AS square FROM e GROUP BY label),
c AS (SELECT vec_id, m.label AS other, sum(x * mean) AS dot FROM u JOIN m USING (i) GROUP BY vec_id, m.label),
d AS (SELECT e.vec_id, e.label AS own, other, n, greatest(list_inner_product(v, v) + square - 2 * dot, 0) AS far
      FROM e JOIN c USING (vec_id) JOIN z ON z.label = other),
p AS (SELECT vec_id, own, max(CASE WHEN other = own THEN far * n / greatest(n - 1, 1) END) AS a,
        min(CASE WHEN other <> own THEN far END) AS b, max(CASE WHEN other = own THEN n END) AS n FROM d GROUP BY vec_id, own),
s AS (SELECT vec_id AS id, own::INT AS cluster, CASE WHEN n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s FROM p)"""


@query("silhouette_given_labels", f"{SILHOUETTE_SQL} SELECT id, cluster, {r4('s')} AS silhouette FROM s")
def silhouette_given_labels(spark, sf):
    """M7 per point, linear form (squared Euclidean), on the raw embeddings with their given labels."""
    return rounded(models.silhouette(_embeddings_matrix(spark, sf), "vec_id", per_point=True))


def _label_centres(spark, sf):
    return np.stack(models.cluster_summaries(_embeddings_matrix(spark, sf))["mean"].to_numpy())


CENTRES_SQL = f"""
WITH e AS ({EMB_SQL}),
u AS (SELECT vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
m AS (SELECT label, i, avg(x) AS mean FROM u GROUP BY label, i),
d AS (SELECT vec_id, m.label AS c, sum((x - mean) * (x - mean)) AS far FROM u JOIN m USING (i) GROUP BY vec_id, m.label),
n AS (SELECT vec_id, (dense_rank() OVER (ORDER BY c) - 1)::INT AS c, far FROM d),
g AS (SELECT vec_id, arg_min(c, far) AS cluster FROM n GROUP BY vec_id)"""


@query("kmeans_assign", f"{CENTRES_SQL} SELECT vec_id, cluster FROM g")
def kmeans_assign(spark, sf):
    """M3, assignment: every embedding to the nearest of the labels' mean vectors."""
    m = _embeddings_matrix(spark, sf).drop("cluster")
    return models.label_rows(m, _label_centres(spark, sf)).select("vec_id", "cluster")


@query("kmeans_step", f"""{CENTRES_SQL}
SELECT cluster, (i - 1)::INT AS position, {r4('avg(x)')} AS centre, count(*) AS rows
FROM u JOIN g USING (vec_id) GROUP BY cluster, i""")
def kmeans_step(spark, sf):
    """M3, one step: the mean of the embeddings nearest to each of the labels' mean vectors."""
    return rounded(models.lloyd_step(_embeddings_matrix(spark, sf), _label_centres(spark, sf)))


@query("dbscan_labels", f"""
WITH RECURSIVE e AS ({EMB_SQL}),
ms AS (SELECT greatest(5, count(*) // 100) AS ms FROM e),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON list_distance(a.v, b.v) <= 1.25),
k AS (SELECT x FROM p GROUP BY x HAVING count(*) >= (SELECT ms FROM ms)),
l AS (SELECT p.x, p.y FROM p JOIN k a ON a.x = p.x JOIN k b ON b.x = p.y),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
n AS (SELECT x, (dense_rank() OVER (ORDER BY low) - 1)::INT AS cluster FROM c),
b AS (SELECT p.x, min(n.cluster) AS cluster FROM p JOIN n ON n.x = p.y GROUP BY p.x)
SELECT vec_id, coalesce(n.cluster, b.cluster, -1) AS cluster FROM e LEFT JOIN n ON n.x = vec_id LEFT JOIN b ON b.x = vec_id""")
def dbscan_labels(spark, sf):
    """M5 on the raw embeddings with eps = 1.25, min_samples = max(5, n // 100)."""
    m = _embeddings_matrix(spark, sf).drop("cluster")
    out, _ = density.dbscan(m, "vec_id", 1.25, max(5, m.count() // 100))
    return out.select("vec_id", "cluster")


@query("knn_distance", f"""
WITH e AS ({EMB_SQL}),
n AS (SELECT least(greatest(5, count(*) // 100), count(*) - 1) AS k FROM e),
d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS dist,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v)) AS rn FROM e a JOIN e b ON true)
SELECT vec_id AS qid, {r4('dist')} AS kdist FROM d, n WHERE rn = n.k""")
def knn_distance(spark, sf):
    """M4 core: distance to the k-th neighbour (self first) for every embedding."""
    m = _embeddings_matrix(spark, sf)
    n = m.count()
    k = max(1, min(max(5, n // 100), n - 1))
    return rounded(density.kth_distances_all(m, "vec_id", k, n))


@query("knn_distance_customer", f"""
WITH e AS (SELECT c_custkey, [c_acctbal / 1000, c_nationkey]::DOUBLE[] AS v FROM customer),
d AS (SELECT a.c_custkey, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON true)
SELECT c_custkey AS qid, {r4('list_sort(list(dist))[10]')} AS kdist FROM d GROUP BY c_custkey""")
def knn_distance_customer(spark, sf):
    """M4 core on two columns, where the metric index leaves out most blocks: distance to the 10th neighbour (self first)."""
    c = table(spark, sf, "customer")
    m = c.select("c_custkey", F.array((F.col("c_acctbal") / 1000).cast("double"), F.col("c_nationkey").cast("double")).alias(models.Z))
    return rounded(density.kth_distances_all(m, "c_custkey", 10))


@query("dbscan_core_flags", f"""
WITH e AS ({EMB_SQL}),
n AS (SELECT greatest(5, count(*) // 100) AS ms FROM e)
SELECT a.vec_id AS id, count(*) AS neighbours, count(*) >= max(n.ms) AS core
FROM e a JOIN e b ON list_distance(a.v, b.v) <= 1.25, n GROUP BY a.vec_id""")
def dbscan_core_flags(spark, sf):
    """M5 first pass: neighbour counts within eps = 1.25 (self included) and core flags."""
    m = _embeddings_matrix(spark, sf)
    n = m.count()
    counts = density.neighbour_counts(m, "vec_id", 1.25)
    return counts.select("id", "neighbours", (F.col("neighbours") >= max(5, n // 100)).alias("core"))


@query("choose_k_customer")
def choose_k_customer(spark, sf):
    """M2: the sweep (k, linear silhouette over all rows, whether its best fit converged) and the chosen k."""
    p, m = _customer(spark, sf)
    k, trace, _ = models.choose_k(m, "c_custkey", p.n_rows)
    return spark.createDataFrame([(kk, s, done, kk == k) for kk, s, done in trace], "k int, silhouette double, converged boolean, chosen boolean")
