"""Modelling on the scaled feature matrix (M1-M3, M7, M9).

- The matrix is built once: raw feature columns plus an array ``__z`` of the
  standardised values, persisted; every model reads it.
- k-means: three seeded fits for every k and five for the chosen one. All fits take their steps together: one pass over the rows
  moves the centres of every fit that has not converged, so the matrix is read as often as the slowest fit needs and not once for each
  step of each fit. Starts are k-means++ on a bounded sample. A fit that stops at ``MAX_ITER`` is reported.
- Silhouette is the linear form over all rows: squared Euclidean distances, from each cluster's
  row count, sum and sum of squares; no pairs of rows.
- PCA: block Lanczos on the row matrix. Each pass multiplies the covariance with a few vectors (d x l numbers a task); the driver
  holds the Krylov basis (d x at most ``BASIS`` numbers) and never a d x d matrix; the projection is plain column arithmetic.
"""
from __future__ import annotations

import math
import warnings
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boxes import sample_rows
from .prep import Prepared

Z = "__z"
SEED = 42
KMEANS_RESTARTS, SWEEP_RESTARTS = 5, 3
MAX_ITER = 300
#: A fit has converged when its centres' squared moves sum to this at most (standardised features have variance 1).
TOL = 1e-4
#: A matrix of more rows than this is dealt to several tasks even if its table was read by one.
ROWS_A_TASK = 50_000
#: Columns of a Krylov basis at most (beyond the number of components asked for), and a component's residual to stop at.
BASIS, RESIDUAL, BLOCK_EXTRA = 160, 1e-9, 8


def z_exprs(p: Prepared):
    return [((F.col(c) - F.lit(p.means[c])) / F.lit(p.stds[c] or 1.0)) for c in p.names]


def matrix(p: Prepared) -> DataFrame:
    """id, raw features, and the standardised values ``__z``; persisted. A table that was read by fewer tasks than its
    rows are worth (one file, one row group) is dealt by id once: every model reads the matrix many times."""
    m = p.features.select("*", F.array(*z_exprs(p)).alias(Z))
    tasks = min(m.sparkSession.sparkContext.defaultParallelism, math.ceil(p.n_rows / ROWS_A_TASK))
    if m.rdd.getNumPartitions() < tasks:
        m = m.repartition(tasks, p.id_col)
    return m.persist(StorageLevel.MEMORY_AND_DISK)


# ------------------------------------------------------------------ k-means (M3)
class Fit(NamedTuple):
    centres: np.ndarray
    cost: float
    converged: bool


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k starting centres among the rows of ``x``: each drawn with a chance in proportion to its squared distance from those before it."""
    rng = np.random.default_rng([seed, k])
    at = [int(rng.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k:
        total = near.sum()
        at.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def cluster_sums(m: DataFrame, centres: list[np.ndarray]) -> list[np.ndarray]:
    """For each set of centres, one row a centre: rows nearest to it, their summed squared distances, their summed values. One
    pass for all; a task emits (all centres) x (features + 2) numbers, summed on the cluster."""
    d = centres[0].shape[1]
    flat = np.concatenate(centres)
    edges = np.cumsum([0] + [len(c) for c in centres])
    bc = m.sparkSession.sparkContext.broadcast((flat, edges))

    def part(batches):
        c, edges = bc.value
        own = (c * c).sum(1)
        sums = np.zeros((len(c), d + 2))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            far = np.maximum((x * x).sum(1)[:, None] + own - 2.0 * (x @ c.T), 0.0)
            near = np.zeros(far.shape)
            line = np.arange(len(x))
            for a, b in zip(edges, edges[1:]):
                near[line, a + far[:, a:b].argmin(1)] = 1.0
            sums[:, 0] += near.sum(0)
            sums[:, 1] += (near * far).sum(0)
            sums[:, 2:] += near.T @ x
        yield pd.DataFrame({"pos": np.arange(sums.size), "v": sums.ravel()})

    rows = m.select(F.col(Z).alias("x")).mapInPandas(part, "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    bc.unpersist()
    table = np.zeros(len(flat) * (d + 2))
    table[rows["pos"].to_numpy()] = rows["v"].to_numpy()
    return np.split(table.reshape(len(flat), d + 2), edges[1:-1])


def fit_together(m: DataFrame, starts: list[np.ndarray], max_iter: int = MAX_ITER) -> list[Fit]:
    """Lloyd's steps from each set of starting centres until it converges; every pass serves all fits that are not done. A
    centre without rows stays where it is."""
    centres, moving, done = [s.copy() for s in starts], list(range(len(starts))), [False] * len(starts)
    for _ in range(max_iter):
        if not moving:
            break
        for i, sums in zip(list(moving), cluster_sums(m, [centres[i] for i in moving])):
            new = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1), centres[i])
            done[i] = bool(((new - centres[i]) ** 2).sum() <= TOL)
            centres[i] = new
            if done[i]:
                moving.remove(i)
    return [Fit(c, float(t[:, 1].sum()), ok) for c, t, ok in zip(centres, cluster_sums(m, centres), done)]


def starting_rows(m: DataFrame, id_col: str, n: int) -> np.ndarray:
    """The bounded sample that starting centres are drawn from."""
    rows = sample_rows(m.select(F.col(id_col).alias("id"), F.col(Z).alias("x")), n)
    return np.stack((rows if len(rows) else m.select(F.col(Z).alias("x")).limit(1).toPandas())["x"].to_numpy())


def best_fit(fits: list[Fit]) -> Fit:
    """The fit of lowest cost (the first of equal ones). A warning tells if it had not converged."""
    best = min(fits, key=lambda f: f.cost)
    if not best.converged:
        warnings.warn(f"k-means with k = {len(best.centres)} stopped before it converged", stacklevel=2)
    return best


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)).argmin(1)


def label_rows(m: DataFrame, centers: np.ndarray, col: str = "cluster", numbering: list[int] | None = None) -> DataFrame:
    """Append the nearest-centre label (vectorised over Arrow batches)."""
    spark = m.sparkSession
    bc = spark.sparkContext.broadcast((centers, numbering))
    schema = T.StructType(m.schema.fields + [T.StructField(col, T.IntegerType())])
    zi = m.columns.index(Z)

    def run(batches):
        c, num = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf.iloc[:, zi].to_numpy())
            lab = assign(x, c)
            pdf[col] = (np.asarray(num)[lab] if num is not None else lab).astype("int32")
            yield pdf

    return m.mapInPandas(run, schema)


def numbering_by_size(m: DataFrame, centers: np.ndarray) -> list[int]:
    """Deterministic numbering: by size descending, then by centre (one small aggregate)."""
    tmp = label_rows(m.select(Z), centers, "__c")
    sizes = {r["__c"]: r["count"] for r in tmp.groupBy("__c").count().collect()}
    order = sorted(range(len(centers)), key=lambda i: (-sizes.get(i, 0), tuple(centers[i])))
    new = [0] * len(centers)
    for rank, old in enumerate(order):
        new[old] = rank
    return new


def lloyd_step(m: DataFrame, centers: np.ndarray) -> DataFrame:
    """One k-means step from given centres: (cluster, position, centre, rows), the means of the rows that
    are nearest to each centre."""
    near = label_rows(m.select(Z), centers, "cluster")
    return (near.select("cluster", F.posexplode(Z).alias("position", "x")).groupBy("cluster", "position")
            .agg(F.avg("x").alias("centre"), F.count(F.lit(1)).alias("rows")))


def kmeans(m: DataFrame, id_col: str, k: int, restarts: int = KMEANS_RESTARTS, seed: int = SEED, max_iter: int = MAX_ITER):
    """M3: (labelled matrix with ``cluster``, the fit of lowest inertia of ``restarts`` seeds)."""
    rows = starting_rows(m, id_col, m.count())
    best = best_fit(fit_together(m, [plus_plus(rows, k, seed + r) for r in range(restarts)], max_iter))
    return label_rows(m, best.centres, numbering=numbering_by_size(m, best.centres)), best


# ------------------------------------------------------------------ silhouette (M7)
def cluster_summaries(labelled: DataFrame, cluster_col: str = "cluster") -> pd.DataFrame:
    """cluster, n, mean (array), square (mean of squared norms) of every cluster: clusters x features numbers."""
    pts = labelled.select(F.col(cluster_col).cast("int").alias("cluster"), F.col(Z).alias("x"))
    square = F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda acc, v: acc + v)
    sizes = pts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(square).alias("square"))
    means = (pts.select("cluster", F.posexplode("x").alias("p", "v")).groupBy("cluster", "p").agg(F.avg("v").alias("v"))
             .groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("mean")))
    return sizes.join(means, "cluster").orderBy("cluster").toPandas()


def linear_scores(x: np.ndarray, own: np.ndarray, n: np.ndarray, square: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Silhouettes of rows from the clusters' sizes, mean squared norms and means."""
    line = np.arange(len(x))
    far = np.maximum((x * x).sum(1)[:, None] + square[None, :] - 2.0 * (x @ mean.T), 0.0)
    far[:, n == 0] = np.inf
    size = n[own]
    a = far[line, own] * size / np.maximum(size - 1, 1)     # its own distance, 0, does not count
    far[line, own] = np.inf
    b = far.min(1)
    top = np.maximum(a, b)
    return np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)


def silhouette(labelled: DataFrame, id_col: str, cluster_col: str = "cluster", per_point: bool = False):
    """M7, linear form: with squared Euclidean distances a point's mean distance to a cluster follows from
    the cluster's n, mean and mean square, so all rows are scored in one pass. Noise (-1) is left
    out; None unless >= 2 clusters and more points than clusters. Singletons score 0."""
    pts = labelled.where(F.col(cluster_col) != -1)
    s = cluster_summaries(pts, cluster_col)
    if len(s) < 2 or s["n"].sum() <= len(s):
        return None
    labels, n = s["cluster"].to_numpy(), s["n"].to_numpy(float)
    mean, square = np.stack(s["mean"].to_numpy()), s["square"].to_numpy()
    bc = labelled.sparkSession.sparkContext.broadcast((labels, n, mean, square))

    def score(batches):
        labels, n, mean, square = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            own = np.searchsorted(labels, pdf["cluster"].to_numpy())
            pdf["silhouette"] = linear_scores(np.stack(pdf["x"].to_numpy()), own, n, square, mean)
            yield pdf[["id", "cluster", "silhouette"]]

    kind = labelled.schema[id_col].dataType.simpleString()
    scored = pts.select(F.col(id_col).alias("id"), F.col(cluster_col).cast("int").alias("cluster"), F.col(Z).alias("x")) \
        .mapInPandas(score, f"id {kind}, cluster int, silhouette double")
    return scored if per_point else float(scored.agg(F.avg("silhouette")).first()[0])


def pairwise_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances |a| x |b| via the Gram form (memory |a||b|, not |a||b|d)."""
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d2, 0.0))


# ------------------------------------------------------------------ choose k (M2)
def sweep_silhouettes(m: DataFrame, centers: list[np.ndarray]) -> list[float | None]:
    """The mean linear silhouette of every model (its centres) over all rows: one pass for all clusters'
    summaries, one for the scores; models x clusters x features numbers reach the driver."""
    x_only = m.select(F.col(Z).alias("x"))
    d = centers[0].shape[1]
    bc = m.sparkSession.sparkContext.broadcast(centers)

    def summaries(batches):
        acc = [np.zeros((len(c), d + 2)) for c in bc.value]
        for pdf in batches:
            if not pdf.empty:
                x = np.stack(pdf["x"].to_numpy())
                wide = np.column_stack([np.ones(len(x)), (x * x).sum(1), x])
                for a, c in zip(acc, bc.value):
                    np.add.at(a, assign(x, c), wide)
        flat = np.concatenate([a.ravel() for a in acc])
        yield pd.DataFrame({"pos": np.arange(len(flat)), "v": flat})

    flat = x_only.mapInPandas(summaries, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas()
    flat = flat.sort_values("pos")["v"].to_numpy()
    tables, at = [], 0
    for c in centers:
        t = flat[at:at + len(c) * (d + 2)].reshape(len(c), d + 2)
        at += len(c) * (d + 2)
        tables.append((t[:, 0], t[:, 1] / np.maximum(t[:, 0], 1), t[:, 2:] / np.maximum(t[:, :1], 1)))
    bt = m.sparkSession.sparkContext.broadcast(tables)

    def scores(batches):
        total = np.zeros(len(bc.value))
        for pdf in batches:
            if not pdf.empty:
                x = np.stack(pdf["x"].to_numpy())
                for i, (c, (n, square, mean)) in enumerate(zip(bc.value, bt.value)):
                    total[i] += linear_scores(x, assign(x, c), n, square, mean).sum()
        yield pd.DataFrame({"pos": np.arange(len(total)), "v": total})

    sums = x_only.mapInPandas(scores, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).toPandas().set_index("pos")["v"]
    out = []
    for i, (n, _, _) in enumerate(tables):
        rows, live = n.sum(), int((n > 0).sum())
        out.append(float(sums[i] / rows) if live >= 2 and rows > live else None)
    return out


class Choice(NamedTuple):
    k: int
    trace: list          # (k, silhouette, converged) of every k tried
    fit: Fit | None      # the best fit of the chosen k


def choose_k(m: DataFrame, id_col: str, n: int | None = None, restarts: int = SWEEP_RESTARTS, final_restarts: int = KMEANS_RESTARTS,
             seed: int = SEED, max_iter: int = MAX_ITER) -> Choice:
    """M2: k = 2..max(3, min(10, floor(sqrt(n)))), the best of ``restarts`` fits of each scored by the linear silhouette over all rows; the
    best strictly greater score wins (lowest k on ties, 2 where none is defined). Its fit is the best of ``final_restarts`` seeds: those
    of every k are fitted in the same passes, so they cost none of their own."""
    n = m.count() if n is None else n
    top = max(3, min(10, int(math.sqrt(n))))
    ks = [k for k in range(2, top + 1) if k <= n]
    if not ks:
        return Choice(2, [], None)
    rows, each = starting_rows(m, id_col, n), max(restarts, final_restarts)
    tried = fit_together(m, [plus_plus(rows, k, seed + r) for k in ks for r in range(each)], max_iter)
    fits = {k: tried[i * each:(i + 1) * each] for i, k in enumerate(ks)}
    best_of = {k: best_fit(fits[k][:restarts]) for k in ks}
    scores = sweep_silhouettes(m, [best_of[k].centres for k in ks])
    best_k, best = 2, -1.0
    for k, score in zip(ks, scores):
        if score is not None and score > best:
            best_k, best = k, score
    return Choice(best_k, [(k, s, best_of[k].converged) for k, s in zip(ks, scores)], best_fit(fits[best_k][:final_restarts]))


# ------------------------------------------------------------------ PCA (M1)
def covariance_times(m: DataFrame, v: np.ndarray, col: str = Z) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, column sums, column sums of squares, X^T X v) in one pass: each task emits d x (l + 2) numbers, summed on the cluster."""
    d, width = v.shape
    bc = m.sparkSession.sparkContext.broadcast(v)

    def part(batches):
        n, sums = 0, np.zeros((d, width + 2))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[col].to_numpy())
                n += len(x)
                sums += np.column_stack([x.sum(0), (x * x).sum(0), x.T @ (x @ bc.value)])
        yield pd.DataFrame({"pos": np.arange(-1, sums.size), "x": np.concatenate([[n], sums.ravel()])})

    rows = m.select(col).mapInPandas(part, "pos long, x double").groupBy("pos").agg(F.sum("x").alias("x")).toPandas()
    rows = rows.sort_values("pos")["x"].to_numpy()
    bc.unpersist()
    sums = rows[1:].reshape(d, width + 2)
    return int(rows[0]), sums[:, 0], sums[:, 1], sums[:, 2:]


def _orthonormal(w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``w`` adds to the orthonormal columns ``q`` (none where it adds nothing)."""
    size = np.sqrt((w * w).sum(0)).max(initial=0.0)
    for _ in range(2):
        w = w - q @ (q.T @ w)
    left, s, _ = np.linalg.svd(w, full_matrices=False)
    left = left[:, s > 1e-11 * max(size, 1e-300)]
    left = left - q @ (q.T @ left)
    return np.linalg.qr(left)[0] if left.shape[1] else left


def principal_axes(m: DataFrame, k: int, col: str = Z, seed: int = SEED, basis: int = BASIS) -> tuple[np.ndarray, np.ndarray]:
    """Top-k eigenvectors (d x k) of the sample covariance and their shares of the variance, by block Lanczos with full
    re-orthogonalisation: a pass for each block, until each component's residual |C u - value u| is at most ``RESIDUAL`` of the largest value
    or the basis spans every direction. A basis of ``basis`` columns starts again from its best vectors. Each component's sign is fixed so that
    its largest-magnitude loading is positive."""
    d = len(m.select(col).first()[0])
    k = min(k, d)
    width = min(d, k + BLOCK_EXTRA)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
    q, cq, total = np.zeros((d, 0)), np.zeros((d, 0)), 0.0
    while True:
        n, sums, squares, product = covariance_times(m, block, col)
        mean = sums / n
        c_block = (product - n * np.outer(mean, mean @ block)) / max(n - 1, 1)
        total = float(((squares - n * mean * mean) / max(n - 1, 1)).sum())
        q, cq = np.column_stack([q, block]), np.column_stack([cq, c_block])
        small = q.T @ cq
        vals, s = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(vals)[::-1]
        vals, u, cu = vals[order], q @ s[:, order], cq @ s[:, order]
        left = np.sqrt(((cu[:, :k] - u[:, :k] * vals[:k]) ** 2).sum(0))
        if q.shape[1] >= d or (left <= RESIDUAL * max(abs(vals[0]), 1e-300)).all():
            break
        if q.shape[1] + width > max(basis, 4 * width):
            q, cq = u[:, :2 * width], cu[:, :2 * width]      # thick restart; C times these is known
        block = _orthonormal(cu[:, :width] - u[:, :width] * vals[:width], q)
        if not block.shape[1]:
            break       # the basis is closed under C: its vectors are exact
    v = u[:, :k].copy()
    for j in range(k):
        i = int(np.argmax(np.abs(v[:, j])))
        if v[i, j] < 0:
            v[:, j] = -v[:, j]
    return v, (vals[:k] / total if total > 0 else vals[:k])


def pca_fit(p: Prepared, m: DataFrame, k: int = 3) -> tuple[np.ndarray, list]:
    """M1 fit: loadings (d x K, K = min(k, d)) and their shares of the variance."""
    v, explained = principal_axes(m, min(k, len(p.names)))
    return v, list(explained)


def pc_columns(p: Prepared, v: np.ndarray) -> list:
    """pc1..pcK as plain column arithmetic over the raw features (codegen, no UDF)."""
    z = z_exprs(p)
    cols = []
    for j in range(v.shape[1]):
        expr = None
        for i, zi in enumerate(z):
            term = zi * F.lit(float(v[i, j]))
            expr = term if expr is None else expr + term
        cols.append(expr.alias(f"pc{j + 1}"))
    return cols


def pca_points(p: Prepared, m: DataFrame | None = None, k: int = 3) -> tuple[DataFrame, np.ndarray, list]:
    """M1: (id, pc1..pcK)."""
    m = matrix(p) if m is None else m
    v, explained = pca_fit(p, m, k)
    return m.select(p.id_col, *pc_columns(p, v)), v, explained
