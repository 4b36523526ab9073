"""Isolation forest (M8), after Liu, Ting & Zhou (2008).

Distributed shape:
1. Sub-samples: tree t takes the psi rows with the smallest ``xxhash64(id, t, seed)``.
   A hash pre-filter keeps ~4*psi candidates per tree (no row is copied 100 times),
   then ``row_number() <= psi`` per tree picks the exact psi smallest. If a tree ever
   got fewer than psi candidates the filter is widened and the step repeated.
2. Training: ``groupBy(tree).applyInPandas`` - one tree per task, psi rows each. The forest is a
   table of nodes (tree, node, feature, threshold, left, right, size, depth): trees x (2 psi - 1) rows at most.
3. Scoring: ``mapInPandas`` over Arrow batches; all trees' nodes lie in flat arrays, and a step moves every (row, tree)
   one level down. (The same as native expressions over constant arrays, a projection per level, took 48 s to plan and ran no faster.)
4. Threshold: the ``contamination`` quantile of the scores, one aggregate.
Random streams differ from scikit-learn's, so values differ; properties hold.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantiles
from .models import Z

TREES = 100
PSI = 256
SEED = 42
OVERSAMPLE = 4.0
POOL = 2.0
EULER = 0.5772156649015329


def c_factor(n):
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0),
                   np.where(n == 2, 1.0, 0.0))
    return out


def _samples(m: DataFrame, id_col: str, n: int, psi: int, trees: int, seed: int) -> DataFrame:
    """Per-tree sub-samples of psi rows. One hash per row first cuts a pool of about
    POOL * trees * psi rows; inside the pool tree t keeps its psi smallest
    ``xxhash64(seed, t, id)``. Each tree's sample is a uniform psi-subset of all rows,
    and two trees share only ~psi^2 / pool rows on average."""
    pool_frac = min(1.0, POOL * trees * psi / max(n, 1))
    widen = False
    while True:
        pool_cut = min(int(pool_frac * 2.0 ** 63), 2 ** 63 - 1)
        pool = m.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(-1), F.col(id_col)), 1) <= F.lit(pool_cut))
        pool_n = max(1, int(round(pool_frac * n)))
        frac = 1.0 if widen else min(1.0, OVERSAMPLE * psi / pool_n)
        cut = min(int(frac * 2.0 ** 63), 2 ** 63 - 1)
        h = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col(id_col)), 1)
        cand = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                                    lambda t: F.struct(t.alias("tree"), h(t).alias("h"))),
                        lambda s: s["h"] <= F.lit(cut))
        picks = pool.select(id_col, F.col(Z).alias("x"), F.explode(cand).alias("c")) \
            .select(F.col("c.tree").alias("tree"), F.col("c.h").alias("h"), id_col, "x")
        w = Window.partitionBy("tree").orderBy("h", id_col)
        chosen = picks.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= psi).drop("rk") \
            .persist(StorageLevel.MEMORY_AND_DISK)          # trees x psi rows: checked, then trained on
        if pool_frac >= 1.0 and frac >= 1.0:
            return chosen                      # every row is a candidate of every tree
        counts = chosen.groupBy("tree").count().collect()
        if len(counts) == trees and min(r["count"] for r in counts) >= psi:
            return chosen
        chosen.unpersist()
        if pool_frac >= 1.0:
            widen = True
        pool_frac = min(1.0, pool_frac * 4)


NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def _build_tree(pdf: pd.DataFrame, seed: int, max_depth: int) -> pd.DataFrame:
    tree = int(pdf.tree.iloc[0])
    rng = np.random.default_rng([seed, tree])
    x = np.stack(pdf.sort_values(["h"]).x.to_numpy())
    nodes = []       # feature, threshold, left, right, size, depth; in creation order
    stack = [(np.arange(len(x)), 0, None, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = [-1, 0.0, -1, -1, len(idx), depth]
        if parent is not None:
            parent[2 + side] = len(nodes)
        nodes.append(me)
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(0), sub.max(0)
        usable = np.where(hi > lo)[0]
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        me[0], me[1] = f, float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < me[1]
        stack.append((idx[~go_left], depth + 1, me, 1))
        stack.append((idx[go_left], depth + 1, me, 0))
    out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "size", "depth"])
    out.insert(0, "node", np.arange(len(out)))
    out.insert(0, "tree", tree)
    return out


def fit_forest(m: DataFrame, id_col: str, n: int, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> tuple[pd.DataFrame, int]:
    """(the nodes of all trees, rows of a sub-sample)."""
    psi = min(psi, n)
    depth = int(math.ceil(math.log2(max(psi, 2))))
    samples = _samples(m, id_col, n, psi, trees, seed)
    nodes = samples.groupBy("tree").applyInPandas(lambda pdf: _build_tree(pdf, seed, depth), NODES).toPandas()   # trees x (2*psi - 1) rows at most
    samples.unpersist()
    return nodes.sort_values(["tree", "node"], ignore_index=True), psi


def flat_forest(nodes: pd.DataFrame) -> tuple:
    """(first node of each tree, feature, threshold, children (left, right), path length at a node, levels) of a table of nodes, the
    trees one after another; a leaf is its own child."""
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    tree = nodes["tree"].to_numpy()
    first = np.nonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))[0]
    base = first[np.cumsum(np.concatenate([[True], tree[1:] != tree[:-1]])) - 1]
    leaf = nodes["feature"].to_numpy() < 0
    own = np.arange(len(nodes))
    child = np.stack([np.where(leaf, own, base + nodes[c].to_numpy()) for c in ("left", "right")], axis=1).ravel()
    return (first, np.where(leaf, 0, nodes["feature"].to_numpy()), nodes["threshold"].to_numpy(float), child,
            nodes["depth"].to_numpy() + c_factor(nodes["size"].to_numpy()), int(nodes["depth"].max()))


def path_lengths(x: np.ndarray, forest: tuple, rows: int = 2048) -> np.ndarray:
    """Mean path length of each row over all trees. A value under its node's threshold goes left; what a leaf
    left unsplit counts with c(size)."""
    first, feature, threshold, child, path, levels = forest
    out = np.empty(len(x))
    for a in range(0, len(x), rows):
        part = x[a:a + rows]
        flat, line = part.ravel(), np.arange(len(part))[:, None] * x.shape[1]
        at = np.broadcast_to(first, (len(part), len(first)))
        for _ in range(levels):
            at = child[2 * at + (flat[line + feature[at]] >= threshold[at])]
        out[a:a + rows] = path[at].mean(1)
    return out


def scores(rows: DataFrame, nodes: pd.DataFrame, psi: int, cols: list[str], x_col: str = Z) -> DataFrame:
    """``cols`` of ``rows`` with ``raw`` = -2^(-mean path / c(psi)) of ``x_col`` (an array of numbers) under a forest of nodes."""
    bc = rows.sparkSession.sparkContext.broadcast(flat_forest(nodes))      # trees x (2 psi - 1) nodes at most
    norm = float(c_factor(psi))
    schema = T.StructType([rows.schema[c] for c in cols] + [T.StructField("raw", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                out = pdf[cols].copy()
                out["raw"] = -np.power(2.0, -path_lengths(np.stack(pdf["__x"].to_numpy()), bc.value) / norm)
                yield out

    return rows.select(*cols, F.col(x_col).alias("__x")).mapInPandas(run, schema)


def detect_anomalies(m: DataFrame, id_col: str, n: int | None = None, contamination: float = 0.05,
                     trees: int = TREES, psi: int = PSI, seed: int = SEED, exact: bool = True,
                     keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., score, anomaly): score is the decision value (negative = more abnormal),
    anomaly = 1 for the lowest ``contamination`` share. ``keep`` columns of ``m`` pass through,
    so callers need no join back on the id."""
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    n = m.count() if n is None else n
    nodes, psi_used = fit_forest(m, id_col, n, trees, psi, seed)
    cols = [id_col] + [c for c in (keep or []) if c != id_col]
    scored = scores(m, nodes, psi_used, cols).persist(StorageLevel.MEMORY_AND_DISK)
    if exact:
        offset = quantiles(scored, ["raw"], [contamination])[("raw", contamination)]
    else:
        offset = scored.agg(F.percentile_approx(F.col("raw"), F.lit(contamination), 10000)).first()[0]
    out = scored.select(*cols, (F.col("raw") - F.lit(offset)).alias("score"))
    return out.withColumn("anomaly", (F.col("score") < 0).cast("int"))
