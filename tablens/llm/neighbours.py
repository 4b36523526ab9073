"""Operator 3, embedding near-duplicates over navigable small-world graphs per shard.

Vectors of one label (and one length) are dealt by hash to shards of bounded size; each shard gets
a hierarchical navigable small-world graph. Every shard is queried through its graph with all vectors of its own and
of every other shard of the label. An audit in every task sets the width of the beams: it knows the links of a sample of the queries by
brute force, and makes probes, drawn at exactly the threshold's cosine from sampled points of the shard, whose point must be found, so that it can
fail where links are rare as well. The beam widens until both shares are found, in the end to the whole shard. A query whose beam comes
back full of links is widened by itself, so dense groups lose nothing.
Links are verified by cosine in double precision; components are united over all tasks.

Exact copies are one class before indexing and count with their number. A task gives one row per
class with a link (how many vectors it links to there, and one root), never the pairs. The task per
pair of shards holds two shards; querying every shard is work in n^2 / shard_rows by the method.

A row with a null id, label or vector, a null or non-finite component or only zeros links with
nothing (n_links 0, its own component). Rows that repeat an id and vector are copies of each other.
An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import connected_components
from ..session import durable
from . import hnsw

SHARD_ROWS, BEAM, AUDIT, RECALL = 16_384, 48, 256, 0.99
_MARGIN = 1e-5      # float32 scores this near the threshold are decided in double precision


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision (scaled first, so that squares stay finite)."""
    v = raw / np.abs(raw).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _valid(vec):
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda v: v != 0), F.lit(False))


class _Links:
    """Links between the classes of two shards (or within one), gathered without their pairs."""

    def __init__(self, total: int):
        self.root = np.arange(total)
        self.count = np.zeros(total, np.int64)

    def unite(self, point: int, others: np.ndarray) -> None:
        roots = np.unique(self.root[others])
        if len(roots) and (len(roots) > 1 or roots[0] != self.root[point]):
            roots = np.union1d(roots, self.root[[point]])
            self.root[np.isin(self.root, roots[1:])] = roots[0]


def _probes(x: np.ndarray, threshold: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """(points, vectors): sampled points of a shard, and for each a unit vector at the threshold's cosine from it."""
    at = rng.choice(len(x), min(AUDIT, len(x)), replace=False)
    side = rng.normal(size=(len(at), x.shape[1]))
    side -= (side * x[at]).sum(1, keepdims=True) * x[at]
    length = np.sqrt((side * side).sum(1, keepdims=True))
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 1e-6)      # one dimension has no other direction
    return at, (threshold * x[at] + np.sqrt(max(0.0, 1 - threshold * threshold)) * side).astype(np.float32)


def audited_beam(q: np.ndarray, index: dict, threshold: float, same: bool, rng) -> int | None:
    """The narrowest beam (doubling from ``BEAM``) whose searches find ``RECALL`` of the links of sampled queries, known by brute force, and of
    the points that probes were drawn from, up to the size of the shard; None where even that does not."""
    x, levels = index["x"], index["levels"]
    part = rng.choice(len(q), min(AUDIT, len(q)), replace=False)
    sims = q[part] @ x.T                    # bounded: AUDIT rows by one shard
    if same:
        sims[np.arange(len(part)), part] = -np.inf      # finding itself is no link
    r, c = np.nonzero(sims >= threshold + _MARGIN)
    at, probe = _probes(x, threshold, rng)
    beam = min(BEAM, len(x))
    while True:
        ids, found = hnsw.search(x, levels, q[part], beam)
        hits = np.zeros(sims.shape, bool)
        line, col = np.nonzero(ids >= 0)
        hits[line, ids[line, col]] = True
        full = (found >= threshold - _MARGIN).all(axis=1)       # these will be widened by themselves
        links = (hits[r, c] | full[r]).sum() >= RECALL * len(r)
        probed = (hnsw.search(x, levels, probe, beam)[0] == at[:, None]).any(axis=1).sum() >= RECALL * len(at)
        if links and probed:
            return beam
        if beam == len(x):
            return None
        beam = min(beam * 2, len(x))


def _find(q: np.ndarray, index: dict, threshold: float, same: bool, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, found) pairs of beams and a mask of the queries that need the whole shard."""
    x, levels = index["x"], index["levels"]
    whole = np.zeros(len(q), bool)
    beam, again = audited_beam(q, index, threshold, same, rng), np.arange(len(q))
    if beam is None:        # the graph is in parts: every query is compared with the whole shard
        whole[:], again = True, again[:0]
    qs, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(again):
        ids, sims = hnsw.search(x, levels, q[again], beam)
        ok = (ids >= 0) & (sims >= threshold - _MARGIN)
        full = ok.all(axis=1)                   # a beam full of links may hide more
        r, c = np.nonzero(ok & ~full[:, None])
        qs.append(again[r])
        hits.append(ids[r, c])
        again, beam = again[full], beam * 4
        if beam >= len(x):
            whole[again] = True
            break
    return np.concatenate(qs), np.concatenate(hits), whole


def _join(a: dict, b: dict | None, threshold: float, seed: int) -> pd.DataFrame:
    """One row per class with a link: cid, links (vectors linked to in this pair of shards), root."""
    rng = np.random.default_rng(seed)
    same = b is None
    b = a if same else b
    na, nb = len(a["x"]), len(b["x"])
    at_b = 0 if same else na
    out = _Links(na if same else na + nb)
    size = a["n"] if same else np.concatenate([a["n"], b["n"]])
    qa, ha, whole_a = _find(a["x"], b, threshold, same, rng)
    if same:
        whole_b = whole_a
        pa, pb = np.minimum(qa, ha), np.maximum(qa, ha)
    else:
        qb, hb, whole_b = _find(b["x"], a, threshold, same, rng)
        pa, pb = np.concatenate([qa, hb]), np.concatenate([ha, qb])
    # pairs of beams, once each, where neither end is compared with its whole shard below
    ok = ~whole_a[pa] & ~whole_b[pb] & ((pa != pb) if same else True)
    code = np.unique(pa[ok] * nb + pb[ok])
    pa, pb = code // nb, code % nb
    exact = np.concatenate([(a["unit"][pa[i:i + 65536]] * b["unit"][pb[i:i + 65536]]).sum(axis=1) >= threshold
                            for i in range(0, len(pa), 65536)] or [np.zeros(0, bool)])
    pa, pb = pa[exact], pb[exact]
    np.add.at(out.count, pa, size[at_b + pb])
    np.add.at(out.count, at_b + pb, size[pa])
    starts = np.unique(pa, return_index=True)
    for p, others in zip(starts[0], np.split(pb, starts[1][1:])):
        out.unite(p, at_b + others)
    for mine, theirs, off, base, other_whole, own in ((a, b, 0, at_b, whole_b, whole_a), (b, a, at_b, 0, whole_a, whole_b)):
        rows = np.nonzero(own)[0]
        for i in range(0, len(rows), 512):
            part = rows[i:i + 512]
            s = mine["x"][part] @ theirs["x"].T
            hit = s >= threshold + _MARGIN
            r, c = np.nonzero((s >= threshold - _MARGIN) & ~hit)
            hit[r, c] = (mine["unit"][part[r]] * theirs["unit"][c]).sum(axis=1) >= threshold
            if same:
                hit[np.arange(len(part)), part] = False
            out.count[off + part] += hit @ size[base:base + len(theirs["x"])]
            # the other end counts it unless it is compared with its whole shard as well
            out.count[base:base + len(theirs["x"])] += np.where(other_whole, 0, size[off + part] @ hit)
            for p, line in zip(part, hit):
                out.unite(off + p, base + np.nonzero(line)[0])
        if same:
            break
    cid = a["cid"] if same else np.concatenate([a["cid"], b["cid"]])
    linked = out.count > 0
    return pd.DataFrame({"cid": cid[linked], "links": out.count[linked], "root": cid[out.root[linked]]})


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.98, shard_rows: int = SHARD_ROWS, seed: int = 5) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    usable = _valid(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x.cast("double") + 0.0)))     # -0.0 is 0.0
    classes = (rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
               .withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    classes = durable(classes)      # generated ids are stored before use
    counts = (classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards")))
    dealt = classes.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int"))
    kind = vectors.schema[label_col].dataType.simpleString()

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        raw = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        unit = _unit(raw)
        x = unit.astype(np.float32)
        blob = pickle.dumps({"cid": pdf["cid"].to_numpy(), "n": pdf["n"].to_numpy(), "unit": unit,
                             "levels": [(a.astype(np.int32), b.astype(np.int32)) for a, b in hnsw.build(x)]}, 5)
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "shards": [int(pdf["shards"].iloc[0])], "blob": [blob]})

    index = durable(dealt.select("label", "dim", "shard", "shards", "cid", "n", "v").groupBy("label", "dim", "shard").applyInPandas(
        build, f"label {kind}, dim int, shard int, shards int, blob binary"))

    def load(blob: bytes) -> dict:
        d = pickle.loads(blob)      # written above by this job
        return d | {"x": d["unit"].astype(np.float32)}

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        shards = [load(b) for b in pdf.sort_values("shard")["blob"]]
        return _join(shards[0], shards[1] if len(shards) > 1 else None, threshold, seed)

    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    pairs = index.select("*", other.alias("t")).select(
        "label", "dim", F.least("shard", "t").alias("lo"), F.greatest("shard", "t").alias("hi"), "shard", "blob")
    found = durable(pairs.groupBy("label", "dim", "lo", "hi").applyInPandas(meet, "cid long, links long, root long"))

    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found, "cid", "root", "cid", "comp")
    slim = classes.select("cid", "rep", "n", "label", "v").join(linked, "cid", "left").join(comp, "cid", "left")
    slim = slim.withColumn("comp", F.coalesce("comp", "cid"))
    low = slim.groupBy("comp").agg(F.min("rep").alias("component_id"))
    slim = slim.join(low, "comp").select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(slim, ["label", "v"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """Contract of query 3 over all of ``embeddings``: cosine >= 0.98 within equal labels."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id"""
