"""Operator 11, nearest neighbours by inner product as a join of matrix blocks.

Candidates and queries are packed into blocks of bounded size; every (query block, candidate block)
is one task. A block keeps each vector x as int8 q with a scale s, the length e of the rest x - s q and its own
length, so a product of two int8 tiles gives every inner product with a bound on its error:

    |<x, y> - s t <q, r>|  <=  |s q| e_y + e_x |y|

A pair whose upper bound lies under the k-th largest lower bound of its query cannot be among the k
nearest and goes; the pairs that are left are computed again in double precision on the original vectors, term by
term in order. The k best of each tile are merged by heaps, ``FANIN`` tiles at a time. No pair is lost, so the result is exact.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part. Vectors of different
lengths are not compared. A row whose id is the query's is no candidate of it; every other row is, so repeated rows are listed
once each, and a repeated query has its list once each. Equal products rank by id. An inner product that overflows ranks as the
infinity it is, one that is not a number last. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import heapq
import pickle
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .neighbours import _valid

K, FANIN = 20, 16
#: Rows of a block at most on average, and numbers in it (32 MB of doubles).
QUERY_ROWS, ROWS, CELLS = 4096, 8192, 1 << 22
_SLICE, _PAIRS, _EXACT = 256, 1 << 16, 1024      # 1024 products of int8 sum exactly in single precision


def quantise(x: np.ndarray) -> dict:
    """int8 rows of ``x`` with scales, the lengths of what they leave out, and of what they say."""
    top = np.abs(x).max(axis=1, keepdims=True)
    share = x / top
    q = np.rint(share * 127)
    left = share - q / 127
    unit = top[:, 0]
    size = lambda v: unit * np.sqrt((v * v).sum(axis=1))
    return {"q": q.astype(np.int8), "scale": unit / 127, "rest": size(left), "said": size(q / 127), "length": size(share)}


def exact_products(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows x[r] and y[c] in double precision, summed from the first term to the last."""
    xt, yt = np.ascontiguousarray(x.T, np.float64), np.ascontiguousarray(y.T, np.float64)
    out = np.empty(len(r))
    with np.errstate(over="ignore", invalid="ignore"):
        for a in range(0, len(r), _PAIRS):
            i, j = r[a:a + _PAIRS], c[a:a + _PAIRS]
            total = np.zeros(len(i))
            for p, q in zip(xt, yt):
                total += p[i] * q[j]
            out[a:a + _PAIRS] = total
    return out


def tile(q: dict, c: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, id, score) of the k nearest candidates of each query, nearest first, and how many
    pairs were computed again."""
    dim, n, again = q["q"].shape[1], len(c["id"]), 0
    wide = c["q"].astype(np.float32)
    rows, ids, scores = [], [], []
    for a in range(0, len(q["id"]), _SLICE):
        part = slice(a, a + _SLICE)
        own = q["id"][part][:, None] == c["id"][None]
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.zeros(own.shape)
            for j in range(0, dim, _EXACT):
                near += q["q"][part, j:j + _EXACT].astype(np.float32) @ wide[:, j:j + _EXACT].T
            near *= q["scale"][part][:, None]
            near *= c["scale"][None]
            off = q["said"][part][:, None] * c["rest"][None] + q["rest"][part][:, None] * c["length"][None]
            off += 1e-9 * q["length"][part][:, None] * c["length"][None] + 1e-300        # rounding of both sums
            least, most = near - off, near + off
        least[own | np.isnan(least)] = -np.inf
        stay = ~own
        if n > k:
            stay &= ~(most < np.partition(least, n - k, axis=1)[:, n - k][:, None])
        r, at = np.nonzero(stay)
        s = exact_products(q["x"][part], c["x"], r, at)
        again += len(r)
        order = np.lexsort((c["id"][at], -s, r))
        r, at, s = r[order], at[order], s[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(a + r[best])
        ids.append(c["id"][at[best]])
        scores.append(s[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(rows, np.int64), join(ids, np.int64), join(scores, np.float64), again


def _rank(pair):
    score, vec = pair
    return (score != score, 0.0 if score != score else -score, vec)


def merge(lists: list, k: int) -> list:
    """The k best (score, id) of sorted lists, by a heap of their heads."""
    return list(islice(heapq.merge(*lists, key=_rank), k))


def nearest(vectors: DataFrame, query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
            query_rows: int = QUERY_ROWS, rows: int = ROWS, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product for every row where ``query`` holds."""
    narrow = vectors.schema[vec_col].dataType.elementType.simpleString() == "float"
    kind = "float" if narrow else "double"
    data = (vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
            .where(F.col("id").isNotNull() & _valid(F.col("v")))
            .select("id", F.col("v").cast(f"array<{kind}>").alias("v"), F.size("v").alias("dim"), "asks",
                    F.monotonically_increasing_id().alias("row")))
    data = durable(data)        # generated numbers are stored before use
    asks = F.col("asks").cast("bigint")
    n, n_cells, m, m_cells = data.agg(F.count(F.lit(1)), F.sum("dim"), F.sum(asks), F.sum(asks * F.col("dim"))).first()
    spread = lambda count, most, total: max(1, -(-(count or 0) // most), -(-(total or 0) // cells))
    parts, asked = spread(n, rows, n_cells), spread(m, query_rows, m_cells)
    place = lambda count, role: F.pmod(F.xxhash64("row", F.lit(role)), F.lit(count)).cast("int")
    dealt = data.select("dim", F.lit(False).alias("asks"), place(parts, 0).alias("block"), "id", "v").unionByName(
        data.where("asks").select("dim", "asks", place(asked, 1).alias("block"), "id", "v"))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        ids = pdf["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        block = {"id": ids[order], "x": x[order], **quantise(x[order].astype(np.float64))}
        return pd.DataFrame({"dim": [key[0]], "asks": [key[1]], "block": [key[2]], "blob": [pickle.dumps(block, 5)]})

    blocks = durable(dealt.groupBy("dim", "asks", "block").applyInPandas(pack, "dim int, asks boolean, block int, blob binary"))
    across = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    tiles = blocks.where("asks").select("dim", F.col("block").alias("qb"), across(parts).alias("cb"), "asks", "blob").unionByName(
        blocks.where("not asks").select("dim", across(asked).alias("qb"), F.col("block").alias("cb"), "asks", "blob"))

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["dim", "qb", "part", "q", "query_id", "ids", "scores"], dtype=object)
        if len(pdf) < 2:        # no query or no candidate of this length in these blocks
            return empty
        q, c = (pickle.loads(b) for b in pdf.sort_values("asks", ascending=False)["blob"])      # written above by this job
        r, ids, scores, _ = tile(q, c, k)
        if not len(r):
            return empty
        qs, start = np.unique(r, return_index=True)
        return pd.DataFrame({"dim": key[0], "qb": key[1], "part": key[2], "q": qs, "query_id": q["id"][qs],
                             "ids": np.split(ids, start[1:]), "scores": np.split(scores, start[1:])})

    shape = "dim int, qb int, part int, q int, query_id long, ids array<long>, scores array<double>"
    best = tiles.groupBy("dim", "qb", "cb").applyInPandas(meet, shape)

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (q, query_id), lists in pdf.groupby(["q", "query_id"], sort=False):
            best = merge([list(zip(s.tolist(), i.tolist())) for i, s in zip(lists["ids"], lists["scores"])], k)
            out.append((key[0], key[1], key[2], q, query_id, [i for _, i in best], [s for s, _ in best]))
        return pd.DataFrame(out, columns=["dim", "qb", "part", "q", "query_id", "ids", "scores"])

    left = parts
    while left > 1:
        best = best.withColumn("part", F.floor(F.col("part") / FANIN).cast("int")).groupBy("dim", "qb", "part").applyInPandas(fold, shape)
        left = -(-left // FANIN)
    return best.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "near")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("near.ids").alias("vec_id"), F.col("near.scores").alias("score"))


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """Contract of query 11 over all of ``embeddings``: the 20 nearest by inner product of each row whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


SQL_NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS place FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, a.place, b.vec_id, list_inner_product(a.e, b.e) AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20"""
