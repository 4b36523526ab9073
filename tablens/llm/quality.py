"""Operator 5, quality classifier from weak labels.

Heuristic labellers look at whole texts and vote good, bad or nothing. Their votes over all
documents are counted by pattern (a few hundred at most, whatever the corpus holds) and
expectation-maximisation estimates every labeller's accuracy and the share of good documents from
the overlaps, without any given label. The posterior labels then train a linear scorer over hashed
word shapes, on a bounded sample (``fit_rows``); the scorer judges every document.

Null and empty texts have no words: all labellers abstain, so they get the prior's score. Repeated
rows get equal scores. An empty table gives no rows. ``score_documents`` keeps all columns of its
input and replaces ones named score or kept.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labellers in order; each votes 0 (bad), 1 (good) or 2 (nothing).
LABELLERS = ("symbols", "loose_marks", "shouting", "capitals", "stutter", "twin_lines", "sentences", "plain_words")
FIT_ROWS, DIM, KEPT_FROM = 8_000, 1024, 0.5


_CLASS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_TAILS, _BOUND = frozenset(b"#$%&*~^=_|<>"), 500_000


def shape(word: bytes) -> bytes:
    """Character classes of a word, runs collapsed: b"Wher,!!" -> b"Aa,!"."""
    return _RUN.sub(rb"\1", word.translate(_CLASS))


class _Words(dict):
    """Word -> row of ``facts``: the word's bucket, capitals, letters, and whether it has a tail of
    equal marks, is all marks, or is shouted."""

    def __init__(self):
        super().__init__()
        self.facts = np.zeros((4096, 6), np.int64)

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        if n == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        kinds = w.translate(_CLASS)
        upper, lower = kinds.count(b"A"), kinds.count(b"a")
        tail = len(w) > 2 and w[-1] == w[-2] and w[-1] in _TAILS
        self.facts[n] = (crc32(_RUN.sub(rb"\1", kinds)) % (DIM - 4), upper, upper + lower, tail,
                         upper + lower + kinds.count(b"0") == 0, len(w) > 1 and w[-1] == 33)
        return n


def describe(text: str | None, known: _Words) -> tuple[list[int], np.ndarray | None]:
    """Votes of all labellers and the feature vector (None without words)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [2] * len(LABELLERS), None
    if len(known) > _BOUND:
        known.clear()
    ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
    facts = known.facts[ids]
    share = facts[:, 1:].sum(axis=0)
    stutter = float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0
    lines = [x for x in map(bytes.strip, raw.split(b"\n")) if x]
    twins = 1 - len(set(lines)) / len(lines)
    ends = sum(x[-1] in b".?!:" and x[-2:] != b"!!" for x in lines) / len(lines)
    letters, caps = int(share[1]), share[0] / max(1, share[1])
    tails, loose, shouts = share[2] / n, share[3] / n, share[4] / n
    plain = 1 - tails - loose - shouts
    votes = [0 if tails > .1 else 2 if tails > .02 else 1,
             0 if loose > .1 else 2,
             0 if shouts > .2 else 2,
             (0 if caps > .5 else 1 if caps < .3 else 2) if letters >= 20 else 2,
             (0 if stutter > .3 else 1 if stutter < .08 else 2) if n >= 8 else 2,
             0 if twins > .5 and len(lines) >= 4 else 2,
             (1 if ends > .6 else 2) if n >= 8 else 2,
             (1 if plain > .95 and caps < .3 and stutter < .08 else 0 if plain < .7 else 2)]
    x = np.bincount(facts[:, 0], minlength=DIM) / n
    x[DIM - 4:] = (stutter, twins, caps, 1.0)
    return votes, np.sqrt(x).astype(np.float32)


def vote_patterns(docs: DataFrame, text_col: str) -> pd.DataFrame:
    """Counts of vote patterns over all documents: at most 3 ** labellers rows, whatever the input."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for pdf in batches:
            yield pd.Series([sum(v * 3 ** i for i, v in enumerate(describe(t, known)[0])) for t in pdf["text"]],
                            dtype="int64").value_counts().rename_axis("pattern").reset_index(name="n")

    return (docs.select(F.col(text_col).alias("text")).mapInPandas(run, "pattern long, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")).toPandas())


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of 0/1/2): the chance of each vote given bad or good
    (2, labellers, 3), and the prior of (bad, good). Starts from labellers that are mostly right."""
    m = votes.shape[1]
    one_hot = np.eye(3)[votes]                      # patterns, labellers, 3
    p = np.empty((2, m, 3))
    p[0], p[1] = (.5, .1, .4), (.05, .55, .4)
    prior = np.array([.3, .7])
    for _ in range(rounds):
        post = posterior(votes, p, prior)
        weight = post * counts[:, None]
        fresh = np.einsum("pc,pmv->cmv", weight, one_hot) + 0.1
        fresh /= fresh.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=0) + 1) / (counts.sum() + 2)
        moved = np.abs(fresh - p).max()
        p = fresh
        if moved < 1e-9:
            break
    return p, prior


def posterior(votes: np.ndarray, p: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """(bad, good) for each row of votes."""
    log = np.log(prior)[None, :] + sum(np.log(p[:, i, votes[:, i]]).T for i in range(votes.shape[1]))
    e = np.exp(log - log.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by accelerated full-batch gradient steps; ``x`` and ``y`` are
    float32, and no copy of ``x`` is made."""
    n = np.float32(len(y))
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(4.0 / max(1e-9, float(np.einsum("ij,ij->i", x, x).max())))
    for k in range(1, rounds + 1):
        z = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - step * ((z - y) @ x / n + np.float32(penalty) * v)
        v = new + np.float32((k - 1) / (k + 2)) * (new - w)
        w = new
    return w.astype(np.float64)


def train(docs: DataFrame, text_col: str, fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> dict:
    """EM over all documents, then the scorer on about ``fit_rows`` of them (2 * fit_rows at most), picked by
    a hash of text and id (where there is one)."""
    seen = vote_patterns(docs, text_col)
    total = int(seen["n"].sum()) if len(seen) else 0
    m = len(LABELLERS)
    if not total:
        return {"weights": np.zeros(DIM), "prior": np.array([.5, .5]), "chances": None}
    votes = np.array([[int(c) // 3 ** i % 3 for i in range(m)] for c in seen["pattern"]])
    chances, prior = estimate(votes, seen["n"].to_numpy(float))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for pdf in batches:
            rows = [describe(t, known) for t in pdf["text"]]
            rows = [(v, x) for v, x in rows if x is not None]
            if rows:
                yield pd.DataFrame({"good": posterior(np.array([v for v, _ in rows]), chances, prior)[:, 1],
                                    "x": [x.astype(np.float16).tobytes() for _, x in rows]})

    scale = 1 << 20
    cut = min(scale, -(-scale * fit_rows // total))
    part = docs.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (text_col, id_col) if c in docs.columns]), F.lit(scale)) < cut)
    good, rows = [], bytearray()        # filled row by row: one copy of the sample on the driver
    # the features of the sample are made where its texts are; only they are brought together
    for r in part.select(F.col(text_col).alias("text")).mapInPandas(run, "good double, x binary").limit(2 * fit_rows).toLocalIterator():
        good.append(r["good"])
        rows += r["x"]
    if not good:
        return {"weights": np.zeros(DIM), "prior": prior, "chances": chances}
    x = np.frombuffer(rows, np.float16).reshape(len(good), DIM).astype(np.float32)
    return {"weights": fit_linear(x, np.array(good, np.float32)), "prior": prior, "chances": chances}


def score_column(model: dict, text_col: str = "text") -> Column:
    """The chance that a row's text is good."""
    weights, base = model["weights"], float(model["prior"][1])

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Words()
        for texts in batches:
            found = (describe(t, known)[1] for t in texts)
            yield pd.Series([base if x is None else 1 / (1 + np.exp(-np.clip(float(x @ weights), -30, 30))) for x in found],
                            dtype="float64")

    return score(F.col(f"`{text_col}`"))


def score_documents(docs: DataFrame, text_col: str = "text", model: dict | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with score (chance of good quality) and kept (score >= 0.5)."""
    model = model or train(docs, text_col, fit_rows)
    out = docs.drop("score", "kept").withColumn("score", score_column(model, text_col))
    return out.withColumn("kept", F.col("score") >= KEPT_FROM)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The documents that stay: doc_id, score, kept (true)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs).where("kept").select("doc_id", F.round("score", 6).alias("score"), "kept")
