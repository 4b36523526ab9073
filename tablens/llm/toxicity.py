"""Operator 8, toxicity by classifier chains.

Words and word beginnings that go with the toxic label are found by counts over all labelled
documents (hashed to buckets, pre-aggregated per task); the ``terms`` most telling ones become features. Three
categories are judged in turn: ``insult`` (toxic, with a telling word), ``pile_on`` (toxic, in
three words or more) and ``toxic`` (the label). Each has a linear model that also gets the probabilities
of the categories before it; while training, those are out-of-fold predictions, with folds by text
so that copies never sit on both sides.

Models are fitted on at most ``fit_rows`` labelled texts (a bounded sample, by hash). Null labels
are not used; several labels of one document all count. Null and empty texts have no words and
get the base rates. Without any toxic label nothing is flagged. Repeated rows get equal results. An
empty table gives no rows. Input columns named p_insult, p_pile_on, p_toxic or toxic are replaced.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

CATEGORIES = ("insult", "pile_on", "toxic")
BUCKETS, TERMS, FIT_ROWS, FOLDS, FLAGGED_FROM = 1 << 20, 256, 20_000, 5, 0.5
EXTRA = 6
#: Labels up to this many (16 bytes each) are broadcast, so that the labelled texts need no shuffle.
BROADCAST_LABELS = 1_000_000
LIFT, LEAST_G2 = 2.0, 12.0      # a term's share over the base rate; its least log-likelihood ratio
_WORD = re.compile(r"[^\W_]+")


def word_buckets(w: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings (4 to 7 characters: inflected and compounded forms of
    one stem share them)."""
    forms = [w + "$", *(w[:n] for n in range(4, 8) if len(w) >= n)]
    return tuple(crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in forms)


class _Terms(dict):
    """Word -> columns of its telling terms, None for the nearly all words that have none. All telling terms make a word count; the
    ``TERMS`` strongest have a column of their own."""

    def __init__(self, terms: np.ndarray):
        super().__init__()
        self.place = {int(b): i for i, b in enumerate(terms)}
        self.width = min(len(terms), TERMS)

    def __missing__(self, w: str) -> tuple[int, ...] | None:
        if len(self) > 200_000:
            self.clear()
        found = [self.place[b] for b in word_buckets(w) if b in self.place]
        hit = self[w] = tuple(i for i in found if i < self.width) if found else None
        return hit


def words_in(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def term_counts(labelled: DataFrame) -> DataFrame:
    """(bucket, toxic, clean, toxic0, clean0): in how many distinct labelled texts each bucket occurs,
    in all and in the first half of the texts (by hash)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(4 * BUCKETS, np.int32)        # one flat array a task, whatever the vocabulary
        for pdf in batches:
            for text, kind in zip(pdf["text"], 2 * pdf["half"] + pdf["toxic"]):
                found = {b for w in set(words_in(text)) for b in word_buckets(w)}
                counts[np.fromiter(found, np.int64, len(found)) * 4 + kind] += 1      # each bucket once a text
        code = np.nonzero(counts)[0]
        yield pd.DataFrame({"bucket": code // 4, "kind": code % 4, "n": counts[code].astype(np.int64)})

    n = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    return (labelled.mapInPandas(run, "bucket long, kind long, n long").groupBy("bucket")
            .agg(n(1, 3).alias("toxic"), n(0, 2).alias("clean"), n(1).alias("toxic0"), n(0).alias("clean0")))


def telling_terms(counts: DataFrame, positive: int, total: int) -> np.ndarray:
    """All buckets tied to the label (log-likelihood ratio) with a raised share in both halves, the strongest first; at most ``BUCKETS``."""
    base = positive / total
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    n = t + c
    g2 = 2 * (part(t, n * base) + part(c, n * (1 - base)) + part(positive - t, (total - n) * base)
              + part(total - positive - c, (total - n) * (1 - base)))
    halves = [(F.col("toxic0"), F.col("clean0")), (t - F.col("toxic0"), c - F.col("clean0"))]
    ok = (t >= LIFT * base * n) & (g2 >= LEAST_G2)
    for th, ch in halves:
        ok = ok & (th >= 2) & (th >= LIFT * base * (th + ch))
    rows = counts.where(ok).select("bucket", g2.alias("g2")).toPandas()
    return rows.sort_values(["g2", "bucket"], ascending=[False, True])["bucket"].to_numpy(np.int64)


def features(text: str | None, known: _Terms) -> np.ndarray:
    """How often each of the strongest telling terms occurs (log), the rate and number of words with any, a constant."""
    x = np.zeros(known.width + EXTRA, np.float32)
    words = words_in(text)
    hits = [h for w in words if (h := known[w]) is not None]
    for h in hits:
        x[list(h)] += 1
    n, m = len(hits), known.width
    x[:m] = np.log1p(x[:m])
    x[m:] = (np.log1p(200 * n / max(1, len(words))), np.log1p(n), n >= 1, n >= 2, n >= 3, 1.0)
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    x = x.astype(np.float64)
    for _ in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (z - y) / len(y) + penalty * w
        h = (x * (z * (1 - z))[:, None]).T @ x / len(y) + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _proba(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64) @ w, -30, 30)))


def fit_chain(x: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category; each sees the earlier categories' out-of-fold probabilities."""
    chain, seen = [], x
    for c in range(targets.shape[1]):
        y = targets[:, c]
        out = np.empty(len(y))
        for f in np.unique(fold):
            held = fold == f
            out[held] = _proba(seen[held], fit_logistic(seen[~held], y[~held])) if (~held).any() else y.mean()
        chain.append(fit_logistic(seen, y))
        seen = np.column_stack([seen, out])
    return chain


def run_chain(x: np.ndarray, chain: list[np.ndarray]) -> np.ndarray:
    seen = x
    for w in chain:
        seen = np.column_stack([seen, _proba(seen, w)])
    return seen[:, x.shape[1]:]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict | None:
    """The chain, or None without both kinds of labels."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    key = F.xxhash64("text", F.lit(1))
    told = labels.where("toxic is not null").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    small = told.count() <= BROADCAST_LABELS     # beyond that, the texts are joined by shuffle
    side = F.broadcast if small else (lambda d: d)
    # one row per distinct text and label: copies would count as independent evidence
    reps = durable(rows.join(side(told), "id").groupBy(key.alias("key"), "toxic").agg(F.min("id").alias("id")))
    labelled = (rows.join(side(reps), "id").where(key == F.col("key"))
                .withColumn("half", F.pmod("key", F.lit(2)).cast("int")).drop("id"))
    n, positive = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not positive or positive == n:
        return None
    terms = telling_terms(term_counts(labelled), positive, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Terms(terms)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "toxic": pdf["toxic"], "x": [features(t, known).tobytes() for t in pdf["text"]]})

    scale = 1 << 20
    cut = min(scale, -(-scale * fit_rows // n))
    # the features of the sample are made where its texts are; only they are brought together
    fit = (labelled.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(scale)) < cut)
           .mapInPandas(run, "key long, toxic int, x binary").limit(2 * fit_rows).toPandas())
    if not len(fit) or fit["toxic"].nunique() < 2:
        return None
    x = np.frombuffer(b"".join(fit["x"]), np.float32).reshape(len(fit), min(len(terms), TERMS) + EXTRA)
    y = fit["toxic"].to_numpy()
    once, thrice = x[:, -4], x[:, -2]
    targets = np.column_stack([y * once, y * thrice, y]).astype(float)
    return {"terms": terms, "chain": fit_chain(x, targets, (fit["key"].to_numpy() // 2) % FOLDS)}


def score_toxicity(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` with p_insult, p_pile_on, p_toxic and toxic (p_toxic >= 0.5)."""
    names = [f"p_{c}" for c in CATEGORIES]

    @F.pandas_udf("array<double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Terms(model["terms"])
        for texts in batches:
            x = np.array([features(t, known) for t in texts], np.float32).reshape(len(texts), known.width + EXTRA)
            yield pd.Series(list(run_chain(x, model["chain"])))

    out = docs.drop(*names, "toxic")
    p = F.array(*[F.lit(0.0)] * len(names)) if model is None else judge(F.col(f"`{text_col}`"))
    out = out.withColumn("__p", p)
    for i, name in enumerate(names):
        out = out.withColumn(name, F.get("__p", F.lit(i)))
    return out.withColumn("toxic", F.col("p_toxic") >= FLAGGED_FROM).drop("__p")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The documents flagged as toxic: doc_id, the three probabilities and toxic (true)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    flagged = score_toxicity(docs, model).where("toxic")
    return flagged.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES], "toxic")
