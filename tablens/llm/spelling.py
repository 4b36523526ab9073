"""Operator 12, spelling variants by finite-state composition.

The vocabulary is dealt by initial states: the trie of all words is cut where a state has at most ``most`` words below it,
and every such state is a partition (``start`` is the letters that lead to it). In a partition the minimised acceptor of its words is
composed with a one-edit transducer and with itself, and the accepted pairs are counted for each word; no
pairs leave the task. Two words that differ by one edit behind their partition's start are in one partition. An edit in a letter of
the path to the cuts parts them, and there the transducer's edit arcs are followed by a join instead: at each
cut state's depth k, words that are equal without letter k, or equal to another word without its letter k, meet under that text. Such
a group holds one word for each letter of the alphabet at most. Each pair is found once, at the first letter in which it differs.

A word's form is its near word of largest count if that is ``factor`` times its own; roots are found by pointer doubling
(counts grow tenfold with every step, so five rounds end it).

Null texts and texts without words give none; a null id is written as nothing in front of the colon. Repeated rows count each. Ties go to the
word that is smallest in code-point order. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .acceptor import Acceptor

#: Words of a partition at most.
MOST = 32_768
#: Hot starts are broadcast up to this many; there are at most (words / MOST) of each length.
BROADCAST_STARTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, one letter left out of every 31st by hash."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-zÀ-ÿ]{%d,}" % least_length), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), runs.alias("run"))
    rows = rows.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    length = F.char_length("run")
    at = (F.col("h") % length).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))).otherwise(F.col("run"))
    return (rows.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def _among(words: DataFrame, starts: DataFrame, few: bool, length: int, how: str) -> DataFrame:
    """Words whose first ``length`` letters are (or are not) among ``starts``."""
    starts = F.broadcast(starts) if few else starts
    return words.join(starts, F.substring("word", 1, length) == F.col("hot"), how)


def cut(words: DataFrame, most: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """(word, n, start) in partitions of at most ``most`` words, and (k, words that pass a cut state of depth k)."""
    if words.count() <= most:
        return words.withColumn("start", F.lit("")), []
    passing, placed, k = words, None, 0
    levels = []
    while True:
        levels.append((k, passing))
        k += 1
        starts = durable(passing.groupBy(F.substring("word", 1, k).alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("hot"))
        hot = starts.count()
        part = _among(passing, starts, hot <= BROADCAST_STARTS, k, "left_anti").withColumn("start", F.substring("word", 1, k))
        placed = part if placed is None else placed.unionByName(part)
        if hot == 0:
            return placed, levels
        # a hot start's own beginnings are hot, so the longest alone decides
        passing = _among(words, starts, hot <= BROADCAST_STARTS, k, "left_semi")


def compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, best_n, best of the words of one partition that have near words in it."""
    pdf = pdf.sort_values("word")       # Python compares strings by code point
    words, n, skip = pdf["word"].tolist(), pdf["n"].to_numpy(), len(pdf["start"].iloc[0])
    by_rank = np.lexsort((np.arange(len(n)), -n))       # of largest count first, then smallest word
    rank = np.empty(len(n), np.int64)
    rank[by_rank] = np.arange(len(n))
    count, best = np.zeros(len(n), np.int64), np.full(len(n), len(n))
    for a, b in Acceptor([w[skip:] for w in words]).near():
        for x, y in ((a, b), (b, a)):
            count += np.bincount(x, minlength=len(n))
            np.minimum.at(best, x, rank[y])
    has = np.nonzero(count)[0]
    top = by_rank[best[has]]
    text = lambda places: pd.Series([words[i] for i in places], dtype=object)
    return pd.DataFrame({"word": text(has), "n_near": count[has], "best_n": n[top], "best": text(top)})


def edits_at(passing: DataFrame, k: int) -> DataFrame:
    """word, n_near, best_n, best: near words whose first difference is letter ``k`` (from 0)."""
    word = F.col("word")
    without = F.concat(F.substring(word, 1, k), F.substring(word, F.lit(k + 2), F.char_length(word)))
    last = F.substring(word, k + 1, 1) != F.substring(word, k + 2, 1)      # of a run of equal letters the last is the one that differs
    cutting = passing.where(F.char_length("word") > k).select(without.alias("key"), "word", "n", last.alias("joins"), F.lit(False).alias("whole"))
    whole = passing.select(word.alias("key"), "word", "n", F.lit(True).alias("joins"), F.lit(True).alias("whole"))
    groups = cutting.unionByName(whole).groupBy("key").agg(F.collect_list(F.struct("word", "n", "joins", "whole")).alias("all"))
    rows = groups.where(F.size("all") > 1).select("all", F.explode("all").alias("me"))
    meets = F.filter("all", lambda x: F.when(F.col("me.whole") | x["whole"], F.col("me.joins") & x["joins"] & (F.col("me.whole") != x["whole"]))
                     .otherwise(x["word"] != F.col("me.word")))
    rows = rows.select(F.col("me.word").alias("word"), meets.alias("near")).where(F.size("near") > 0)
    top = F.array_min(F.transform("near", lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word"))))
    return rows.select("word", F.size("near").cast("bigint").alias("n_near"), (-top["n"]).alias("best_n"), top["word"].alias("best"))


def variants(words: DataFrame, factor: int = 10, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of distinct words."""
    placed, levels = cut(words, most)
    found = placed.groupBy("start").applyInPandas(compose, "word string, n_near long, best_n long, best string")
    for k, passing in levels:
        found = found.unionByName(edits_at(passing, k))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top"))
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                   F.col("top.best").alias("form"), (-F.col("top.n")).alias("form_n"))
    is_form = F.col("form_n") >= factor * F.col("n")
    rows = durable(rows.withColumn("form", F.when(is_form, F.col("form"))).withColumn("form_n", F.when(is_form, F.col("form_n"))))
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(step, "root", "left_semi").isEmpty():
            break
        roots = durable(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Contract of query 12 over all of ``documents``."""
    return variants(durable(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


SQL_SPELLING = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT] || list_transform(range(8), lambda j: 0::UBIGINT),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT w, count(*) AS m, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS b FROM r GROUP BY doc_id, w),
h AS (SELECT w, m, xor(list_reduce([4294967295::UBIGINT] || list_transform(b, lambda x: x::UBIGINT),
    lambda a, x: xor(t[(xor(a, x) & 255::UBIGINT)::BIGINT + 1], a >> 8)), 4294967295::UBIGINT)::BIGINT AS h FROM d, tab),
e AS (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, m FROM h),
v AS (SELECT word, sum(m)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
x AS (SELECT word, n, k, substring(word, 1, k) || substring(word, k + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v)),
i AS (SELECT DISTINCT x.word AS a, v.word AS b FROM x JOIN v ON x.key = v.word),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.key = b.key AND a.k = b.k AND a.word <> b.word
  UNION ALL SELECT a, b FROM i UNION ALL SELECT b, a FROM i),
q AS (SELECT p.a, p.b, v.n, count(*) OVER (PARTITION BY p.a) AS n_near, row_number() OVER (PARTITION BY p.a ORDER BY v.n DESC, p.b) AS r
  FROM p JOIN v ON v.word = p.b),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0)::BIGINT AS n_near, CASE WHEN q.n >= 10 * v.n THEN q.b END AS form,
  CASE WHEN q.n >= 10 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON q.a = v.word AND q.r = 1),
s AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT s.word, s.next, f.form FROM s JOIN f ON f.word = s.next)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL"""
