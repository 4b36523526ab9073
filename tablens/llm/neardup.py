"""Operator 4, MinHash near-duplicates by tensored banding.

Instead of fresh minhashes for each of L tables, two small collections of ``m`` partial keys are
made (each of ``r`` minhashes, so 2 m r in all) and every pair (u_i, v_j) is a table: m * m tables
with keys of 2 r minhashes, for about the square root of the hashing. Two documents of
similarity s meet if some u_i and some v_j agree: (1 - (1 - s^r)^m)^2; with r = 3, m = 10 that is
0.9985 at s = 0.8, 0.99999 at 0.9. Every candidate is confirmed on the full shingle sets.

Documents with equal sets are one class before any table is filled. Of the tables only buckets of several classes are kept, as pairs
of a key and a class. In every bucket a few members are drawn by hash; each class is compared with the one drawn
member of smallest hash it meets anywhere outside its component, for each of ``_DRAWS`` hashes, and components of the confirmed links
follow; ``_TURNS`` turns with other hashes leave a large group of copies in few components for a few comparisons a class. Then all pairs that share a bucket but not a component are compared,
each once. Of these only pairs go on whose set maps (4096 bits, made for the classes that meet another) leave the similarity possible:
two sets differ in at least as many shingles as their maps differ in bits, so this drops no link.
Each candidate pair is thus confirmed, refuted, or already in one component; no pairs within a
component are made, whatever the size of a group of copies.

Nulls, empty texts and texts without words have an empty set and link with nothing. A row with a null
id joins the component of its copies but is never its representative. Rows that share an id count
as one document: their texts' components are united. An empty table gives no rows. Other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import connected_components
from ..session import durable, few_tasks
from .shingles import WordHash, overlap, shingle_set, word_hashes, words_of

GROUPS, ROWS, SEED = 10, 3, 20
#: Ids up to this many are broadcast (8 MB of longs) to pick their texts during the scan; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_CHUNK, _DRAWS, _TURNS = 8192, 4, 3
#: Bits of a set's map, and of its coarse map.
_BITS, _COARSE = 4096, 1024


def _partial_keys(x: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Partial keys (2 m) of one shingle set, from len(a) minhashes."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), _CHUNK):
            np.minimum(low, (np.multiply.outer(a, x[i:i + _CHUNK]) + b[:, None]).min(axis=1), out=low)
        key = np.zeros(len(a) // rows, np.uint64)
        for k in range(rows):
            key = (key ^ low[k::rows]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = 5, groups: int = GROUPS, rows: int = ROWS,
               seed: int = SEED) -> DataFrame:
    """doc_id, set_key (of the shingle set; null if empty), n_shingles, sig (2 * groups partial keys)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        count = 2 * groups * rows
        a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, count, dtype=np.uint64)
        known = WordHash()
        for pdf in batches:
            keys, sizes, sigs = [], [], []
            for text in pdf["text"]:
                s = shingle_set(word_hashes(words_of(text), known), width)
                sizes.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(_partial_keys(s, a, b, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "set_key": keys, "n_shingles": sizes, "sig": sigs})

    ids = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, f"doc_id {ids}, set_key binary, n_shingles long, sig array<long>"))


def _wanted_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the documents in ``wanted``."""
    n = wanted.count()
    few = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(few, "doc_id", "left_semi")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, set) of the documents in ``wanted``, read from their whole texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "set": [
                shingle_set(word_hashes(words_of(t), known), width).tobytes() for t in pdf["text"]]})

    ids = docs.schema[id_col].dataType.simpleString()
    return durable(_wanted_texts(docs, wanted, id_col, text_col).mapInPandas(run, f"doc_id {ids}, set binary").distinct())


def set_maps(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(rep, n, bits, coarse) of the documents in ``wanted``: the sizes of their sets, and their maps: bit h mod ``_BITS``
    (and h mod ``_COARSE``) is set for every shingle hash h. An id on several texts gives a row for each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHash()
        for pdf in batches:
            sizes, maps = [], ([], [])
            for text in pdf["text"]:
                s = shingle_set(word_hashes(words_of(text), known), width)
                sizes.append(len(s))
                for out, bits in zip(maps, (_BITS, _COARSE)):
                    on = np.zeros(bits, np.uint8)
                    on[s % np.uint64(bits)] = 1
                    out.append(np.packbits(on).view(np.int64))
            yield pd.DataFrame({"rep": pdf["doc_id"], "n": sizes, "bits": maps[0], "coarse": maps[1]})

    ids = docs.schema[id_col].dataType.simpleString()
    return _wanted_texts(docs, wanted, id_col, text_col).mapInPandas(run, f"rep {ids}, n long, bits array<long>, coarse array<long>").distinct()


def _possible(percent: int, one: str, two: str):
    """False only for sets that cannot reach the similarity: the intersection is at most the smaller set,
    the union at least the larger; sets differ in at least as many shingles as their maps in bits,
    and a similarity of p % bounds that by (n + n2) (100 - p) / (100 + p). Columns n, coarse and bits with either suffix."""
    n, n2 = F.col("n" + one), F.col("n" + two)
    fits = lambda k: (100 + percent) * _differ(k + one, k + two) <= (100 - percent) * (n + n2)
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & fits("coarse") & fits("bits")


def _differ(bits, bits2):
    """In how many bits two set maps differ."""
    return F.aggregate(F.zip_with(bits, bits2, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, d: acc + d)


def confirm(pairs: DataFrame, facts: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (x, y) whose full sets reach the similarity. ``facts`` (rep, n, bits, coarse)
    refute most of the others before any set is made."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hit = []
            for sx, sy in zip(pdf["sx"], pdf["sy"]):
                a, b = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                n = overlap(a, b)
                hit.append(100 * n >= percent * (len(a) + len(b) - n))
            yield pdf.loc[hit, ["x", "y"]]

    one, two = (facts.select(F.col("rep").alias(c), *[F.col(k).alias(k + c) for k in ("n", "bits", "coarse")]) for c in ("x", "y"))
    n = pairs.count()
    fit = few_tasks(few_tasks(pairs, n).join(one, "x"), n).join(two, "y").where(_possible(percent, "x", "y")).select("x", "y")
    pairs = durable(few_tasks(fit, n).distinct())
    n = pairs.count()
    pairs = few_tasks(pairs, n)
    wanted = few_tasks(pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id"))).distinct(), 2 * n)
    sets = _sets(docs, durable(wanted), id_col, text_col, width)
    ids = docs.schema[id_col].dataType.simpleString()
    both = (pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("set").alias("sx")), "x")
            .join(sets.select(F.col("doc_id").alias("y"), F.col("set").alias("sy")), "y"))
    return durable(both.mapInPandas(run, f"x {ids}, y {ids}").distinct())


def _keys(sig, m: int):
    """The keys of the m * m tables."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.transform(
        F.sequence(F.lit(m), F.lit(2 * m - 1)), lambda j: F.xxhash64(F.get(sig, i), F.get(sig, j), i * m + j))))


def _drawn_pairs(met: DataFrame, turn: int, rows: int) -> DataFrame:
    """Distinct pairs (x, y): each class of the buckets (key, rep, comp) with the drawn member of smallest hash it meets outside its
    component, for each hash of this turn. ``rows``: the rows of ``met``."""
    bucket = Window.partitionBy("key")
    drawn = lambda c: F.struct(F.xxhash64("rep", F.lit(_DRAWS * turn + c)).alias("h"), F.col("rep").alias("c"), "comp")
    draws = [F.min(drawn(c)).over(bucket).alias(f"d{c}") for c in range(_DRAWS)]
    least = [F.min(F.when(F.col(f"d{c}.comp") != F.col("comp"), F.struct(f"d{c}.h", f"d{c}.c"))).alias(f"d{c}") for c in range(_DRAWS)]
    best = few_tasks(met.select("key", "rep", "comp", *draws), rows).groupBy("rep").agg(*least)
    pairs = few_tasks(best, rows).select("rep", F.explode(F.array(*[F.col(f"d{c}.c") for c in range(_DRAWS)])).alias("c")).where("c is not null")
    return few_tasks(pairs.select(F.greatest("rep", "c").alias("x"), F.least("rep", "c").alias("y")).distinct(), rows)


def _mixed(met: DataFrame, comp: DataFrame, rows: int) -> DataFrame:
    """Rows (key, rep, comp, main) of the buckets that hold several components; ``main``: the row is in its bucket's most frequent one.
    ``rows``: the rows of ``met``."""
    bucket = Window.partitionBy("key")
    met = few_tasks(met.select("key", "rep").join(comp, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp")), rows)
    met = met.select("*", F.min("comp").over(bucket).alias("lo"), F.max("comp").over(bucket).alias("hi"), F.mode("comp").over(bucket).alias("most"))
    return durable(few_tasks(met.where("lo <> hi").select("key", "rep", "comp", (F.col("comp") == F.col("most")).alias("main")), rows))


def _rest(mixed: DataFrame, classes: DataFrame, facts: DataFrame, m: int, percent: int, rows: int) -> DataFrame:
    """Pairs (x, y) that share a table's bucket but no component and may reach the similarity. A table is a pair (u_i, v_j), so two classes
    share one if some u_i and some v_j agree: they meet under the first u_i they share (m rows a class, not m * m). ``rows``: the rows of ``mixed``."""
    live = few_tasks(mixed.select("rep", "comp").distinct(), rows).join(classes.select("rep", "sig"), "rep")
    bucket = Window.partitionBy("i", "u")
    met = live.select("rep", "comp", F.posexplode(F.slice("sig", 1, m)).alias("i", "u")).select(
        "*", F.min("comp").over(bucket).alias("lo"), F.max("comp").over(bucket).alias("hi"), F.mode("comp").over(bucket).alias("most"))
    met = durable(met.where("lo <> hi").select("i", "u", "rep", "comp", (F.col("comp") == F.col("most")).alias("main")))
    met = few_tasks(met, met.count())
    full = met.join(classes.select("rep", "sig"), "rep").join(facts, "rep")
    # of two members in different components one at least is outside the bucket's most frequent one
    other = full.select(*[F.col(c).alias(c + "_") for c in full.columns])
    full = full.where(~F.col("main")).drop("main")
    agree = lambda first, count: F.exists(
        F.zip_with(F.slice("sig", first, count), F.slice("sig_", first, count), lambda a, b: a == b), lambda same: same)
    return (full.join(other, (F.col("i") == F.col("i_")) & (F.col("u") == F.col("u_")) & (F.col("main_") | (F.col("rep") < F.col("rep_")))
                      & (F.col("comp") != F.col("comp_")) & ~agree(F.lit(1), F.col("i")) & agree(F.lit(m + 1), F.lit(m)) & _possible(percent, "", "_"))
            .select(F.greatest("rep", "rep_").alias("x"), F.least("rep", "rep_").alias("y")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
                    groups: int = GROUPS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over
    links, itself included), kept (doc_id = component_id), set_key."""
    sig = durable(signatures(docs, id_col, text_col, width, groups, rows, seed))
    classes = (sig.where("set_key is not null and doc_id is not null").groupBy("set_key")
               .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    classes = durable(classes)
    met = classes.select(F.explode(_keys(F.col("sig"), groups)).alias("key"), "rep")
    # A key holds one row per class and table, so even a group with a third of all classes
    # is one part in 3 m^2 of these rows; the window sorts and spills, it gathers nothing.
    met = durable(met.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1").select("key", "rep"))
    rows = met.count()
    met = few_tasks(met, rows)
    meets = durable(few_tasks(met.select(F.col("rep").alias("doc_id")).distinct(), rows))
    facts = durable(set_maps(docs, meets, id_col, text_col, width))
    n = meets.count()
    facts = few_tasks(facts, 10 * n)        # a row is about ten times as long as others
    met, tried, comp = met.withColumn("comp", F.col("rep")), None, None      # at first every class is a component
    for turn in range(_TURNS):
        pairs = _drawn_pairs(met, turn, rows)
        pairs = durable(pairs if tried is None else few_tasks(pairs.join(tried, ["x", "y"], "left_anti"), _DRAWS * n))
        tried = pairs if tried is None else few_tasks(tried.unionByName(pairs), (turn + 1) * _DRAWS * n)
        found = confirm(pairs, facts, docs, id_col, text_col, width, percent)
        found = found if comp is None else found.unionByName(comp.select(F.col("rep").alias("x"), F.col("comp").alias("y")))
        comp = durable(few_tasks(connected_components(found, "x", "y", "rep", "comp"), n))
        met = _mixed(met, comp, rows)
        rows = met.count()
        met = few_tasks(met, rows)
    rest = durable(_rest(met, classes, facts, groups, percent, rows).join(tried, ["x", "y"], "left_anti"))
    # the components so far are stars already; new links join them
    links = confirm(rest, facts, docs, id_col, text_col, width, percent).unionByName(
        comp.select(F.col("rep").alias("x"), F.col("comp").alias("y")))
    # an id that stands on several texts ties their classes
    named = sig.where("set_key is not null and doc_id is not null").select("doc_id", "set_key")
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b")
    ties = named.join(several, "doc_id", "left_semi").join(classes.select("set_key", "rep"), "set_key")
    links = links.unionByName(ties.select(F.col("doc_id").alias("x"), F.col("rep").alias("y")).where("x <> y"))
    comp = durable(few_tasks(connected_components(links, "x", "y", "rep", "comp"), n))

    by_class = (classes.select("set_key", "rep").join(comp, "rep", "left")
                .select("set_key", F.coalesce("comp", "rep").alias("component_id")))
    out = sig.select("doc_id", "set_key", "n_shingles").join(by_class, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept"), "set_key")


def op4_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Contract of query 4 over all of ``documents``: 2-word shingles, similarity 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2).drop("set_key")


SQL_MINHASH = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    ELSE w END)) AS g FROM d),
k AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
t AS (SELECT rep, n, unnest(g) AS t FROM k),
p AS (SELECT a.rep AS x, b.rep AS y FROM t a JOIN t b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, least(x, min(y)) AS low FROM r GROUP BY x)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(low, rep, doc_id) AS component_id, doc_id = coalesce(low, rep, doc_id) AS kept
FROM s LEFT JOIN k ON s.g = k.g LEFT JOIN c ON c.x = k.rep"""
