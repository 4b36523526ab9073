"""Operator 7, mixing sources to target weights by systematic sampling.

Each source has a target number of words; a document's expected copies are its source's target
over the source's words. Within a source the documents stand in a fixed order (size, then id),
the expected copies are summed along it, one seeded offset per source is added, and a document
is taken once for every integer its stretch of the sum crosses. In order of size neighbouring
documents stand in for each other, so the words taken stay within about one document of the target.

Positions come from a range sort plus partition offsets, so a source that holds a third of all
rows is spread over tasks. Null and empty texts have size 0 (they may be taken, with 0 words). A
null source is a source of its own, last in order. Repeated rows are documents of their own.
Sources without words take nothing. Same input, same result. An empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import with_position
from ..session import durable

#: Up to this many sources (one short row each) their targets are broadcast.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size). The wanted total is ``share``
    times all sizes, dealt by weight (repeating in source order, nulls last); a target stops at
    ``most`` times its source's size and the excess is dealt again by weight until none is above."""
    named = sizes.withColumn("__null", F.col("source").isNull())
    at = with_position(named, "__null", "source", name="__at")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    src = durable(at.select("source", "source_size", F.get(cycle, ((F.col("__at") - 1) % len(weights)).cast("int")).alias("w"),
                            (F.lit(most) * F.col("source_size")).alias("cap"), F.col("__null")))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    wanted, level = share * total, None
    while True:     # each round caps at least one more source, or ends; two sums reach the driver
        above = F.lit(False) if level is None else F.lit(level) * F.col("w") > F.col("cap")
        capped, weight = src.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)),
                                 F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        fresh = (wanted - capped) / weight if weight else level
        if fresh == level or fresh is None:
            break
        level = fresh
    level = 0.0 if level is None else level
    return src.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's seeded offset in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1),
        share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies, taken."""
    sized = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                n_words(F.col(text_col)).alias("size")))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goal = targets(per.select("source", "source_size"), weights, share, most)
    goal = goal.join(per.select(F.col("source").alias("s2"), "n_docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    at = with_position(sized.withColumn("__null", F.col("source").isNull()), "__null", "source", "size", "doc_id", name="__at")
    first = at.groupBy("source").agg(F.min("__at").alias("__first"))
    goal = goal.join(first.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    goal = durable(goal.withColumnRenamed("source", "__s"))
    # few sources are broadcast, so that a source with a third of all rows is not dealt to one task;
    # with more the join is by shuffle, where skewed partitions are split
    few = goal.count() <= BROADCAST_SOURCES
    rows = at.join(F.broadcast(goal) if few else goal, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank, u = F.col("__at") - F.col("__first") + 1, offset(F.col("source"), seed)
    copies = (F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)).cast("bigint")
    return (rows.withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """Contract of query 7 over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL_MIX = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(w) OVER (ORDER BY cap / w DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_w FROM s),
v AS (SELECT (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - capped) / open_w AS level, cap / w AS ratio FROM o),
l AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= ratio),
t AS (SELECT source, source_size, least(cap, level * w) AS target,
        ('0x' || substr(md5(concat('7:', coalesce(source, chr(0)))), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM s, l),
k AS (SELECT d.doc_id, d.size, d.source, source_size, target, u,
        CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT AS copies FROM k)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c"""
