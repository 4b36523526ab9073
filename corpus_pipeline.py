"""From raw documents to a training mix, in five stages; each one's result is written as Parquet and
read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the
columns of ``docs``. A row is known by its id and its text. Extra columns pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablens.llm import decontam, mixing, neardup, quality, secrets
from tablens.session import durable, scratch_path


def _key() -> Column:
    """A row's identity: its id (nothing where it has none) and its text."""
    return F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))


def _one_row(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: the one with the smallest hash of its values (maps cannot be hashed and stay out)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    told = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return docs.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*told)).alias("row")).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier takes for good."""
    return docs.where(quality.score_column(quality.train(docs, "text")) >= quality.KEPT_FROM)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id,
    one without an id only where the group has no other. Groups are groups of texts, whatever ids they stand under: a row goes
    only for a text that is equal, has an equal shingle set, or is linked to its own, so two unrelated texts under one id both stay, and copies
    without an id go. Texts without words are in no group; repeated rows of an id and text leave one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(text)
    flags = neardup.near_duplicates(docs.select(key.alias("__text"), text.alias("text")), id_col="__text").select(
        F.col("doc_id").alias("__text"), F.when(F.col("set_key").isNotNull(), F.col("component_id")).alias("group")).distinct()
    ids = docs.select("doc_id", key.alias("__text")).distinct().join(flags, "__text")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__text")
    # a text without words is its own group under each id
    stay = durable(ids.where("group is not null").groupBy("group").agg(F.min(first).alias("row")).select("row.doc_id", "row.__text").unionByName(
        ids.where("group is null").select("doc_id", "__text")))
    rows = docs.withColumn("__text", key)
    wanted = stay.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__stays"))
    rows = rows.join(wanted, (F.col("__text") == F.col("__stays")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return _one_row(rows, "doc_id", "__text").drop("__text")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontam.find_leaks(docs.select(_key().alias("key"), "text"), bench, id_col="key")
    return docs.join(leaks.select(F.col("doc_id").alias("__leak")).distinct(), _key() == F.col("__leak"), "left_anti")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked (and n_chars of masked texts brought up to date)."""
    ledger = durable(secrets.scan(docs, "text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("__text"))
    found = secrets.findings(packed, "__text", ledger, ["row", "__text"])
    done = found.select("row", secrets.redact(F.col("__text"), F.col("spans")).alias("masked"), (F.size("spans") > 0).alias("hit"))

    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == "text":
            return F.col("masked").alias(c)
        if c == "n_chars":
            return F.when(F.col("hit"), F.char_length("masked").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return done.select(*[column(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each time a document is taken, with its columns and ``copy`` (1, 2, ...)."""
    plan = (mixing.mix(docs.select(_key().alias("key"), "text", "source"), id_col="key")
            .groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").alias("__copies")).where("__copies > 0"))
    rows = _one_row(docs.drop("copy").withColumn("__key", _key()), "__key")
    return (rows.join(plan, "__key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))))
            .drop("__key", "__copies"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
]

#: The classifier, the MinHash tables and the latent search are not SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
