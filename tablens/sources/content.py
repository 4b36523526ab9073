"""Content and file rules as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Suffixes.
DATA_SUFFIXES = (".csv", ".json", ".parquet", ".xlsx", ".tsv")
UPLOAD_SUFFIXES = (".csv", ".tsv", ".json", ".parquet", ".xlsx", ".xls")
LINK_SUFFIXES = (".csv", ".json", ".xlsx", ".xls", ".parquet", ".zip", ".tsv")
FOLDER_TYPE_ORDER = (".csv", ".json", ".parquet", ".xlsx")
HEAD_BYTES = 500


def content_kind(c: Column) -> Column:
    """R11: 'html', 'xml' or 'data' from the first 500 bytes/characters, trimmed and lower-cased."""
    head = F.lower(F.regexp_replace(F.substring(c.cast("string"), 1, HEAD_BYTES), r"^\s+|\s+$", ""))
    return (F.when(head.startswith("<!doctype html") | head.startswith("<html"), "html")
            .when(head.startswith("<?xml"), "xml").otherwise("data"))


def _suffix_rx(suffixes) -> str:
    return r"(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")$"


def has_suffix(path: Column, suffixes) -> Column:
    return F.lower(path).rlike(_suffix_rx(suffixes))


def direct_link(url: Column) -> Column:
    """The URL's path ends in a data suffix, case-blind; empty or missing -> false."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(F.length(url) > 0, F.lit(False)) & has_suffix(path, LINK_SUFFIXES)


def dataset_key(source: Column, dataset_id: Column) -> Column:
    """R15: '<source>_<id>' with every character outside [A-Za-z0-9_-] turned into '_'."""
    return F.concat(source, F.lit("_"), F.regexp_replace(dataset_id, r"[^a-zA-Z0-9_\-]", "_"))


def file_inventory(spark: SparkSession, path: str, suffixes=UPLOAD_SUFFIXES, max_bytes: int | None = None,
                   recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, ok, reason) for every file; the content column
    is never read (binaryFile prunes it when it is not selected). Spark's file listing may
    already leave out zero-length files; any that appear are rejected as empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path) \
        .select("path", "length", "modificationTime")
    reason = (F.when(~has_suffix(F.col("path"), suffixes), "unsupported type")
              .when(F.col("length") <= 0, "empty file"))
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "too large")
    return files.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def largest_per_folder(files: DataFrame) -> DataFrame:
    """Per folder, the largest file of the first type present (csv, json, parquet, xlsx)."""
    folder = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)
    rank = None
    for i, s in enumerate(FOLDER_TYPE_ORDER):
        cond = F.lower(F.col("path")).endswith(s)
        rank = F.when(cond, i) if rank is None else rank.when(cond, i)
    f = files.withColumn("folder", folder).withColumn("__t", rank).where(F.col("__t").isNotNull())
    w = Window.partitionBy("folder").orderBy("__t", F.col("length").desc(), "path")
    return f.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__t")
