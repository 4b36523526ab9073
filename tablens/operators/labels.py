"""Cluster descriptions, data part (L1-L5, J5): reply parsing, label merge, feature map,
summary text, quality band. Native expressions and joins; replies parse as VARIANT."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fallbacks and silhouette bands.
DEFAULT_DESCRIPTION = "No description available."
QUALITY_BANDS = ((0.25, "poor"), (0.5, "fair"), (0.75, "good"))
TOP_LINES = 5


def parse_replies(df: DataFrame, raw: str = "raw") -> DataFrame:
    """L3: strip code fences, parse JSON; a reply is valid when it is an object with a text
    ``overview``, a list ``clusters`` and a text ``quality``. Cluster items that are not
    objects or lack id/label/description are dropped. Invalid replies give nulls."""
    text = F.regexp_replace(F.regexp_replace(F.col(raw), r"(?U)^\s+|\s+$", ""), r"^```\w*\n?", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\n?```$", ""), r"(?U)^\s+|\s+$", "")
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    ok = (F.schema_of_variant(v).startswith("OBJECT") & (kind("$.overview") == "STRING")
          & kind("$.clusters").startswith("ARRAY") & (kind("$.quality") == "STRING"))
    items = F.try_variant_get(v, "$.clusters", "array<variant>")
    has = lambda item, key: F.try_variant_get(item, f"$.{key}", "variant").isNotNull()
    kept = F.filter(items, lambda it: F.schema_of_variant(it).startswith("OBJECT") & has(it, "id")
                    & has(it, "label") & has(it, "description"))
    clusters = F.transform(kept, lambda it: F.struct(
        F.try_variant_get(it, "$.id", "long").alias("id"),
        F.try_variant_get(it, "$.label", "string").alias("label"),
        F.try_variant_get(it, "$.description", "string").alias("description")))
    return df.select("*",
                     F.when(ok, F.try_variant_get(v, "$.overview", "string")).alias("overview"),
                     F.when(ok, clusters).alias("clusters"),
                     F.when(ok, F.try_variant_get(v, "$.quality", "string")).alias("quality"))


def merge_labels(profiles: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """One row per profile; missing or empty label -> 'Cluster <id>', missing or empty
    description -> fallback text; labels for unknown ids are ignored; for repeated ids the
    last (by ``order``) wins, and without an ``order`` a repeated id fails the job."""
    lab = labels
    if order is None:
        w = Window.partitionBy("id")
        once = F.when(F.count(F.lit(1)).over(w) > 1, F.raise_error(F.lit("a label id is repeated and no order is given")))
        lab = lab.withColumn("__r", once).where(F.col("__r").isNull()).drop("__r")
    else:
        w = Window.partitionBy("id").orderBy(F.col(order).desc())
        lab = lab.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    lab = lab.select(F.col("id").alias("__id"), F.col("label").alias("__label"),
                     F.col("description").alias("__desc"))
    j = profiles.join(lab, profiles.cluster_id == lab.__id, "left")
    return j.select(
        F.col("cluster_id").alias("id"),
        F.coalesce(F.nullif(F.col("__label"), F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
        .alias("label"),
        F.coalesce(F.nullif(F.col("__desc"), F.lit("")), F.lit(DEFAULT_DESCRIPTION)).alias("description"),
        "size", "percentage")


def feature_map(spark, encoding: list[dict]) -> DataFrame:
    """L1: encoded feature -> original column (a later entry wins for a repeated feature)."""
    rows = {}
    for e in encoding:
        for nc in e["new_columns"]:
            rows[nc] = (nc, e["original_column"], e["encoding_type"])
    return spark.createDataFrame(list(rows.values()), "feature string, original_column string, encoding_type string")


def _num(c: str, decimals: int | None = None) -> Column:
    return F.col(c).cast("string") if decimals is None else F.format_string(f"%.{decimals}f", F.col(c))


def summary_text(sizes: DataFrame, top: DataFrame, fmap: DataFrame | None = None, decimals: int | None = None) -> DataFrame:
    """L2: per cluster a header 'Cluster <id>: <size> samples (<pct>%)' and up to five lines
    '  - <name>: cluster mean=<m>, overall mean=<o>, z=<z> (<above|below> average)'. With ``decimals`` the
    means and z have that many digits (and the percentage one), else their shortest form."""
    t = top
    if fmap is not None:
        t = t.join(F.broadcast(fmap.select("feature", "original_column")), "feature", "left") \
            .withColumn("feature", F.coalesce("original_column", "feature"))
    line = F.concat(F.lit("  - "), F.col("feature"), F.lit(": cluster mean="), _num("cluster_mean", decimals),
                    F.lit(", overall mean="), _num("overall_mean", decimals), F.lit(", z="), _num("z_deviation", decimals),
                    F.lit(" ("), F.when(F.col("z_deviation") > 0, "above").otherwise("below"), F.lit(" average)"))
    lines = t.where(F.col("rank") <= TOP_LINES).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("ls"))   # <= 5 per cluster
    head = F.concat(F.lit("Cluster "), _num("cluster_id"), F.lit(": "), _num("size"), F.lit(" samples ("),
                    _num("percentage", None if decimals is None else 1), F.lit("%)"))
    j = sizes.join(lines, "cluster_id", "left")
    body = F.array_join(F.transform(F.coalesce(F.col("ls"), F.array()), lambda s: s["line"]), "\n")
    return j.select("cluster_id", F.when(F.size(F.coalesce(F.col("ls"), F.array())) > 0,
                                         F.concat(head, F.lit("\n"), body)).otherwise(head).alias("summary"))


def quality_band(score: Column) -> Column:
    """Silhouette -> poor / fair / good / excellent (null stays null)."""
    expr = None
    for bound, name in QUALITY_BANDS:
        expr = F.when(score < bound, name) if expr is None else expr.when(score < bound, name)
    return F.when(score.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise("excellent"))
