"""Column profiling: counts, cardinality, classification, missing census, preview.

All statistics come from one aggregation pass plus one distinct-count job over
the string-like columns. Only per-column metadata (one row per column) ever
reaches the driver.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (
    field_types, is_missing, is_nested_type, is_numeric_type, is_time_type,
    parse_text_datetime, text_to_double,
)

# Fixed values of the classifier.
ONE_HOT_MAX = 10          # <= 10 distinct -> one-hot
ID_LIKE_RATIO = 0.9       # distinct / rows > 0.9 -> ID-like
NUMERIC_TEXT_RATIO = 0.8  # > 80% of non-nulls numeric -> numeric-coerce
DATE_TEXT_RATIO = 0.5     # > 50% of non-nulls parse as dates -> datetime
ENCODABLE = ("one-hot", "label", "boolean", "numeric-coerce", "datetime")

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("non_null_count", T.LongType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("cardinality", T.LongType()),
    T.StructField("suggested_encoding", T.StringType()),
    T.StructField("is_id_like", T.BooleanType()),
])


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-missing values per column.

    Exact form: long (column, value) rows, de-duplicated with a partial (map-side)
    aggregate before the shuffle, then counted per column. No Expand node, and a
    hot value is collapsed before it is shuffled. ``approx=True``: one HLL pass.
    """
    if not cols:
        return {}
    types = field_types(df)
    if approx:
        row = df.agg(*[F.approx_count_distinct(F.when(~is_missing(c, types[c]), F.col(c))).alias(c)
                       for c in cols]).first()
        return {c: int(row[c]) for c in cols}
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(~is_missing(c, types[c]), F.col(c).cast("string")).alias("value"))
        for c in cols
    ])
    counts = (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .select("column", "value").distinct()
        .groupBy("column").count()
    )
    out = {c: 0 for c in cols}
    out.update({r["column"]: int(r["count"]) for r in counts.collect()})
    return out


def column_facts(df: DataFrame, approx: bool = False) -> tuple[int, dict[str, dict]]:
    """One pass: row count, non-null counts, numeric-text and date-text counts over all values."""
    types = field_types(df)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c, dt in types.items():
        aggs.append(F.sum(F.when(~is_missing(c, dt), 1).otherwise(0)).cast("long").alias(f"{c}__nn"))
        if isinstance(dt, T.StringType):
            aggs.append(F.count(text_to_double(F.col(c))).alias(f"{c}__num"))
            aggs.append(F.count(parse_text_datetime(F.col(c))).alias(f"{c}__date"))
    row = df.agg(*aggs).first()
    n = int(row["__n"])
    facts = {}
    for c, dt in types.items():
        f = {"dtype": dt, "non_null": int(row[f"{c}__nn"] or 0)}
        if isinstance(dt, T.StringType):
            f["numeric"] = int(row[f"{c}__num"])
            f["dates"] = int(row[f"{c}__date"])
        facts[c] = f
    need_distinct = [c for c, dt in types.items()
                     if not is_numeric_type(dt) and not is_nested_type(dt) and not is_time_type(dt)
                     and not isinstance(dt, T.BooleanType)]
    for c, k in distinct_counts(df, need_distinct, approx).items():
        facts[c]["distinct"] = k
    return n, facts


def classify(n_rows: int, f: dict) -> tuple[int | None, str | None, bool]:
    """Preview classification, first match wins -> (cardinality, suggested_encoding, is_id_like)."""
    dt = f["dtype"]
    nn = f["non_null"]
    if is_numeric_type(dt):
        return None, None, False
    if is_time_type(dt):
        return None, "datetime", False
    if isinstance(dt, T.StringType) and nn > 0 and f["dates"] / nn > DATE_TEXT_RATIO:
        return None, "datetime", False
    if is_nested_type(dt):
        return None, None, False
    if isinstance(dt, T.BooleanType):
        return 2, "boolean", False
    if nn == 0:
        # An all-null column has nothing to encode.
        return 0, None, False
    k = f["distinct"]
    if k <= 1:
        return k, None, False
    if n_rows > 0 and k / n_rows > ID_LIKE_RATIO:
        return k, None, True
    if isinstance(dt, T.StringType) and f["numeric"] / nn > NUMERIC_TEXT_RATIO:
        return k, "numeric-coerce", False
    if k <= ONE_HOT_MAX:
        return k, "one-hot", False
    return k, "label", False


@dataclass
class Preview:
    columns: DataFrame          # one row per column (PROFILE_SCHEMA)
    num_rows: int
    num_columns: int
    numeric_columns: list[str]
    categorical_columns: list[str]


def preview_columns(df: DataFrame, approx: bool = False) -> Preview:
    """Per-column counts, dtype, cardinality, classification, numeric and categorical lists,
    from all values (as the encoder sees them)."""
    n, facts = column_facts(df, approx)
    rows, numeric, categorical = [], [], []
    for pos, (c, f) in enumerate(facts.items()):
        card, enc, idl = classify(n, f)
        rows.append((pos, c, f["dtype"].simpleString(), f["non_null"], n - f["non_null"], card, enc, idl))
        if enc in ENCODABLE and not idl:
            categorical.append(c)
        if is_numeric_type(f["dtype"]) and f["non_null"] > 0:
            numeric.append(c)
    spark = df.sparkSession
    return Preview(spark.createDataFrame(rows, PROFILE_SCHEMA), n, len(facts), numeric, categorical)


def classify_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    return preview_columns(df, approx).columns


def usable_columns(preview: Preview) -> bool:
    """At least two columns can become features."""
    return len(preview.numeric_columns) + len(preview.categorical_columns) >= 2


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) for raw columns with at least one missing cell; one scan."""
    types = field_types(df)
    if not types:
        return df.sparkSession.createDataFrame([], "column string, missing long")
    wide = df.agg(*[F.sum(F.when(is_missing(c, dt), 1).otherwise(0)).cast("long").alias(c)
                    for c, dt in types.items()])
    long = wide.unpivot([], list(types), "column", "missing")
    return long.where(F.col("missing") > 0)


def sample_values(df: DataFrame, order_by: str, n: int = 3) -> DataFrame:
    """First n non-null values per column by ``order_by``.

    The row_number <= n filter lets Spark limit each group before the shuffle
    (WindowGroupLimit), so a column's values are never gathered in one task.
    """
    types = field_types(df)
    cols = [c for c, dt in types.items() if not is_nested_type(dt)]
    long = df.select(order_by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.when(~is_missing(c, types[c]), F.col(c).cast("string")).alias("value"))
        for c in cols]))).where(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(order_by)
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("column", "rank", "value"))


def preview_rows(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """First n rows as text, nulls shown as ''."""
    src = df.orderBy(order_by) if order_by else df
    types = field_types(df)
    return src.limit(n).select(*[
        F.coalesce(F.when(~is_missing(c, dt), F.col(c)).cast("string"), F.lit("")).alias(c)
        for c, dt in types.items()])


def select_existing(df: DataFrame, columns: list[str] | None) -> list[str]:
    """P10: keep listed columns that exist."""
    return [c for c in (columns or []) if c in df.columns]
