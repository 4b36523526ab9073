"""Table readers (R1-R9, R4): CSV, TSV, JSON (with flattening), Parquet, row cap,
empty guard. All reads are Spark data sources, so filters and column choices made later
reach the scan."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import parse, records

OVERFLOW = "_overflow"
SUFFIXES = (".csv", ".tsv", ".json", ".parquet")


def _quoted(reader_or_writer, sep: str):
    """Standard quoting: ``""`` inside quotes is one quote."""
    return reader_or_writer.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')


def read_delimited(spark: SparkSession, path: str, sep: str = ",", sampling: float = 1.0) -> DataFrame:
    """Header row, inferred types, quoted fields that may hold separators, doubled quotes
    and line breaks; rows with too many fields are skipped, short rows are padded with
    nulls. The schema gets one extra ``_overflow`` column: a row that fills it had too many
    fields. (Spark's DROPMALFORMED would drop short rows too.) A large file spreads over tasks (``records``); every
    file has its own header, the first file's names count. Files without a record give a table without columns."""
    rows = records(spark, path, sep)
    head = rows.where("head").orderBy("file").select("value").first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    head = spark.createDataFrame([(head["value"].removeprefix("\ufeff"),)], "value string")
    body = rows.where("not head").select("value")
    inferred = parse(_quoted(spark.read, sep).option("inferSchema", True).option("samplingRatio", sampling), head.union(body)).schema
    schema = T.StructType(list(inferred.fields) + [T.StructField(OVERFLOW, T.StringType())])
    df = parse(_quoted(spark.read, sep).option("header", False).option("mode", "PERMISSIVE").schema(schema), body)
    return df.where(F.col(OVERFLOW).isNull()).drop(OVERFLOW)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested objects become ``a.b`` columns (arrays are left as they are)."""
    cols = []

    def walk(prefix: list[str], dt: T.DataType):
        if isinstance(dt, T.StructType) and dt.fields:
            for f in dt.fields:
                walk(prefix + [f.name], f.dataType)
        else:
            cols.append(F.col("`" + "`.`".join(prefix) + "`").alias(sep.join(prefix)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*cols)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """NDJSON (``lines=True``), or JSON documents: a list of records; an object of equally
    long lists or of objects (one column per key); else the first list in document order of
    an object; else the object itself as the single row. Nested objects become ``a.b``."""
    if lines:
        return flatten(spark.read.json(path))
    df = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in df.columns and len(df.columns) == 1:
        raise ValueError("this JSON holds no table: expected records, columns or an object with a list")
    # key order comes from the text (a schema sorts its fields); null for a list at the top
    kinds = [r["k"] for r in spark.read.text(path, wholetext=True).select(F.json_object_keys("value").alias("k")).distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError("the JSON files of one table must have the same layout")
    keys = [k for k in (kinds[0] if kinds and kinds[0] else []) if k in df.columns]
    if not keys:
        return flatten(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    if all(isinstance(types[k], T.ArrayType) and not isinstance(types[k].elementType, T.StructType) for k in keys):
        sizes = df.select(*[F.size(F.col(f"`{k}`")).alias(k) for k in keys]).distinct().limit(2).collect()
        if len(sizes) == 1 and len(set(sizes[0])) == 1:
            zipped = F.arrays_zip(*[F.col(f"`{k}`") for k in keys])
            return flatten(df.select(F.explode(zipped).alias("__r")).select(*[F.col("__r")[k].alias(k) for k in keys]))
    if all(isinstance(types[k], T.StructType) and not any(isinstance(f.dataType, T.StructType) for f in types[k].fields) for k in keys):
        rows = list(dict.fromkeys(f.name for k in keys for f in types[k].fields))     # row labels of all columns
        rows.sort(key=lambda r: (0, int(r), "") if r.isdigit() else (1, 0, r))
        pick = lambda k, r: F.col(f"`{k}`.`{r}`") if r in types[k].fieldNames() else F.lit(None)
        return df.select(F.inline(F.array(*[F.struct(*[pick(k, r).alias(k) for k in keys]) for r in rows])))
    first = next((k for k in keys if isinstance(types[k], T.ArrayType)), None)
    if first is None:
        return flatten(df.select(*[F.col(f"`{k}`") for k in keys]))
    inner = df.select(F.explode(F.col(f"`{first}`")).alias("__r"))
    return flatten(inner.select("__r.*") if isinstance(types[first].elementType, T.StructType) else inner.withColumnRenamed("__r", "0"))


def load_table(spark: SparkSession, path: str, fmt: str | None = None, max_rows: int | None = None,
               order_by: str | None = None) -> DataFrame:
    """Read by suffix (unknown suffix -> CSV); ``max_rows`` caps rows only when given
    (0 allowed: an empty table); ``order_by`` makes the capped head repeatable; a table
    with no rows is an error unless ``max_rows == 0``."""
    kind = (fmt or path.rsplit(".", 1)[-1]).lower().lstrip(".")
    if kind == "tsv":
        df = read_delimited(spark, path, "\t")
    elif kind == "json":
        df = read_json(spark, path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        df = read_delimited(spark, path, ",")
    if order_by:
        df = df.orderBy(order_by)
    if max_rows is not None:
        df = df.limit(max_rows)
    if max_rows != 0 and df.isEmpty():
        raise ValueError(f"no rows could be read from {path}")
    return df
