"""Registry of named queries: each is a Spark job over the given tables plus, where the
result can be written as SQL, a DuckDB twin used as its oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import round_half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, decimals: int = 4) -> DataFrame:
    """Round every double column half-up through decimal, the same rule the oracles use."""
    return df.select(*[round_half_up(F.col(f.name), decimals).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def r4(expr: str, d: int = 4) -> str:
    """SQL twin of ``round_half_up``."""
    return f"round(CAST({expr} AS DECIMAL(38,10)), {d})::DOUBLE"
