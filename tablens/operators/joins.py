"""Table joins (J1, J2): a left-deep chain of single-key equi joins.

Null keys match each other only on request. Strategy is left to Catalyst/AQE: broadcast
when the size estimate is under ``spark.sql.autoBroadcastJoinThreshold``,
otherwise sort-merge with AQE skew splitting of hot keys.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "cross": "cross"}


def shared_columns(tables: list[tuple[str, DataFrame]]) -> list[dict]:
    """Shared column names of each consecutive pair, sorted."""
    out = []
    for (ln, ldf), (rn, rdf) in zip(tables, tables[1:]):
        out.append({"left": ln, "right": rn, "shared_columns": sorted(set(ldf.columns) & set(rdf.columns))})
    return out


def _key_error(key, name, left: DataFrame, right: DataFrame, why: str) -> ValueError:
    some = lambda df: ", ".join(df.columns[:20])
    return ValueError(f"no join with '{name}' on '{key}': {why} (left has {some(left)}; '{name}' has {some(right)})")


def join_two(left: DataFrame, right: DataFrame, key: str, how: str = "inner", right_name: str = "right",
             match_nulls: bool = False) -> DataFrame:
    """One step: left columns keep their names (key in its left position), clashing right
    columns get ``_<right_name>``, the key is the left key, or the first non-null key for
    right/outer joins. Null keys match nothing; with ``match_nulls`` they match each other (every
    null row with every null row, so ask for it only where nulls are few)."""
    if how not in HOWS:
        raise ValueError(f"unknown join type '{how}'")
    if how == "cross":
        raise _key_error(key, right_name, left, right, "a cross join has no key")
    if key not in left.columns:
        raise _key_error(key, right_name, left, right, "the left table lacks it")
    if key not in right.columns:
        raise _key_error(key, right_name, left, right, "the right table lacks it")
    clash = (set(left.columns) & set(right.columns)) - {key}
    one = left.select(*[F.col(c).alias(f"__l_{c}") for c in left.columns])
    two = right.select(*[F.col(c).alias(f"__r_{c}") for c in right.columns])
    a, b = F.col(f"__l_{key}"), F.col(f"__r_{key}")
    j = one.join(two, a.eqNullSafe(b) if match_nulls else a == b, HOWS[how])
    key_expr = F.col(f"__l_{key}") if HOWS[how] in ("inner", "left") else \
        F.coalesce(F.col(f"__l_{key}"), F.col(f"__r_{key}"))
    cols = [(key_expr if c == key else F.col(f"__l_{c}")).alias(c) for c in left.columns]
    cols += [F.col(f"__r_{c}").alias(f"{c}_{right_name}" if c in clash else c) for c in right.columns if c != key]
    return j.select(*cols)


def join_tables(first: tuple[str, DataFrame], steps: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``first=(name, df)``, ``steps=[(name, df, key, how), ...]`` joined left to right, uncapped."""
    result = first[1]
    for name, df, key, how in steps:
        result = join_two(result, df, key, how, name)
    return result
