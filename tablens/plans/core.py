"""Registered queries for profiling, preparation, statistics, joins and cluster profiles.

The supplied tables have no nulls, so some queries derive columns with nulls by a
fixed rule over the key (every row is kept; only values are blanked). The same rule
is written in the SQL twin.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import DATE_FORMATS
from ..operators import joins, prep, profile, profiles, stats
from ..session import table
from .registry import query, r4, rounded

# DuckDB spellings of the text date formats, in the same order.
SQL_DATE_FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S",
                    "%Y/%m/%d", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y", "%d.%m.%Y")
assert len(SQL_DATE_FORMATS) == len(DATE_FORMATS)


# ---------------------------------------------------------------- profile
def _profile_sql(tbl: str, cols: list[tuple[str, str]], key: str) -> str:
    fmts = "[" + ", ".join(f"'{f}'" for f in SQL_DATE_FORMATS) + "]"
    parts = []
    for pos, (c, dtype) in enumerate(cols):
        head = f"SELECT {pos} AS position, '{c}' AS \"column\", '{dtype}' AS dtype, " \
               f"count({c}) AS non_null_count, count(*) - count({c}) AS null_count"
        if dtype == "string":
            nn, k = f"count({c})", f"count(DISTINCT {c})"
            date_like = f"(count({c}) > 0 AND count(try_strptime({c}, {fmts})) / count({c}) > 0.5)"
            card = f"CASE WHEN {date_like} THEN NULL ELSE {k} END AS cardinality"
            enc = (f"CASE WHEN {date_like} THEN 'datetime' WHEN {nn} = 0 OR {k} <= 1 THEN NULL "
                   f"WHEN {k} / count(*) > 0.9 THEN NULL "
                   f"WHEN count(TRY_CAST({c} AS DOUBLE)) / {nn} > 0.8 THEN 'numeric-coerce' "
                   f"WHEN {k} <= 10 THEN 'one-hot' ELSE 'label' END AS suggested_encoding")
            idl = f"(NOT {date_like} AND {nn} > 0 AND {k} > 1 AND {k} / count(*) > 0.9) AS is_id_like"
            parts.append(f"{head}, {card}, {enc}, {idl} FROM {tbl}")
        elif dtype.startswith("timestamp") or dtype == "date":
            parts.append(f"{head}, NULL::BIGINT AS cardinality, 'datetime' AS suggested_encoding, false AS is_id_like FROM {tbl}")
        else:
            parts.append(f"{head}, NULL::BIGINT AS cardinality, NULL AS suggested_encoding, false AS is_id_like FROM {tbl}")
    return "\nUNION ALL\n".join(parts)


PART_COLS = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")]
CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")]
ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("column_profile_part", _profile_sql("part", PART_COLS, "p_partkey"))
def column_profile_part(spark, sf):
    return profile.classify_columns(table(spark, sf, "part"))


@query("column_profile_customer", _profile_sql("customer", CUSTOMER_COLS, "c_custkey"))
def column_profile_customer(spark, sf):
    return profile.classify_columns(table(spark, sf, "customer"))


@query("column_profile_orders", _profile_sql("orders", ORDERS_COLS, "o_orderkey"))
def column_profile_orders(spark, sf):
    return profile.classify_columns(table(spark, sf, "orders"))


# ---------------------------------------------------------------- lineitem with blanked values
def lineitem_gaps(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        (k * 8 + F.col("l_linenumber")).alias("id"),
        F.when((k % 97 == 0) | (k % 7 == 0), None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 97 == 0, None).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when((k % 97 == 0) | (k % 5 == 0), None).otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(k % 20 == 0, F.col("l_tax")).alias("l_tax"),
        F.when(k % 3 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus")


LINEITEM_GAPS_SQL = """
SELECT l_orderkey * 8 + l_linenumber AS id,
  CASE WHEN l_orderkey % 97 = 0 OR l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_orderkey % 97 = 0 OR l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 20 = 0 THEN l_tax END AS l_tax,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus
FROM lineitem"""


@query("missing_values", f"""
WITH v AS ({LINEITEM_GAPS_SQL}),
w AS (SELECT count(*) - count(id) AS id, count(*) - count(l_quantity) AS l_quantity,
  count(*) - count(l_extendedprice) AS l_extendedprice, count(*) - count(l_discount) AS l_discount,
  count(*) - count(l_tax) AS l_tax, count(*) - count(l_returnflag) AS l_returnflag,
  count(*) - count(l_linestatus) AS l_linestatus FROM v)
SELECT "column", missing FROM (UNPIVOT w ON COLUMNS(*) INTO NAME "column" VALUE missing) WHERE missing > 0""")
def missing_values(spark, sf):
    return profile.missing_values(lineitem_gaps(spark, sf))


@query("median_impute", f"""
WITH v AS ({LINEITEM_GAPS_SQL}),
kept AS (SELECT * FROM v WHERE l_quantity IS NOT NULL OR l_extendedprice IS NOT NULL OR l_discount IS NOT NULL),
m AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_extendedprice, 0.5) AS me,
             quantile_cont(l_discount, 0.5) AS md FROM kept)
SELECT id, {r4('coalesce(l_quantity, mq)')} AS l_quantity, {r4('coalesce(l_extendedprice, me)')} AS l_extendedprice,
       {r4('coalesce(l_discount, md)')} AS l_discount
FROM kept, m""")
def median_impute(spark, sf):
    p = prep.prepare_features(lineitem_gaps(spark, sf), "id",
                              numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(p.features)


@query("feature_report", f"""
WITH v AS ({LINEITEM_GAPS_SQL})
SELECT 'l_tax' AS "column", 'Over 90% missing values' AS reason FROM (SELECT count(l_tax) AS c, count(*) AS n FROM v) WHERE c < 0.1 * n
UNION ALL SELECT 'l_linestatus', 'Single value' FROM (SELECT count(DISTINCT l_linestatus) k FROM v WHERE
  l_quantity IS NOT NULL OR l_extendedprice IS NOT NULL OR l_discount IS NOT NULL) WHERE k <= 1""")
def feature_report(spark, sf):
    """E2/E6 report: which columns were dropped and why (categorical returnflag kept, one-hot)."""
    p = prep.prepare_features(lineitem_gaps(spark, sf), "id",
                              numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                              categorical=["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(d["column"], d["reason"]) for d in p.dropped], "column string, reason string")


# ---------------------------------------------------------------- encodings
def orders_mixed(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), "o_totalprice", F.lit(1.0).alias("const"),
        (F.col("o_orderstatus") == "F").alias("is_finished"), "o_orderdate",
        F.concat(F.lit("g"), (F.col("o_custkey") % 50).cast("string")).alias("cust_group"),
        F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        "o_orderstatus")


ORDERS_MIXED_SQL = """
SELECT o_orderkey AS id, o_totalprice, 1.0::DOUBLE AS const, o_orderstatus = 'F' AS is_finished, o_orderdate,
  'g' || CAST(o_custkey % 50 AS VARCHAR) AS cust_group,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderstatus
FROM orders"""


@query("encode_orders", f"""
WITH v AS ({ORDERS_MIXED_SQL}),
codes AS (SELECT value, (row_number() OVER (ORDER BY value) - 1)::DOUBLE AS code
          FROM (SELECT DISTINCT coalesce(cust_group, 'MISSING') AS value FROM v))
SELECT id, {r4('o_totalprice')} AS o_totalprice, coalesce(CAST(is_finished AS INT), 0)::DOUBLE AS is_finished,
  month(o_orderdate)::DOUBLE AS o_orderdate_month, (isodow(o_orderdate) - 1)::DOUBLE AS o_orderdate_day_of_week,
  codes.code AS cust_group,
  CASE WHEN coalesce(o_orderpriority, 'MISSING') = '2-HIGH' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_2-HIGH",
  CASE WHEN coalesce(o_orderpriority, 'MISSING') = '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_3-MEDIUM",
  CASE WHEN coalesce(o_orderpriority, 'MISSING') = '4-NOT SPECIFIED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_4-NOT SPECIFIED",
  CASE WHEN coalesce(o_orderpriority, 'MISSING') = '5-LOW' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_5-LOW",
  CASE WHEN coalesce(o_orderpriority, 'MISSING') = 'MISSING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "o_orderpriority_MISSING",
  CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_O,
  CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o_orderstatus_P
FROM v LEFT JOIN codes ON coalesce(v.cust_group, 'MISSING') = codes.value""")
def encode_orders(spark, sf):
    """E8 boolean, E9 datetime without hours, E11 MISSING, E12 label, E13 one-hot, E15 zero variance."""
    p = prep.prepare_features(orders_mixed(spark, sf), "id", numeric=["o_totalprice", "const"],
                              categorical=["is_finished", "o_orderdate", "cust_group", "o_orderpriority",
                                           "o_orderstatus"])
    return rounded(p.features)


def events_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.date_trunc("hour", F.col("ts")).alias("hour_ts"),
        F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value_text"),
        "event_type")


@query("encode_events", f"""
WITH v AS (SELECT event_id, date_trunc('hour', ts) AS hour_ts,
  CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_text, event_type FROM events),
m AS (SELECT quantile_cont(TRY_CAST(value_text AS DOUBLE), 0.5) AS med FROM v)
SELECT event_id, (isodow(hour_ts) - 1)::DOUBLE AS hour_ts_day_of_week,
  hour(hour_ts)::DOUBLE AS hour_ts_hour, {r4('coalesce(TRY_CAST(value_text AS DOUBLE), med)')} AS value_text,
  CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_type_error,
  CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_type_purchase,
  CASE WHEN event_type = 'signup' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_type_signup,
  CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_type_view
FROM v, m""")
def encode_events(spark, sf):
    """E9 datetime with hours, E10 numeric text, E13 one-hot; ``numeric=[]`` path."""
    p = prep.prepare_features(events_text(spark, sf), "event_id", numeric=[],
                              categorical=["hour_ts", "value_text", "event_type"])
    return rounded(p.features)


@query("label_encode", """
SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS code FROM part""")
def label_encode(spark, sf):
    part = table(spark, sf, "part")
    codes = prep.dense_codes(part.select(F.col("p_brand").alias("value")), "value")
    # no broadcast hint: AQE picks a broadcast join from the runtime size of the code table
    return part.join(codes, part.p_brand == codes.value).select("p_partkey", "p_brand", "code")


@query("one_hot", """
SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_BUILDING,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_FURNITURE,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_HOUSEHOLD,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_MACHINERY
FROM customer""")
def one_hot(spark, sf):
    c = table(spark, sf, "customer")
    return prep.encode_categoricals(c, "c_custkey", ["c_mktsegment"]).frame("c_custkey")


@query("standardize", f"""
WITH v AS (SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS c_nationkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_BUILDING,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_FURNITURE,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_HOUSEHOLD,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_mktsegment_MACHINERY FROM customer)
SELECT c_custkey,
  {r4('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()')} AS c_acctbal,
  {r4('(c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER ()')} AS c_nationkey,
  {r4('(c_mktsegment_BUILDING - avg(c_mktsegment_BUILDING) OVER ()) / stddev_pop(c_mktsegment_BUILDING) OVER ()')} AS c_mktsegment_BUILDING,
  {r4('(c_mktsegment_FURNITURE - avg(c_mktsegment_FURNITURE) OVER ()) / stddev_pop(c_mktsegment_FURNITURE) OVER ()')} AS c_mktsegment_FURNITURE,
  {r4('(c_mktsegment_HOUSEHOLD - avg(c_mktsegment_HOUSEHOLD) OVER ()) / stddev_pop(c_mktsegment_HOUSEHOLD) OVER ()')} AS c_mktsegment_HOUSEHOLD,
  {r4('(c_mktsegment_MACHINERY - avg(c_mktsegment_MACHINERY) OVER ()) / stddev_pop(c_mktsegment_MACHINERY) OVER ()')} AS c_mktsegment_MACHINERY
FROM v""")
def standardize(spark, sf):
    p = prep.prepare_features(table(spark, sf, "customer"), "c_custkey", numeric=["c_acctbal", "c_nationkey"],
                              categorical=["c_name", "c_mktsegment"])
    return rounded(p.scaled)


# ---------------------------------------------------------------- statistics (A1, A2)
LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _stats_sql():
    rows = []
    for i, c in enumerate(LI_FEATURES):
        rows.append(
            f"SELECT {i} AS position, '{c}' AS feature, {r4(f'avg({c})')} AS mean, {r4(f'stddev_samp({c})')} AS std, "
            f"{r4(f'min({c})')} AS min, {r4(f'max({c})')} AS max, {r4(f'quantile_cont({c}, 0.5)')} AS median, "
            f"{r4(f'quantile_cont({c}, 0.25)')} AS q25, {r4(f'quantile_cont({c}, 0.75)')} AS q75 FROM lineitem")
    return "\nUNION ALL\n".join(rows)


@query("column_stats", _stats_sql())
def column_stats(spark, sf):
    return stats.column_stats(table(spark, sf, "lineitem"), LI_FEATURES)


CORR_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


def _corr_sql():
    rows = []
    for i, a in enumerate(CORR_FEATURES):
        rows.append(f"SELECT '{a}' AS f1, '{a}' AS f2, 1.0::DOUBLE AS r")
        for b in CORR_FEATURES[i + 1:]:
            rows.append(f"SELECT '{a}' AS f1, '{b}' AS f2, {r4(f'corr({a}, {b})')} AS r FROM lineitem")
            rows.append(f"SELECT '{b}' AS f1, '{a}' AS f2, {r4(f'corr({a}, {b})')} AS r FROM lineitem")
    return "\nUNION ALL\n".join(rows)


@query("correlation", _corr_sql())
def correlation(spark, sf):
    return stats.correlation_long(table(spark, sf, "lineitem"), CORR_FEATURES)


# ---------------------------------------------------------------- joins
@query("join_chain_inner", """
SELECT c.c_custkey, c.c_name, c.nationkey, c.c_acctbal, c.c_mktsegment, n.n_name, n.regionkey, r.r_name
FROM (SELECT c_custkey, c_name, c_nationkey AS nationkey, c_acctbal, c_mktsegment FROM customer) c
JOIN (SELECT n_nationkey AS nationkey, n_name, n_regionkey AS regionkey FROM nation) n
  ON c.nationkey IS NOT DISTINCT FROM n.nationkey
JOIN (SELECT r_regionkey AS regionkey, r_name FROM region) r ON n.regionkey IS NOT DISTINCT FROM r.regionkey""")
def join_chain_inner(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "nationkey")
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "nationkey") \
        .withColumnRenamed("n_regionkey", "regionkey")
    r = table(spark, sf, "region").withColumnRenamed("r_regionkey", "regionkey")
    return joins.join_tables(("customer", c), [("nation", n, "nationkey", "inner"), ("region", r, "regionkey", "inner")])


@query("join_left_clash", """
SELECT c.id, c.c_name, c.acctbal, s.s_name, s.acctbal AS acctbal_supplier
FROM (SELECT c_custkey AS id, c_name, c_acctbal AS acctbal FROM customer) c
LEFT JOIN (SELECT s_suppkey AS id, s_name, s_acctbal AS acctbal FROM supplier) s ON c.id = s.id""")
def join_left_clash(spark, sf):
    """J1, left join with a clashing column name."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_acctbal").alias("acctbal"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.col("s_acctbal").alias("acctbal"))
    return joins.join_two(c, s, "id", "left", "supplier")


@query("join_outer_nullkey", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, d.source, l.quality, l.toxic
FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS doc_id, lang, source FROM documents) d
FULL OUTER JOIN (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id END AS doc_id, quality, toxic FROM labels) l
  ON d.doc_id = l.doc_id""")
def join_outer_nullkey(spark, sf):
    d = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 10 == 0, None).otherwise(F.col("doc_id")).alias("doc_id"), "lang", "source")
    lb = table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id")).alias("doc_id"), "quality", "toxic")
    return joins.join_two(d, lb, "doc_id", "outer", "labels")


@query("join_inner_orders", """
SELECT o.o_orderkey, o.custkey, o.o_totalprice, c.c_name, c.c_mktsegment
FROM (SELECT o_orderkey, o_custkey AS custkey, o_totalprice FROM orders) o
JOIN (SELECT c_custkey AS custkey, c_name, c_mktsegment FROM customer) c ON o.custkey IS NOT DISTINCT FROM c.custkey""")
def join_inner_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_mktsegment")
    return joins.join_two(o, c, "custkey", "inner", "customer")


# ---------------------------------------------------------------- cluster profiles with given labels (A3-A5)
EMB_DIM = 64


def embeddings_wide(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").alias("cluster"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_DIM)])


EMB_LONG_SQL = "SELECT vec_id, label, i - 1 AS position, 'e' || (i - 1) AS feature, embedding[i]::DOUBLE AS x " \
               f"FROM embeddings, range(1, {EMB_DIM + 1}) t(i)"


@query("cluster_sizes", """
SELECT label::INT AS cluster_id, count(*) AS size,
  round(CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DECIMAL(38,10)), 1)::DOUBLE AS percentage
FROM embeddings GROUP BY label""")
def cluster_sizes(spark, sf):
    return profiles.cluster_sizes(embeddings_wide(spark, sf))


@query("cluster_centroids", f"""
WITH l AS ({EMB_LONG_SQL})
SELECT label::INT AS cluster_id, position::INTEGER AS position, feature, {r4('avg(x)')} AS value
FROM l GROUP BY label, position, feature""")
def cluster_centroids(spark, sf):
    return profiles.cluster_centroids(embeddings_wide(spark, sf), [f"e{i}" for i in range(EMB_DIM)])


@query("cluster_top_features", f"""
WITH l AS ({EMB_LONG_SQL}),
o AS (SELECT feature, avg(x) AS om, stddev_pop(x) AS os FROM l GROUP BY feature),
c AS (SELECT label::INT AS cluster_id, position, feature, avg(x) AS cm FROM l GROUP BY label, position, feature),
d AS (SELECT c.*, om, os, abs(cm - om) / os AS dev, (cm - om) / os AS zs,
             row_number() OVER (PARTITION BY cluster_id ORDER BY abs(cm - om) / os DESC, position) AS rank
      FROM c JOIN o USING (feature))
SELECT cluster_id, rank::INTEGER AS rank, feature, {r4('cm')} AS cluster_mean, {r4('om')} AS overall_mean,
       {r4('dev')} AS z_deviation, {r4('zs')} AS z_signed FROM d WHERE rank <= 5""")
def cluster_top_features(spark, sf):
    return profiles.top_features(embeddings_wide(spark, sf), [f"e{i}" for i in range(EMB_DIM)])


# ---------------------------------------------------------------- preview (P2, P6), anomaly share
@query("sample_values", """
SELECT "column", rank::INTEGER AS rank, value FROM (
  SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY c_custkey) AS rank FROM (
    UNPIVOT (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
                    CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer)
    ON k, c_name, c_nationkey, c_acctbal, c_mktsegment INTO NAME "column" VALUE value))
WHERE rank <= 3""")
def sample_values(spark, sf):
    """First three non-null values of every column, by key (text form)."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("k"), "c_name", "c_nationkey",
                                            "c_acctbal", "c_mktsegment")
    return profile.sample_values(c, "c_custkey").where(F.col("column") != "c_custkey")


@query("preview_rows", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
  o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)""")
def preview_rows(spark, sf):
    """The first five rows (by key) as text, nulls shown as ''."""
    return profile.preview_rows(table(spark, sf, "orders"), 5, order_by="o_orderkey")


@query("anomaly_share", """
SELECT sum(CASE WHEN l_quantity > 45 OR l_discount >= 0.1 THEN 1 ELSE 0 END)::BIGINT AS anomalies, count(*) AS rows,
  round(CAST(sum(CASE WHEN l_quantity > 45 OR l_discount >= 0.1 THEN 1 ELSE 0 END) * 100.0 / count(*) AS DECIMAL(38,10)), 1)::DOUBLE AS share_pct
FROM lineitem""")
def anomaly_share(spark, sf):
    """A6 on a fixed rule column (large quantity or large discount)."""
    li = table(spark, sf, "lineitem").select(((F.col("l_quantity") > 45) | (F.col("l_discount") >= 0.1))
                                             .cast("int").alias("anomaly"))
    return profiles.anomaly_share(li)


@query("label_centroids", """
WITH codes AS (SELECT value, (dense_rank() OVER (ORDER BY value) - 1) AS code FROM (SELECT DISTINCT p_brand AS value FROM part)),
n AS (SELECT max(code) AS top FROM codes),
c AS (SELECT p_type AS cluster, avg(code) AS m FROM part JOIN codes ON p_brand = value GROUP BY p_type)
SELECT cluster, round(CAST(c.m AS DECIMAL(38,10)), 4)::DOUBLE AS mean_code,
  (SELECT value FROM codes WHERE code = greatest(0, least(round_even(c.m, 0), n.top))) AS category
FROM c, n""")
def label_centroids(spark, sf):
    """The mean label code of ``p_brand`` per ``p_type`` decoded back to a brand
    (half-even rounding, clamped to the code range)."""
    part = table(spark, sf, "part")
    enc = prep.encode_categoricals(part, "p_partkey", ["p_brand"], cardinality_threshold=10)
    feats = enc.frame("p_partkey").join(part.select("p_partkey", F.col("p_type").alias("cluster")), "p_partkey")
    cent = feats.groupBy("cluster").agg(F.avg("p_brand").alias("value")).withColumn("feature", F.lit("p_brand"))
    out = prep.decode_labels(cent, enc.label_maps)
    return rounded(out.select("cluster", F.col("value").alias("mean_code"), "category"))


@query("coerce_text_numbers", f"""
WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS q, l_tax FROM lineitem),
m AS (SELECT quantile_cont(q, 0.5) AS mq FROM v)
SELECT id, {r4('l_tax')} AS l_tax, {r4('coalesce(q, mq)')} AS quantity_text FROM v, m""")
def coerce_text_numbers(spark, sf):
    """Numbers held as text; the text ``nan`` is missing and takes the median."""
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_tax",
        F.when(F.col("l_orderkey") % 10 == 0, "nan").otherwise(F.col("l_quantity").cast("string")).alias("quantity_text"))
    return rounded(prep.prepare_features(li, "id", numeric=["l_tax"], categorical=["quantity_text"]).features)


@query("feature_limit", """
SELECT o_orderkey AS id, o_totalprice, dense_rank() OVER (ORDER BY o_orderpriority)::DOUBLE - 1 AS o_orderpriority,
  CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderstatus_O",
  CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::DOUBLE AS "o_orderstatus_P" FROM orders""")
def feature_limit(spark, sf):
    """With room for three encoded columns the wider one-hot group falls back to codes."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    p = prep.prepare_features(o, "id", numeric=["o_totalprice"], categorical=["o_orderpriority", "o_orderstatus"], max_features=3)
    return p.features
