"""Registered queries for sources, sinks, the catalogue, the stream and chart series."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, labels, profiles, series, stats
from ..session import scratch_path, table
from ..sources import content, readers, sinks
from ..streaming.sessions import closed_sessions
from .core import EMB_DIM, embeddings_wide
from .registry import query, r4, rounded


@query("content_kind_pages", r"""
SELECT page_id, CASE WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'html'
  WHEN starts_with(h, '<?xml') THEN 'xml' ELSE 'data' END AS kind
FROM (SELECT page_id, lower(regexp_replace(substr(html, 1, 500), '^\s+|\s+$', '', 'g')) AS h FROM pages)""")
def content_kind_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", content.content_kind(F.col("html")).alias("kind"))


@query("content_kind_documents", r"""
SELECT doc_id, CASE WHEN starts_with(h, '<!doctype html') OR starts_with(h, '<html') THEN 'html'
  WHEN starts_with(h, '<?xml') THEN 'xml' ELSE 'data' END AS kind
FROM (SELECT doc_id, lower(regexp_replace(substr(text, 1, 500), '^\s+|\s+$', '', 'g')) AS h FROM documents)""")
def content_kind_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content.content_kind(F.col("text")).alias("kind"))


@query("key_sanitise", r"""
SELECT page_id, 'pages_' || regexp_replace(url, '[^a-zA-Z0-9_\-]', '_', 'g') AS dataset_key FROM pages""")
def key_sanitise(spark, sf):
    return table(spark, sf, "pages").select("page_id", content.dataset_key(F.lit("pages"), F.col("url")).alias("dataset_key"))


@query("direct_link", r"""
SELECT page_id, coalesce(length(url) > 0, false) AND
  regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)),
                 '\.(csv|json|xlsx|xls|parquet|zip|tsv)$') AS direct
FROM pages""")
def direct_link(spark, sf):
    return table(spark, sf, "pages").select("page_id", content.direct_link(F.col("url")).alias("direct"))


@query("csv_roundtrip", "SELECT doc_id::INTEGER AS doc_id, text, lang, source, n_chars::INTEGER AS n_chars FROM documents")
def csv_roundtrip(spark, sf):
    """W1 then R1: texts with quotes, separators and line breaks written as CSV to the shared folder and read back."""
    path = scratch_path(spark, "documents-csv")
    sinks.write_csv(table(spark, sf, "documents"), path)
    return readers.load_table(spark, path, fmt="csv")


@query("tsv_roundtrip", """
SELECT conv_id::INTEGER AS conv_id, turn::INTEGER AS turn, role, role || chr(9) || '"' || text || '"' || chr(10) || 'end' AS told FROM conversations""")
def tsv_roundtrip(spark, sf):
    """W1 then R2: tab-separated texts with tabs, quotes and line breaks."""
    path = scratch_path(spark, "conversations-tsv")
    told = F.concat("role", F.lit('\t"'), "text", F.lit('"\nend'))
    sinks.write_csv(table(spark, sf, "conversations").select("conv_id", "turn", "role", told.alias("told")), path, sep="\t")
    return readers.load_table(spark, path, fmt="tsv")


@query("json_roundtrip", """
SELECT o_orderkey, o_custkey AS "detail.o_custkey", o_totalprice AS "detail.o_totalprice",
  o_orderpriority AS "detail.flags.priority" FROM orders""")
def json_roundtrip(spark, sf):
    """Nested records written as JSON lines and read back flattened to a.b names."""
    path = scratch_path(spark, "orders-json")
    o = table(spark, sf, "orders")
    o.select("o_orderkey", F.struct("o_custkey", "o_totalprice", F.struct(F.col("o_orderpriority").alias("priority"))
                                    .alias("flags")).alias("detail")).write.mode("overwrite").json(path)
    return readers.read_json(spark, path, lines=True)


# ------------------------------------------------------------------ catalogue
def doc_entries(spark, sf):
    """Documents as catalogue entries: name = first line, description = whole text, tags = (lang, source)."""
    d = table(spark, sf, "documents")
    return d.select(F.col("source"), F.col("doc_id").cast("string").alias("dataset_id"),
                    F.split(F.col("text"), "\n").getItem(0).alias("name"), F.col("text").alias("description"),
                    F.lit("").alias("url"), F.col("n_chars").cast("string").alias("size"), F.lit("text").alias("format"),
                    F.array("lang", "source").alias("tags"), F.col("doc_id").alias("pos"))


def bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


SEARCH_SQL = """
WITH e AS (SELECT source, doc_id, lower(concat_ws(' ', split_part(text, chr(10), 1), text, lang, source)) AS s FROM documents),
q AS (SELECT item_id, text FROM benchmark WHERE length(trim(text)) BETWEEN 2 AND 200),
m AS (SELECT q.item_id, e.source, e.doc_id,
        row_number() OVER (PARTITION BY q.item_id, e.source ORDER BY e.doc_id) AS rn
      FROM q JOIN e ON strpos(e.s, lower(q.text)) > 0)"""


@query("catalogue_search", SEARCH_SQL + """
SELECT item_id AS qid, source, CAST(doc_id AS VARCHAR) AS dataset_id FROM m WHERE rn <= 5""")
def catalogue_search(spark, sf):
    """S6 + S9 + S12: entries containing the query, first five per (query, source)."""
    return catalog.search(bench_queries(spark, sf), doc_entries(spark, sf)).select("qid", "source", "dataset_id")


@query("provider_activity", SEARCH_SQL + """
SELECT item_id AS qid, source, count(*) AS results FROM m WHERE rn <= 5 GROUP BY item_id, source""")
def provider_activity(spark, sf):
    """Results per source for each query (sources with none are absent)."""
    return catalog.provider_activity(catalog.search(bench_queries(spark, sf), doc_entries(spark, sf)))


@query("catalogue_rank")
def catalogue_rank(spark, sf):
    """S10 + S11: relevance score, order, near-duplicate removal per query."""
    found = catalog.search(bench_queries(spark, sf), doc_entries(spark, sf))
    return rounded(catalog.dedup(catalog.rank(found)).select("qid", "source", "dataset_id", "score", "rank"))


def chat_history(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    return c.select(F.col("text").alias("query"),
                    F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 100 + F.col("turn"))
                    .cast("timestamp_ntz").alias("created_at"))


@query("suggestions", """
SELECT text AS query, max(make_timestamp(1704067200000000 + (conv_id * 100 + turn) * 1000000)) AS last_used
FROM conversations WHERE role = 'user' AND starts_with(lower(text), 'le')
GROUP BY text ORDER BY last_used DESC, query LIMIT 5""")
def suggestions(spark, sf):
    """Up to five past queries starting with 'Le' (case-blind), newest first."""
    return catalog.suggest(chat_history(spark, sf), "Le")


# ------------------------------------------------------------------ stream (H4)
@query("session_idle_stream", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR
             THEN 1 ELSE 0 END AS new_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
w AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS events
      FROM s GROUP BY user_id, sid)
SELECT user_id, session_start, session_end, events FROM w
WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def session_idle_stream(spark, sf):
    """H4: sessions (one-hour gap) closed by the watermark, from a streaming read of ``events``."""
    schema = table(spark, sf, "events").schema
    return closed_sessions(spark, sf, schema, glob="events.parquet")


# ------------------------------------------------------------------ chart series
LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("series_distributions", "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS feature, {r4(f'min({c})')} AS min, {r4(f'quantile_cont({c}, 0.25)')} AS q25, "
    f"{r4(f'quantile_cont({c}, 0.5)')} AS median, {r4(f'quantile_cont({c}, 0.75)')} AS q75, {r4(f'max({c})')} AS max, "
    f"{r4(f'avg({c})')} AS mean FROM lineitem" for i, c in enumerate(LI)))
def series_distributions(spark, sf):
    """C9 from A1 on lineitem."""
    return series.distributions(stats.column_stats(table(spark, sf, "lineitem"), LI))


@query("series_boxes", f"""
SELECT label::INT AS cluster_id, (i - 1)::INTEGER AS position, 'e' || (i - 1) AS feature,
  {r4('quantile_cont(embedding[i]::DOUBLE, 0.0)')} AS min, {r4('quantile_cont(embedding[i]::DOUBLE, 0.25)')} AS q1,
  {r4('quantile_cont(embedding[i]::DOUBLE, 0.5)')} AS median, {r4('quantile_cont(embedding[i]::DOUBLE, 0.75)')} AS q3,
  {r4('quantile_cont(embedding[i]::DOUBLE, 1.0)')} AS max, {r4('avg(embedding[i]::DOUBLE)')} AS mean
FROM embeddings, range(1, 65) t(i) GROUP BY label, i""")
def series_boxes(spark, sf):
    """C4: per given label, five-number summaries and means of all features."""
    w = embeddings_wide(spark, sf)
    return rounded(series.feature_boxes(w, [f"e{i}" for i in range(EMB_DIM)]))


@query("anomaly_overlay", """
SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS pc1, l_extendedprice AS pc2,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS anomaly FROM lineitem""")
def anomaly_overlay(spark, sf):
    """C8 / T6 with more anomalies than points asked for: all anomalies and all normals."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("pc1"), F.col("l_extendedprice").alias("pc2"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("anomaly"))
    return series.anomaly_overlay(rows, "id", 100)


@query("cluster_bars", """
SELECT 'Cluster ' || label AS series, count(*) AS size,
  round(CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DECIMAL(38,10)), 1)::DOUBLE || '%' AS text FROM embeddings GROUP BY label""")
def cluster_bars(spark, sf):
    """C3 for the given labels."""
    return series.cluster_bars(profiles.cluster_sizes(table(spark, sf, "embeddings").select(F.col("label").alias("cluster"))))


@query("series_heatmap", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {'1.0::DOUBLE' if a == b else 'coalesce(' + r4(f'corr({a}, {b})') + ', 0.0)'} AS r FROM lineitem"
    + (" LIMIT 1" if a == b else "") for a in LI for b in LI).replace("FROM lineitem LIMIT 1", "FROM (SELECT 1)"))
def series_heatmap(spark, sf):
    """C5 from A2 on lineitem."""
    return series.heatmap(stats.correlation_long(table(spark, sf, "lineitem"), LI))


# ------------------------------------------------------------------ portal rows (S1, S3-S8) from the given tables
ENTRY_COLUMNS = ["source", "dataset_id", "name", "description", "url", "size", "format", "tags"]


@query("entries_packages", """
SELECT 'data.gov' AS source, CAST(o_orderkey AS VARCHAR) AS dataset_id, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 'Untitled') AS name,
  coalesce(CASE WHEN o_orderstatus <> 'P' THEN 'status ' || o_orderstatus END, '') AS description,
  CASE WHEN o_custkey % 2 = 0 THEN 'https://x.org/' || o_orderkey || '.JSON' ELSE 'https://x.org/' || o_orderkey || '.csv?v=1' END AS url, '' AS size,
  CASE WHEN o_custkey % 2 = 0 THEN 'JSON' ELSE 'CSV' END AS format, [o_orderstatus, o_orderpriority] AS tags
FROM orders WHERE o_custkey % 2 = 0 OR o_orderstatus = 'F'""")
def entries_packages(spark, sf):
    """The first resource that is a direct link; packages without one are skipped."""
    resource = lambda url, fmt: F.struct(url.alias("url"), fmt.alias("format"))
    key, even = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 2 == 0
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("status "), "o_orderstatus")).alias("notes"),
        F.array(resource(F.concat(F.lit("https://x.org/page/"), key), F.lit("HTML")),
                resource(F.when(even, F.concat(F.lit("https://x.org/"), key, F.lit(".JSON"))), F.lit("json")),
                resource(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://x.org/"), key, F.lit(".csv?v=1"))),
                         F.lit(None).cast("string"))).alias("resources"),
        F.array(F.struct(F.col("o_orderstatus").alias("name")), F.struct(F.col("o_orderpriority").alias("name"))).alias("tags"))
    return catalog.normalize_ckan(rows).select(*ENTRY_COLUMNS)


@query("entries_hub", """
SELECT 'huggingface' AS source, c_mktsegment || '/' || c_name AS dataset_id, c_name AS name, '' AS description,
  'https://huggingface.co/datasets/' || c_mktsegment || '/' || c_name AS url,
  CASE WHEN c_nationkey % 3 > 0 THEN CAST(c_nationkey % 3 * 1000 AS VARCHAR) WHEN c_custkey % 5 <> 0 THEN (c_custkey % 5) || ' downloads' ELSE '' END AS size,
  'parquet' AS format, [c_mktsegment] AS tags FROM customer""")
def entries_hub(spark, sf):
    """S3: a size of 0 falls through to the downloads."""
    rows = table(spark, sf, "customer").select(
        F.concat_ws("/", "c_mktsegment", "c_name").alias("id"), F.lit(None).cast("string").alias("description"),
        F.struct((F.col("c_nationkey") % 3 * 1000).cast("long").alias("dataset_size")).alias("cardData"),
        (F.col("c_custkey") % 5).alias("downloads"), F.array("c_mktsegment").alias("tags"))
    return catalog.normalize_hub(rows).select(*ENTRY_COLUMNS)


@query("entries_listing", """
SELECT 'kaggle' AS source, p_brand || '/' || p_partkey AS dataset_id, coalesce(CASE WHEN p_size % 4 > 0 THEN p_name END, p_brand || '/' || p_partkey) AS name,
  p_type AS description, 'https://www.kaggle.com/datasets/' || p_brand || '/' || p_partkey AS url, CAST(p_size AS VARCHAR) AS size, 'CSV' AS format,
  CAST([] AS VARCHAR[]) AS tags FROM part""")
def entries_listing(spark, sf):
    """S4."""
    rows = table(spark, sf, "part").select(
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("ref"), F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("title"),
        F.col("p_type").alias("subtitle"), F.col("p_size").alias("size"))
    return catalog.normalize_kaggle(rows).select(*ENTRY_COLUMNS)


@query("entries_openml", """
SELECT 'openml' AS source, CAST(s_suppkey AS VARCHAR) AS dataset_id, s_name AS name, 'OpenML dataset #' || s_suppkey AS description,
  'https://www.openml.org/d/' || s_suppkey AS url, CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey || ' rows × ' || s_nationkey || ' cols' ELSE '' END AS size,
  'parquet' AS format, CAST([] AS VARCHAR[]) AS tags FROM supplier""")
def entries_openml(spark, sf):
    """Rows and columns from the quality list, nothing when one is missing."""
    fact = lambda name, v: F.struct(F.lit(name).alias("name"), v.alias("value"))
    cols = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.col("s_nationkey").cast("string"), F.lit(".0")))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("did"), F.col("s_name").alias("name"), F.array(
        fact("NumberOfInstances", F.concat(F.col("s_suppkey").cast("string"), F.lit(".0"))), fact("NumberOfFeatures", cols)).alias("quality"))
    return catalog.normalize_openml(rows).select(*ENTRY_COLUMNS)


@query("entries_socrata", """
SELECT 'socrata' AS source, CAST(event_id AS VARCHAR) AS dataset_id, event_type AS name, coalesce(props, '') AS description,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE 'https://d' || (user_id % 3) || '.org/resource/' || event_id || '.csv?$limit=50000' END AS url, '' AS size, 'CSV' AS format,
  CASE WHEN user_id % 2 = 0 THEN [event_type] ELSE ['a', 'b'] END AS tags FROM events""")
def entries_socrata(spark, sf):
    """Export link from the domain; categories take the place of column names."""
    rows = table(spark, sf, "events").select(
        F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("description"),
                 F.array(F.lit("a"), F.lit("b")).alias("columns_field_name")).alias("resource"),
        F.struct(F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string"), F.lit(".org"))).alias("domain")).alias("metadata"),
        F.struct(F.when(F.col("user_id") % 2 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("categories")).alias("classification"))
    return catalog.normalize_socrata(rows).select(*ENTRY_COLUMNS)


@query("entries_records", """
SELECT 'zenodo' AS source, CAST(page_id AS VARCHAR) AS dataset_id, url AS name, regexp_replace(html, '<[^>]+>', '', 'g') AS description,
  'https://zenodo.org/records/' || page_id AS url,
  CASE WHEN length(html) * 700 > 1048576 THEN printf('%.1f MB', length(html) * 700 / 1024 / 1024)
       WHEN length(html) * 700 > 1024 THEN printf('%.0f KB', length(html) * 700 / 1024) ELSE '' END AS size,
  CASE WHEN url LIKE 'https%' THEN 'CSV, JSON' ELSE 'CSV' END AS format, CAST([] AS VARCHAR[]) AS tags FROM pages WHERE url NOT LIKE '%utm_source%'""")
def entries_records(spark, sf):
    """Markup stripped from the description, sizes summed, records without a data file skipped."""
    f = lambda key, size: F.struct(key.alias("key"), size.alias("size"))
    n = F.char_length("html").cast("long")
    bare = F.col("url").contains("utm_source")
    data = F.when(bare, F.lit("t.pdf")).otherwise(F.lit("t.csv"))
    other = F.when(F.col("url").startswith("https") & ~bare, F.lit("u.json")).otherwise(F.lit("notes"))
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.struct(
        F.col("url").alias("title"), F.col("html").alias("description"), F.lit(None).cast("array<string>").alias("keywords")).alias("metadata"),
        F.array(f(data, n * 300), f(other, n * 400)).alias("files"))
    return catalog.normalize_zenodo(rows).select(*ENTRY_COLUMNS)


@query("entries_registry", """
SELECT 'aws' AS source, CASE WHEN p_size % 2 = 0 THEN 'slug-' || p_partkey ELSE replace(lower(p_name), ' ', '-') END AS dataset_id, p_name AS name, p_type AS description,
  'https://registry.opendata.aws/roda/' || CASE WHEN p_size % 2 = 0 THEN 'slug-' || p_partkey ELSE replace(lower(p_name), ' ', '-') END || '/' AS url,
  '' AS size, 'varies' AS format, [p_brand, p_type] AS tags FROM part""")
def entries_registry(spark, sf):
    """S6 (rows)."""
    rows = table(spark, sf, "part").select(
        F.col("p_name").alias("Name"), F.col("p_type").alias("Description"), F.array("p_brand", "p_type").alias("Tags"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("slug-"), F.col("p_partkey").cast("string"))).alias("Slug"))
    return catalog.normalize_registry(rows).select(*ENTRY_COLUMNS)


@query("reply_parsing", r"""
WITH r AS (SELECT conv_id, turn, text, role FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS overview, CASE WHEN role = 'user' THEN 1 END AS clusters,
  CASE WHEN role = 'user' THEN 'good' END AS quality FROM r""")
def reply_parsing(spark, sf):
    """L3: fenced JSON replies whose overview is the message; items without a label go, replies without a list are invalid."""
    item = F.struct(F.lit(1).alias("id"), F.lit("l").alias("label"), F.lit("d").alias("description"))
    bare = F.struct(F.lit(2).alias("id"), F.lit(None).cast("string").alias("label"), F.lit("d").alias("description"))
    whole = F.to_json(F.struct(F.col("text").alias("overview"), F.array(item, bare).alias("clusters"), F.lit("good").alias("quality")))
    broken = F.to_json(F.struct(F.col("text").alias("overview"), F.lit("good").alias("quality")))
    raw = F.when(F.col("role") == "user", F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(broken)
    got = labels.parse_replies(table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw")))
    return got.select("conv_id", "turn", "overview", F.size("clusters").alias("clusters"), "quality")
