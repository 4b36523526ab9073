"""Registered queries for the table operations: tickets (from ``orders`` and ``lineitem``),
chat logs (``conversations``), cluster labels (``embeddings`` + ``nation``)."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from ..operators import chat, labels, models, profiles, series, tickets, wording
from ..operators.runs import RunStore
from ..session import scratch_path, table
from .core import EMB_DIM, EMB_LONG_SQL, embeddings_wide
from .modelling import SILHOUETTE_SQL
from .registry import query, r4, rounded

AS_OF = "2024-01-01 00:00:00"


def ticket_table(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "solved").when(F.col("o_orderstatus") == "O", "open") \
        .otherwise("in_progress")
    prio = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high") \
        .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("medium")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lit("").alias("description"), status.alias("status"), prio.alias("priority"),
        F.array(F.concat(F.lit("y"), F.year("o_orderdate").cast("string")), F.lower("o_orderstatus")).alias("tags"),
        F.lit("").alias("resolution"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(status == "solved", F.col("o_orderdate")).alias("solved_at"))


TICKETS_SQL = """
SELECT o_orderkey AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, '' AS description,
  CASE o_orderstatus WHEN 'F' THEN 'solved' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low'
       ELSE 'medium' END AS priority,
  ['y' || CAST(year(o_orderdate) AS VARCHAR), lower(o_orderstatus)] AS tags, '' AS resolution,
  o_orderdate AS created_at, o_orderdate AS updated_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS solved_at
FROM orders"""

PRIO_SQL = "CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END"


@query("ticket_order", f"""
WITH t AS ({TICKETS_SQL})
SELECT id, priority, created_at, row_number() OVER (ORDER BY {PRIO_SQL}, created_at DESC, id) AS position FROM t""")
def ticket_order(spark, sf):
    return tickets.ordered(ticket_table(spark, sf)).select("id", "priority", "created_at", "position")


@query("ticket_filter", f"""
WITH t AS ({TICKETS_SQL})
SELECT id, status, priority FROM t WHERE status = 'open' AND priority = 'high' AND list_contains(tags, 'y1996')""")
def ticket_filter(spark, sf):
    return tickets.list_tickets(ticket_table(spark, sf), "open", "high", "y1996").select("id", "status", "priority")


@query("ticket_stats", f"""
WITH t AS ({TICKETS_SQL})
SELECT 'total' AS dimension, NULL AS value, count(*) AS count FROM t
UNION ALL SELECT 'status', status, count(*) FROM t GROUP BY status
UNION ALL SELECT 'priority', priority, count(*) FROM t GROUP BY priority""")
def ticket_stats(spark, sf):
    return tickets.stats(ticket_table(spark, sf))


def ticket_changes(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.max("l_quantity").alias("qmax"))
    return g.select("id", F.when(F.col("returned") == 1, "wont_fix").alias("status"),
                    F.when(F.col("qmax") >= 50, "critical").alias("priority"),
                    F.when(F.col("returned") == 1, "returned").alias("resolution")) \
        .where(F.col("status").isNotNull() | F.col("priority").isNotNull())


APPLIED_SQL = f"""
WITH t AS ({TICKETS_SQL}),
g AS (SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
             max(l_quantity) AS qmax FROM lineitem GROUP BY l_orderkey),
c AS (SELECT id, CASE WHEN returned = 1 THEN 'wont_fix' END AS n_status, CASE WHEN qmax >= 50 THEN 'critical' END AS n_priority,
             CASE WHEN returned = 1 THEN 'returned' END AS n_resolution FROM g WHERE returned = 1 OR qmax >= 50)
SELECT t.id, coalesce(n_status, status) AS status, coalesce(n_priority, priority) AS priority,
  coalesce(n_resolution, resolution) AS resolution,
  CASE WHEN n_status IS NOT NULL OR n_priority IS NOT NULL OR n_resolution IS NOT NULL
       THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at,
  CASE WHEN n_status IN ('solved', 'wont_fix') THEN TIMESTAMP '{AS_OF}'
       WHEN n_status IS NOT NULL AND status IN ('solved', 'wont_fix') THEN NULL ELSE solved_at END AS solved_at
FROM t LEFT JOIN c ON t.id = c.id"""


@query("ticket_apply", APPLIED_SQL)
def ticket_apply(spark, sf):
    out = tickets.apply_changes(ticket_table(spark, sf), ticket_changes(spark, sf), AS_OF)
    return out.select("id", "status", "priority", "resolution", "updated_at", "solved_at")


@query("ticket_store_replayed", APPLIED_SQL)
def ticket_store_replayed(spark, sf):
    """K4-K6 through the commit log: all tickets loaded, one batch of changes delivered twice with different clocks, applied once."""
    store = tickets.TicketStore(spark, scratch_path(spark, "tickets"))
    store.load(ticket_table(spark, sf), ("orders", 0))
    for clock in (AS_OF, "2031-01-01 00:00:00"):
        store.apply(ticket_changes(spark, sf), clock, batch=("lines", 0))
    return store.read().select("id", "status", "priority", "resolution", "updated_at", "solved_at")


@query("run_store", """
WITH n AS (SELECT n_nationkey, n_name, count(c_custkey) AS customers, coalesce(round(sum(c_acctbal)), 0)::BIGINT AS balance
  FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
  WHERE r_name IN ('AFRICA', 'ASIA') GROUP BY n_nationkey, n_name)
SELECT r.r_name AS id, 'Customers of ' || r.r_name AS title, sum(customers)::BIGINT AS num_rows, count(*) AS charts,
  string_agg(n.n_name, ',' ORDER BY n.n_nationkey) AS chart_titles
FROM n JOIN nation m USING (n_nationkey) JOIN region r ON m.n_regionkey = r.r_regionkey WHERE r.r_name <> 'AFRICA' GROUP BY r.r_name""")
def run_store(spark, sf):
    """A run for each of two regions (customers counted, a chart for each nation) saved, one deleted, the rest read back with
    their charts in order."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    counts = (nation.join(region.where(F.col("r_name").isin("AFRICA", "ASIA")), F.col("n_regionkey") == F.col("r_regionkey"))
              .join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
              .groupBy("r_name", "n_nationkey", "n_name").agg(F.count("c_custkey").alias("customers")).orderBy("n_nationkey").collect())   # one row a nation
    store = RunStore(spark, scratch_path(spark, "runs"))
    for name in ("AFRICA", "ASIA"):
        rows = [r for r in counts if r["r_name"] == name]
        store.save({"id": name, "title": f"Customers of {name}", "num_rows": sum(r["customers"] for r in rows)},
                   [{"chart_type": "bar", "title": r["n_name"], "plotly_json": "{}"} for r in rows])
    store.delete("AFRICA")
    out = store.list().select("id").collect()
    found = reduce(lambda a, b: a.unionByName(b), [store.get(r["id"]) for r in out])
    return found.select("id", "title", "num_rows", F.size("charts").cast("bigint").alias("charts"),
                        F.array_join(F.transform("charts", lambda c: c["title"]), ",").alias("chart_titles"))


# order lines in a total order
LINE = "row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)"


@query("ticket_apply_ordered", f"""
WITH t AS ({TICKETS_SQL}),
c AS (SELECT l_orderkey AS id, arg_max(CASE WHEN l_returnflag = 'R' THEN 'wont_fix' WHEN l_returnflag = 'A' THEN 'open' END, {LINE})
               FILTER (l_returnflag IN ('R', 'A')) AS n_status,
             arg_max(CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 30 THEN 'high' END, {LINE})
               FILTER (l_quantity >= 30) AS n_priority FROM lineitem GROUP BY l_orderkey)
SELECT t.id, coalesce(n_status, status) AS status, coalesce(n_priority, priority) AS priority,
  CASE WHEN n_status = 'wont_fix' THEN TIMESTAMP '{AS_OF}'
       WHEN n_status IS NOT NULL AND status IN ('solved', 'wont_fix') THEN NULL ELSE solved_at END AS solved_at
FROM t LEFT JOIN c ON t.id = c.id""")
def ticket_apply_ordered(spark, sf):
    """K5 with several changes per ticket (one for each order line): the last given value of each field wins."""
    flag, qty = F.col("l_returnflag"), F.col("l_quantity")
    changes = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").alias("line"),
        F.when(flag == "R", "wont_fix").when(flag == "A", "open").alias("status"),
        F.when(qty >= 45, "critical").when(qty >= 30, "high").alias("priority"))
    out = tickets.apply_changes(ticket_table(spark, sf), changes, AS_OF, order="line")
    return out.select("id", "status", "priority", "solved_at")


@query("ticket_delete", f"""
WITH t AS ({TICKETS_SQL})
SELECT id FROM t WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 5000)""")
def ticket_delete(spark, sf):
    gone = table(spark, sf, "orders").where(F.col("o_totalprice") < 5000).select(F.col("o_orderkey").alias("id"))
    remaining, _ = tickets.delete(ticket_table(spark, sf), gone)
    return remaining.select("id")


def _sql_clean_ws(x: str) -> str:
    x = f"regexp_replace({x}, ' +', ' ', 'g')"
    x = f"regexp_replace({x}, ' ([.,!?;:])', '\\1', 'g')"
    x = f"regexp_replace({x}, '([.,!?;:])([A-Za-z])', '\\1 \\2', 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def _sql_title(t: str, d: str) -> str:
    ct = _sql_clean_ws(t)
    verbs = "|".join(re.escape(v.lower()) for v in wording.ACTION_VERBS)
    combined = f"lower({ct} || ' ' || coalesce({d}, ''))"
    suggest = "CASE " + " ".join(f"WHEN strpos({combined}, '{kw}') > 0 THEN '{v}'" for kw, v in
                                 wording.VERB_SUGGESTIONS) + f" ELSE '{wording.DEFAULT_VERB}' END"
    stripped = _sql_cap(f"regexp_replace({ct}, '^(the|a|an|we need to|we should|should|need to|must)\\s+', '', 'i')")
    with_verb = (f"CASE WHEN length({stripped}) > 0 THEN {suggest} || ' ' || lower(substr({stripped}, 1, 1)) || "
                 f"substr({stripped}, 2) ELSE {suggest} END")
    out = f"CASE WHEN regexp_matches(lower({ct}), '^({verbs})') THEN {ct} ELSE {with_verb} END"
    return f"regexp_replace({_sql_cap(out)}, '\\.+$', '')"


def _sql_desc(d: str) -> str:
    c = _sql_cap(_sql_clean_ws(f"coalesce({d}, '')"))
    t = f"regexp_replace({c}, '\\s+$', '')"
    return (f"CASE WHEN coalesce({d}, '') = '' THEN coalesce({d}, '') WHEN length({t}) > 0 AND "
            f"right({t}, 1) NOT IN ('.', '!', '?') THEN {t} || '.' ELSE {t} END")


def chat_requests(spark, sf):
    """User turns as ticket titles, the reply that follows as the description."""
    c = chat.with_next(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", "text")
    return c.where(F.col("role") == "user").select(
        "conv_id", "turn", "role", F.col("text").alias("title"), F.col("next_text").alias("description"))


CHAT_REQ_SQL = """
SELECT conv_id, turn, role, text AS title, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS description
FROM conversations QUALIFY role = 'user'"""


@query("text_cleanup", f"""
WITH r AS ({CHAT_REQ_SQL})
SELECT conv_id, turn, {_sql_title('title', 'description')} AS title, {_sql_desc('description')} AS description FROM r""")
def text_cleanup(spark, sf):
    return wording.tidy(chat_requests(spark, sf)).select("conv_id", "turn", "title", "description")


@query("cleanup_preview", f"""
WITH r AS ({CHAT_REQ_SQL}),
c AS (SELECT conv_id * 100000 + turn AS id, title AS t0, description AS d0, {_sql_title('title', 'description')} AS t1, {_sql_desc('description')} AS d1 FROM r)
SELECT id, 'title' AS field, t0 AS before, t1 AS after FROM c WHERE t0 IS DISTINCT FROM t1
UNION ALL SELECT id, 'description', d0, d1 FROM c WHERE d0 IS DISTINCT FROM d1""")
def cleanup_preview(spark, sf):
    """K8: what the clean-up would change."""
    r = chat_requests(spark, sf).withColumn("id", F.col("conv_id") * 100000 + F.col("turn"))
    return wording.changes(r)


# ------------------------------------------------------------------ chat
FEEDBACK_KEYWORD = "eau"

FLAGS_SQL = f"""
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN strpos(lower(text), '{FEEDBACK_KEYWORD}') > 0
       WHEN role = 'assistant' AND lag(role) OVER w = 'user' THEN coalesce(lag(role = 'user' AND strpos(lower(text), '{FEEDBACK_KEYWORD}') > 0) OVER w, false)
       ELSE false END AS is_feedback
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


def _flags(spark, sf):
    # the order has gaps: 0, 2, 6, 12, ...
    c = table(spark, sf, "conversations").withColumn("pos", F.col("turn") * (F.col("turn") + 1))
    return chat.flag_feedback(c, "conv_id", "pos", "role", "text", FEEDBACK_KEYWORD)


@query("feedback_flags", FLAGS_SQL)
def feedback_flags(spark, sf):
    return _flags(spark, sf).select("conv_id", "turn", "role", "is_feedback")


@query("feedback_transcripts", f"""
WITH f AS ({FLAGS_SQL})
SELECT conv_id, turn, role, is_feedback FROM f WHERE conv_id IN (SELECT conv_id FROM f WHERE is_feedback)""")
def feedback_transcripts(spark, sf):
    return chat.feedback_transcripts(_flags(spark, sf), "conv_id").select("conv_id", "turn", "role", "is_feedback")


@query("last_messages", """
SELECT conv_id, turn, role, from_end::INTEGER AS from_end FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end
  FROM conversations) WHERE from_end <= 20""")
def last_messages(spark, sf):
    return chat.last_messages(table(spark, sf, "conversations"), "conv_id", "turn").select(
        "conv_id", "turn", "role", "from_end")


# ------------------------------------------------------------------ labels
def _emb_profiles(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"))
    return profiles.cluster_sizes(e)


def _nation_labels(spark, sf):
    """Every nation twice: an early label, and a later one that is blank for some (``at`` tells the order)."""
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    blank = (F.col("n_nationkey") == 3) | (F.col("n_regionkey") == 2)
    return j.select(F.col("n_nationkey").cast("int").alias("id"), F.inline(F.array(
        F.struct(F.lit(2).alias("at"), F.when(blank, F.lit("")).otherwise(F.col("n_name")).alias("label"),
                 F.when(F.col("n_regionkey") == 2, F.lit(None)).otherwise(F.concat(F.lit("Nations of "), F.col("r_name"))).alias("description")),
        F.struct(F.lit(1).alias("at"), F.lit("early").alias("label"), F.lit("early").alias("description")))))


@query("label_merge", """
WITH p AS (SELECT label::INT AS cluster_id, count(*) AS size,
             round(CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DECIMAL(38,10)), 1)::DOUBLE AS percentage
           FROM embeddings GROUP BY label),
l AS (SELECT n_nationkey::INT AS id, CASE WHEN n_nationkey = 3 OR n_regionkey = 2 THEN '' ELSE n_name END AS label,
             CASE WHEN n_regionkey <> 2 THEN 'Nations of ' || r_name END AS description FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT p.cluster_id AS id, coalesce(nullif(l.label, ''), 'Cluster ' || CAST(p.cluster_id AS VARCHAR)) AS label,
  coalesce(nullif(l.description, ''), 'No description available.') AS description, size, percentage
FROM p LEFT JOIN l ON p.cluster_id = l.id""")
def label_merge(spark, sf):
    """Of repeated label ids the last by order wins; blank labels and missing texts fall back."""
    return labels.merge_labels(_emb_profiles(spark, sf), _nation_labels(spark, sf), order="at")


@query("quality_band", f"""{SILHOUETTE_SQL},
q AS (SELECT cluster AS cluster_id, avg(s) AS sil FROM s GROUP BY cluster)
SELECT cluster_id, {r4('sil')} AS silhouette,
  CASE WHEN sil < 0.25 THEN 'poor' WHEN sil < 0.5 THEN 'fair' WHEN sil < 0.75 THEN 'good' ELSE 'excellent' END AS band
FROM q""")
def quality_band(spark, sf):
    """L5 on the mean linear silhouette of each given label of the embeddings."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"),
                                              F.col("embedding").cast("array<double>").alias(models.Z))
    pp = models.silhouette(e, "vec_id", per_point=True)
    s = pp.groupBy(F.col("cluster").alias("cluster_id")).agg(F.avg("silhouette").alias("sil"))
    return rounded(s.select("cluster_id", F.col("sil").alias("silhouette"), labels.quality_band(F.col("sil")).alias("band")))


@query("clustering_quality", f"""{SILHOUETTE_SQL}
SELECT 'Cluster ' || label AS series, count(*) AS size, printf('%.3f', (SELECT avg(s) FROM s)) AS silhouette FROM embeddings GROUP BY label""")
def clustering_quality(spark, sf):
    """Sizes of the given labels next to their overall silhouette."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias(models.Z))
    return series.quality(profiles.cluster_sizes(e), models.silhouette(e, "vec_id"))


@query("cluster_summary_text", f"""
WITH l AS ({EMB_LONG_SQL}),
o AS (SELECT feature, avg(x) AS om, stddev_pop(x) AS os FROM l GROUP BY feature),
c AS (SELECT label::INT AS cluster_id, position, feature, avg(x) AS cm FROM l GROUP BY label, position, feature),
d AS (SELECT c.*, om, abs(cm - om) / os AS dev, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(cm - om) / os DESC, position) AS rank
      FROM c JOIN o USING (feature)),
t AS (SELECT cluster_id, string_agg('  - ' || feature || ': cluster mean=' || printf('%.4f', {r4('cm')}) || ', overall mean=' || printf('%.4f', {r4('om')})
        || ', z=' || printf('%.4f', {r4('dev')}) || ' (' || CASE WHEN dev > 0 THEN 'above' ELSE 'below' END || ' average)', chr(10) ORDER BY rank) AS body
      FROM d WHERE rank <= 5 GROUP BY cluster_id),
s AS (SELECT label::INT AS cluster_id, count(*) AS size, round(CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DECIMAL(38,10)), 1)::DOUBLE AS p
      FROM embeddings GROUP BY label)
SELECT cluster_id, 'Cluster ' || cluster_id || ': ' || size || ' samples (' || printf('%.1f', p) || '%)' || chr(10) || body AS summary
FROM s JOIN t USING (cluster_id)""")
def cluster_summary_text(spark, sf):
    """L2: summary text per given label of the embeddings, numbers with four digits."""
    w = embeddings_wide(spark, sf)
    feats = [f"e{i}" for i in range(EMB_DIM)]
    return labels.summary_text(profiles.cluster_sizes(w), profiles.top_features(w, feats), decimals=4)


@query("chat_exchange_rows", f"""
WITH x AS (SELECT conv_id AS session_id, turn AS created_at, text AS user_text,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, role FROM conversations)
SELECT session_id, r.role, r.content, strpos(lower(user_text), '{FEEDBACK_KEYWORD}') > 0 AS is_feedback, created_at, r.seq
FROM x, (SELECT 'user' AS role, 0 AS seq UNION ALL SELECT 'assistant', 1) r0,
     LATERAL (SELECT r0.role AS role, CASE WHEN r0.seq = 0 THEN user_text ELSE reply_text END AS content, r0.seq AS seq) r
WHERE x.role = 'user' AND x.next_role = 'assistant'""")
def chat_exchange_rows(spark, sf):
    """Each user turn and the reply that follows become two log rows sharing one flag."""
    c = chat.with_next(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn", "role", "text")
    ex = c.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"), F.col("text").alias("user_text"),
        F.col("next_text").alias("reply_text"))
    return chat.exchange_rows(ex, keyword=FEEDBACK_KEYWORD)


# ------------------------------------------------------------------ session ids and chart series
@query("session_id_check", """
WITH m AS (SELECT doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN h WHEN 1 THEN substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13)
  WHEN 2 THEN '{' || upper(h) || '}' WHEN 3 THEN 'urn:uuid:' || h WHEN 4 THEN substring(h, 2) ELSE h || 'g' END AS session_id FROM m)
SELECT doc_id, session_id, doc_id % 6 < 4 AS valid FROM s""")
def session_id_check(spark, sf):
    """H5 on ids made from each text's digest, in several spellings."""
    h, k = F.md5("text"), F.col("doc_id") % 6
    spelled = (F.when(k == 0, h).when(k == 1, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 20)))
               .when(k == 2, F.concat(F.lit("{"), F.upper(h), F.lit("}"))).when(k == 3, F.concat(F.lit("urn:uuid:"), h))
               .when(k == 4, F.substring(h, 2, 31)).otherwise(F.concat(h, F.lit("g"))))
    ids = table(spark, sf, "documents").where("text is not null").select("doc_id", spelled.alias("session_id"))
    return ids.withColumn("valid", chat.valid_session_id(F.col("session_id")))


def _chart_rows(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", e[0].cast("double").alias("pc1"), e[1].cast("double").alias("pc2"), F.when(F.col("vec_id") % 2 == 0, e[2].cast("double")).alias("pc3"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"), (F.col("vec_id") % 10 == 0).cast("int").alias("anomaly"))


@query("scatter_series", f"""
SELECT vec_id, {r4('embedding[1]')} AS pc1, {r4('embedding[2]')} AS pc2, {r4('CASE WHEN vec_id % 2 = 0 THEN embedding[3] ELSE 0 END')} AS pc3,
  CASE WHEN label = 9 THEN -1 ELSE label END AS cluster, CASE WHEN label = 9 THEN 'Noise' ELSE 'Cluster ' || label END AS series FROM embeddings""")
def scatter_series(spark, sf):
    """The points of both scatter charts, noise named, a missing third component as 0."""
    rows = _chart_rows(spark, sf)
    both = series.scatter_2d(rows, "vec_id").join(series.scatter_3d(rows, "vec_id").select("vec_id", "pc3"), "vec_id")
    return rounded(both.select("vec_id", "pc1", "pc2", "pc3", "cluster", "series"))


@query("anomaly_overlay_filled", """
SELECT a.anomaly, count(*) AS drawn FROM (SELECT (vec_id % 10 = 0)::INT AS anomaly,
  row_number() OVER (PARTITION BY vec_id % 10 = 0 ORDER BY vec_id) AS place FROM embeddings) a
WHERE a.anomaly = 1 OR a.place <= 200 - (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) GROUP BY a.anomaly
HAVING (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) < 200
UNION ALL SELECT (vec_id % 10 = 0)::INT, count(*) FROM embeddings WHERE (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) >= 200 GROUP BY ALL""")
def anomaly_overlay_filled(spark, sf):
    """All anomalies and a sample of the normals, 200 points in all; the numbers of both kinds (which normals are drawn goes by hash).
    Where the anomalies alone are 200, nothing is sampled."""
    drawn = series.anomaly_overlay(_chart_rows(spark, sf), "vec_id", 200)
    return drawn.dropDuplicates(["vec_id"]).groupBy("anomaly").agg(F.count(F.lit(1)).alias("drawn"))
