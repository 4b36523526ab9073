"""Operator 1, secret scans: an incremental blob ledger, in DataFrame functions only.

Every version of every file is content-addressed (SHA-256 of its text). The ledger holds one
row per scan of a blob: which rule versions were tried and the spans they found. A scan looks
only at blobs and rule versions that the ledger does not hold yet, so a new commit costs its
new blobs, and a changed rule costs one pass of that rule. Findings are joined back to all
paths and versions that hold the blob.

Null texts count as empty. A null path stays a path of its own row. Repeated rows and copies
share one blob and get equal findings. An empty table gives no rows. Extra columns of the input
are ignored by name; the operator only reads the columns it is told.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost and non-overlapping; those whose group ``group`` has
    fewer than ``min_chars`` characters are dropped, without a retry inside them."""
    kind: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),      # equals runs of [0-9a-f]+ of 24 characters or more
)
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + ADDED_RULES

SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: Matches whose spans are gathered in one go.
_GROUP = 64


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule in code points. The pieces between matches and the matches themselves
    alternate, so a match starts at the lengths of all that comes before it."""
    none = F.array().cast(f"array<{SPAN}>")
    pieces = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    size = lambda x: (F.char_length(x["piece"]) + F.char_length(x["hit"])).cast("bigint")

    def step(acc, x):
        at = acc["pos"] + F.char_length(x["piece"])
        end = at + F.char_length(x["hit"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        long_enough = F.char_length(x["kept"]) >= rule.min_chars
        return F.struct(end.alias("pos"), F.when(long_enough, F.concat(acc["found"], F.array(span)))
                        .otherwise(acc["found"]).alias("found"))

    zipped = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"), kept.alias("kept"))
    zipped = F.filter(zipped, lambda x: x["hit"].isNotNull())
    # a growing array is copied with every match: matches are taken in groups, each from the end of those before it
    total = lambda xs, of: F.aggregate(xs, F.lit(0).cast("bigint"), lambda n, x: n + of(x))
    parted = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _GROUP).cast("int")),
                                   lambda g: F.slice(z, g * _GROUP + 1, F.lit(_GROUP)))
    spans_of = lambda groups, sizes: F.flatten(F.transform(groups, lambda g, i: F.aggregate(
        g, F.struct(total(F.slice(sizes, F.lit(1), i), lambda n: n).alias("pos"), none.alias("found")), step, lambda acc: acc["found"])))
    found = _let(_let(zipped, parted), lambda groups: _let(
        F.transform(groups, lambda g: total(g, size)), lambda sizes: spans_of(groups, sizes)))
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan_blobs(blobs: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, tried array<string>, spans) for ``blobs`` (blob, text; one row per
    blob): each blob is scanned with the rule versions that no ledger row of it has tried."""
    ranks = {r.kind: i for i, r in enumerate(RULES)}
    if ledger is None:
        todo = blobs.select("blob", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("array<string>").alias("had"))
    else:
        had = (ledger.where(F.size("tried") > 0).select("blob", F.explode("tried").alias("t")).groupBy("blob")
               .agg(F.collect_set("t").alias("had")))   # at most one entry per rule version
        todo = blobs.select("blob", F.coalesce("text", F.lit("")).alias("text")).join(had, "blob", "left")
    parts, tried = [], []
    for r in rules:
        seen = F.coalesce(F.array_contains("had", r.key), F.lit(False))
        tried.append(F.when(~seen, F.lit(r.key)))
        found = _spans(F.col("text"), r, ranks.get(r.kind, len(RULES)))
        parts.append(found if ledger is None else F.when(seen, F.array().cast(f"array<{SPAN}>")).otherwise(found))
    out = todo.select("blob", F.array_compact(F.array(*tried)).alias("tried"),
                      F.array_sort(F.concat(*parts)).alias("spans"))
    return out.where(F.size("tried") > 0)


def scan(history: DataFrame, text_col: str, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the blobs of ``history`` that ``ledger`` lacks (append them to it)."""
    blobs = (history.select(blob_id(F.col(text_col)).alias("blob"), F.col(text_col).alias("text"))
             .dropDuplicates(["blob"]))
    return scan_blobs(blobs, rules, ledger)


def findings(history: DataFrame, text_col: str, ledger: DataFrame, keep: list[str], rules=RULES) -> DataFrame:
    """``keep`` columns of every history row with its blob and all spans of the given rule
    versions (an empty array where nothing was found), sorted by start, then rule."""
    keys = [r.key for r in rules]
    live = [k.split("@")[0] for k in keys]
    spans = (ledger.where(F.arrays_overlap("tried", F.lit(keys)) & (F.size("spans") > 0))
             .select("blob", F.explode("spans").alias("s")).where(F.col("s.kind").isin(live))
             .groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans")))
    rows = history.select(*keep, blob_id(F.col(text_col)).alias("blob"))
    return rows.join(spans, "blob", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span (sorted by start, may overlap) replaced by ``mask``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("pos"))

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
                        F.greatest(s["end"], acc["pos"]).alias("pos"))

    def finish(acc):
        return F.concat(acc["out"], F.substring(text, (acc["pos"] + 1).cast("int"), F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract of query 1 over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = durable(scan(docs, "text"))     # the ledger is a stored table; the spans are found once
    found = findings(docs, "text", ledger, ["doc_id"])
    base = of_kinds(F.col("spans"), [r.kind for r in BASE_RULES])
    n = lambda kind: F.size(of_kinds(F.col("spans"), [kind])).cast("bigint")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """DuckDB twin: positions from the lengths of the pieces before each match."""
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT rid, {rank} AS rank, '{r.kind}' AS kind, regexp_split_to_array(t, '{p}') AS pieces,
            regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {r.group}) AS kept, {r.min_chars} AS least
          FROM d WHERE regexp_matches(t, '{p}')""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
x AS (SELECT rid, rank, kind, unnest(range(1, len(hits) + 1)) AS i, pieces, hits, kept, least FROM m),
s AS (SELECT rid, rank, kind,
        list_sum(list_transform(pieces[1:i], lambda p: length(p)))
          + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS a, length(hits[i]) AS n
      FROM x WHERE length(kept[i]) >= least),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(concat(kind, ':', a::BIGINT, ':', (a + n)::BIGINT), ',' ORDER BY a, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
        string_agg(concat(kind, ':', a::BIGINT, ':', (a + n)::BIGINT), ',' ORDER BY a, rank) AS spans
      FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


SQL_SECRETS = _oracle()
