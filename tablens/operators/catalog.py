"""Dataset catalogue (S1-S12, T3, A8, W3): portal dumps normalised to one schema, search,
per-source cut, relevance ranking, near-duplicate removal, search history suggestions.

Search is an exact substring match found through a *blocking* equi join instead of a
cross join: a word of the query that is bounded by non-word characters inside the query
must appear as a whole word of every text that contains the query, so the query is
joined on its longest such word (or, without one, on its first two characters against
the entries' character pairs) and each candidate is then verified with ``instr``.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import relevance_udf, token_set_ratio
from ..sources.content import direct_link

ENTRY = ("source string, dataset_id string, name string, description string, url string, size string, "
         "format string, tags array<string>, pos long")
# Fixed values of the catalogue rules.
PER_SOURCE = 5
DEDUP_THRESHOLD = 85
QUERY_MIN, QUERY_MAX = 2, 200
SUGGEST_MIN, SUGGEST_LIMIT = 2, 5
WORD_SPLIT = r"[^\p{L}\p{N}_]+"
ZENODO_FORMATS = ("CSV", "JSON", "PARQUET", "XLSX", "TSV")


def _entry(source, dataset_id, name, description, url, size, fmt, tags, pos) -> list[Column]:
    return [source.alias("source"), dataset_id.cast("string").alias("dataset_id"), name.alias("name"),
            description.alias("description"), url.alias("url"), size.alias("size"), fmt.alias("format"),
            tags.alias("tags"), pos.alias("pos")]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _pos(df: DataFrame) -> Column:
    """The caller's place of each entry in its file (``pos``), where there is one."""
    return F.col("pos").cast("long") if "pos" in df.columns else F.lit(None).cast("long")


def normalize_ckan(packages: DataFrame, prefer: str = "first") -> DataFrame:
    """One row per package (``result.results`` exploded beforehand). The resource is the
    first direct link in list order (``prefer='csv'``: a CSV link first if any); no direct
    link -> package skipped."""
    links = F.filter("resources", lambda r: direct_link(r["url"]))
    csv = F.filter(links, lambda r: F.upper(F.coalesce(r["format"], F.lit(""))) == "CSV")
    pick = F.try_element_at(links, F.lit(1)) if prefer == "first" else \
        F.coalesce(F.try_element_at(csv, F.lit(1)), F.try_element_at(links, F.lit(1)))
    fmt = F.upper(F.coalesce(pick["format"], F.lit("")))
    return packages.where(F.size(links) > 0).select(*_entry(
        F.lit("data.gov"), F.col("id"), F.coalesce(F.col("title"), F.lit("Untitled")), _text(F.col("notes")),
        pick["url"], F.lit(""), F.when(fmt == "", "CSV").otherwise(fmt),
        F.transform(F.coalesce(F.col("tags"), F.array()), lambda t: t["name"]),
        _pos(packages)))


def normalize_hub(ds: DataFrame) -> DataFrame:
    """S3: name after the last '/', size = card ``dataset_size`` else '<n> downloads'."""
    size = F.when(~F.coalesce(F.col("cardData.dataset_size").cast("string"), F.lit("")).isin("", "0"), F.col("cardData.dataset_size").cast("string")) \
        .when(F.coalesce(F.col("downloads"), F.lit(0)) != 0, F.concat(F.col("downloads").cast("string"), F.lit(" downloads"))) \
        .otherwise("")
    return ds.select(*_entry(F.lit("huggingface"), F.col("id"), F.element_at(F.split("id", "/"), -1),
                             _text(F.col("description")), F.concat(F.lit("https://huggingface.co/datasets/"), F.col("id")),
                             size, F.lit("parquet"), F.coalesce("tags", F.array()),
                             _pos(ds)))


def normalize_kaggle(ds: DataFrame) -> DataFrame:
    """Listing rows (ref, title, subtitle, size)."""
    return ds.select(*_entry(F.lit("kaggle"), F.col("ref"), F.coalesce("title", "ref"), _text(F.col("subtitle")),
                             F.concat(F.lit("https://www.kaggle.com/datasets/"), F.col("ref")),
                             F.coalesce(F.col("size").cast("string"), F.lit("")), F.lit("CSV"),
                             F.array().cast("array<string>"), _pos(ds)))


def normalize_openml(ds: DataFrame) -> DataFrame:
    """The quality list gives '<rows> rows × <cols> cols'."""
    q = F.map_from_entries(F.transform(F.coalesce("quality", F.array()), lambda x: F.struct(x["name"], x["value"])))
    rows, cols = F.try_element_at(q, F.lit("NumberOfInstances")), F.try_element_at(q, F.lit("NumberOfFeatures"))
    size = F.when((F.coalesce(rows, F.lit("")) != "") & (F.coalesce(cols, F.lit("")) != ""),
                  F.concat(rows.cast("double").cast("long").cast("string"), F.lit(" rows × "),
                           cols.cast("double").cast("long").cast("string"), F.lit(" cols"))).otherwise("")
    did = F.col("did").cast("string")
    return ds.select(*_entry(F.lit("openml"), did, F.coalesce("name", F.lit("Untitled")),
                             F.concat(F.lit("OpenML dataset #"), did), F.concat(F.lit("https://www.openml.org/d/"), did),
                             size, F.lit("parquet"), F.array().cast("array<string>"), _pos(ds)))


def normalize_socrata(items: DataFrame) -> DataFrame:
    """CSV export URL from the domain; categories replace column names as tags."""
    rid, dom = F.col("resource.id"), F.col("metadata.domain")
    url = F.when(F.coalesce(dom, F.lit("")) != "", F.concat(F.lit("https://"), dom, F.lit("/resource/"), rid,
                                                           F.lit(".csv?$limit=50000"))).otherwise("")
    cats = F.coalesce(F.col("classification.categories"), F.array())
    tags = F.when(F.size(cats) > 0, cats).otherwise(
        F.coalesce(F.col("resource.columns_field_name"), F.array()))
    return items.select(*_entry(F.lit("socrata"), rid, F.coalesce(F.col("resource.name"), F.lit("Untitled")),
                                _text(F.col("resource.description")), url, F.lit(""), F.lit("CSV"), tags,
                                _pos(items)))


def normalize_zenodo(hits: DataFrame) -> DataFrame:
    """HTML tags stripped; total file size as KB/MB text; formats from file suffixes;
    records without a data file are skipped."""
    files = F.coalesce(F.col("files"), F.array())
    total = F.aggregate(files, F.lit(0).cast("long"), lambda acc, f: acc + F.coalesce(f["size"], F.lit(0)).cast("long"))
    size = F.when(total > 1024 * 1024, F.format_string("%.1f MB", total / 1024 / 1024)) \
        .when(total > 1024, F.format_string("%.0f KB", total / 1024)).otherwise("")
    exts = F.array_distinct(F.transform(F.filter(files, lambda f: F.instr(f["key"], ".") > 0),
                                        lambda f: F.upper(F.element_at(F.split(f["key"], r"\."), -1))))
    data = F.array_sort(F.array_intersect(exts, F.array(*[F.lit(x) for x in ZENODO_FORMATS])))
    rid = F.col("id").cast("string")
    out = hits.select(*_entry(F.lit("zenodo"), rid, F.coalesce(F.col("metadata.title"), F.lit("Untitled")),
                              _text(F.regexp_replace(F.coalesce(F.col("metadata.description"), F.lit("")), "<[^>]+>", "")),
                              F.concat(F.lit("https://zenodo.org/records/"), rid), size,
                              F.array_join(data, ", "), F.coalesce(F.col("metadata.keywords"), F.array()),
                              _pos(hits)))
    return out.where(F.col("format") != "")


def normalize_registry(ds: DataFrame) -> DataFrame:
    """S6 (rows): open-data registry NDJSON (Name, Description, Tags, Slug); slug defaults to
    the name with spaces as '-' in lower case."""
    slug = F.coalesce(F.col("Slug"), F.lower(F.regexp_replace(F.coalesce("Name", F.lit("")), " ", "-")))
    return ds.select(*_entry(F.lit("aws"), slug, F.coalesce("Name", F.lit("")), _text(F.col("Description")),
                             F.concat(F.lit("https://registry.opendata.aws/roda/"), slug, F.lit("/")), F.lit(""),
                             F.lit("varies"), F.coalesce("Tags", F.array()),
                             _pos(ds)))


# ------------------------------------------------------------------ search
def valid_query(q: Column) -> Column:
    """Trimmed length 2-200."""
    n = F.length(F.trim(q))
    return (n >= QUERY_MIN) & (n <= QUERY_MAX)


def _searchable(e: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")),
                               F.array_join(F.coalesce("tags", F.array()), " ")))


def search(queries: DataFrame, entries: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """(qid, query, entry columns...): entries whose name + description + tags contain the
    query (case-blind), the first ``per_source`` per (query, source) by ``pos``, then id."""
    q = queries.where(valid_query(F.col("query"))).select("qid", "query", F.lower("query").alias("__q"))
    toks = F.filter(F.split(F.col("__q"), WORD_SPLIT), lambda t: t != "")
    n = F.size(toks)
    starts_word = F.substring("__q", 1, 1).rlike(r"[\p{L}\p{N}_]")
    ends_word = F.substring("__q", -1, 1).rlike(r"[\p{L}\p{N}_]")
    lo = F.when(starts_word, 2).otherwise(1)
    hi = F.when(ends_word, n - 1).otherwise(n)
    complete = F.when(hi >= lo, F.slice(toks, lo, F.greatest(hi - lo + 1, F.lit(0)))).otherwise(F.array())
    longest = F.try_element_at(F.array_sort(F.transform(complete, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))),
                               F.lit(1))
    q = q.withColumn("__word", longest["t"]).withColumn("__pair", F.substring("__q", 1, 2))
    key = ["source", "dataset_id", "pos"]
    e = entries.withColumn("__s", _searchable(entries))
    # only keys and words are exploded and joined; texts are read again for the few hits
    words = F.array_distinct(F.filter(F.split("__s", WORD_SPLIT), lambda t: t != ""))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("__s") - 1, F.lit(1))), lambda i: F.substring("__s", i, 2)))
    by_word = e.select(*key, F.explode(words).alias("__k")).join(q.where("__word is not null"), F.col("__word") == F.col("__k"))
    by_pair = e.select(*key, F.explode(pairs).alias("__k")).join(q.where("__word is null"), F.col("__pair") == F.col("__k"))
    hits = by_word.unionByName(by_pair).select("qid", "query", "__q", *[F.col(c).alias(f"__{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    hits = e.join(hits, same).where(F.instr("__s", F.col("__q")) > 0)
    w = Window.partitionBy("qid", "source").orderBy(F.col("pos").asc_nulls_last(), "dataset_id")
    return hits.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_source) \
        .select("qid", "query", *entries.columns)


def provider_activity(results: DataFrame) -> DataFrame:
    """(qid, source, results) for sources with at least one result."""
    return results.groupBy("qid", "source").agg(F.count(F.lit(1)).alias("results"))


# ------------------------------------------------------------------ rank and dedup
def rank(results: DataFrame) -> DataFrame:
    """Relevance score per (query, result) in a vectorised UDF, then per-query order."""
    scored = results.withColumn("score", relevance_udf(F.col("query"), F.col("name"), F.col("description"), F.col("tags")))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("source"), F.col("pos"))
    return scored.withColumn("rank", F.row_number().over(w))


def dedup(ranked: DataFrame, threshold: int = DEDUP_THRESHOLD) -> DataFrame:
    """Walking each query's results by rank, drop one whose name has token-set ratio
    >= threshold with any kept name. A query's list is the per-source cut (bounded)."""
    schema = ranked.schema

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        kept, names = [], []
        for i, nm in zip(pdf.index, pdf["name"]):
            low = (nm or "").lower()
            if not any(token_set_ratio(low, k) >= threshold for k in names):
                kept.append(i)
                names.append(low)
        return pdf.loc[kept]

    return ranked.groupBy("qid").applyInPandas(keep, schema)


# ------------------------------------------------------------------ history
def suggest(history: DataFrame, prefix: str, limit: int = SUGGEST_LIMIT) -> DataFrame:
    """Distinct past queries starting with ``prefix`` (case-blind), newest use first.
    The prefix needs at least two characters after trimming; ``%``/``_`` are literal."""
    p = prefix.strip()
    if len(p) < SUGGEST_MIN:
        return history.sparkSession.createDataFrame([], "query string, last_used timestamp")
    hit = history.where(F.lower("query").startswith(p.lower()))
    return hit.groupBy("query").agg(F.max("created_at").alias("last_used")) \
        .orderBy(F.col("last_used").desc(), F.col("query")).limit(limit)


def record_search(history_path: str, searches: DataFrame) -> None:
    """Append (query, result_count, created_at) rows to the history table."""
    searches.select("query", "result_count", F.coalesce(F.col("created_at"), F.current_timestamp()).alias("created_at")) \
        .write.mode("append").parquet(history_path)


def order_results(results: DataFrame, by: str = "rank") -> DataFrame:
    """T4: results by name (case-blind) or by rank."""
    if by == "name":
        return results.orderBy(F.lower("name"), "rank")
    return results.orderBy("rank")


def federate(providers: dict) -> tuple[DataFrame | None, list[str]]:
    """Union (by name) of every provider's normalised result; a provider whose read or
    normalisation fails is left out. ``providers`` maps a name to a zero-argument callable
    returning its DataFrame. Returns (union or None, names that failed)."""
    out, failed = None, []
    for name, make in providers.items():
        try:
            df = make()
            df.schema  # noqa: B018 - forces analysis so a bad source fails here
        except Exception:  # noqa: BLE001 - a failing provider is skipped, as in a fan-out search
            failed.append(name)
            continue
        out = df if out is None else out.unionByName(df)
    return out, failed
