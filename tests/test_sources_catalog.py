import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tablens.functions import similarity as sim
from tablens.operators import catalog, runs, series
from tablens.sources import content, readers, sinks


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="tablens-test-")


HEADS = [(b"<!DOCTYPE html><html>", "html"), (b"<html><body>", "html"), (b"<HTML>", "html"), (b"   \n<html>", "html"),
         (b"<?xml version='1.0'?>", "xml"), (b"a,b\n1,2", "data"), (b'[{"a": 1}]', "data"), (b"PAR1\x00", "data"), (b"", "data")]


def test_content_kind(spark):
    df = spark.createDataFrame([(h,) for h, _ in HEADS], "b binary")
    assert [r[0] for r in df.select(content.content_kind(F.col("b"))).collect()] == [k for _, k in HEADS]


def test_direct_link_and_key(spark):
    urls = ["https://x.org/data/file.CSV", "https://x.org/file.csv?download=1", "https://x.org/page",
            "https://x.org/a.zip#frag", "", None, "https://x.org/dir.csv/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(content.direct_link(F.col("u"))).collect()] == [True, True, False, True, False, False, False]
    k = spark.createDataFrame([("kaggle", "owner/data set:v1")], "s string, i string")
    assert k.select(content.dataset_key(F.col("s"), F.col("i"))).first()[0] == "kaggle_owner_data_set_v1"


def test_csv_overflow_and_short_rows(spark, scratch):
    p = os.path.join(scratch, "t.csv")
    with open(p, "w") as f:
        f.write("a,b,c\n1,2,3\n4,5,6,7\n8,9\n10,11,12\n")
    df = readers.load_table(spark, p)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, 3), (8, 9, None), (10, 11, 12)]
    tsv = os.path.join(scratch, "t.tsv")
    with open(tsv, "w") as f:
        f.write("a\tb\n1\tx\n2\ty\n")
    assert readers.load_table(spark, tsv, max_rows=1, order_by="a").collect()[0]["b"] == "x"
    empty = os.path.join(scratch, "e.csv")
    with open(empty, "w") as f:
        f.write("a,b,c\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.load_table(spark, empty)
    assert readers.load_table(spark, empty, max_rows=0).count() == 0


def test_one_csv_file_is_read_by_many_tasks(spark, scratch):
    import csv
    import random

    from tablens.sources.records import records
    rng = random.Random(2)
    bits = ["a", "b c", ",", '"', "\n", "\r\n", "x" * 50, "", "é"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))) or "-", rng.random()) for i in range(900)]
    rows[300] = (300, "line\n" * 3000 + 'say "hi"', 0.5)        # crosses several ranges
    rows[301] = (301, "\n" * 4000 + "end", 0.25)
    p = os.path.join(scratch, "many.csv")
    with open(p, "w", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_MINIMAL, lineterminator="\r\n")
        w.writerow(["id", "two\nlines", "share"])
        w.writerows(rows)
    with open(p, newline="") as f:
        want = sorted((int(a), b, float(c)) for a, b, c in list(csv.reader(f))[1:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert records(spark, p).select(F.spark_partition_id().alias("p")).distinct().count() > 5
        df = readers.load_table(spark, p)
        assert df.columns == ["id", "two\nlines", "share"] and [t for _, t in df.dtypes] == ["int", "string", "double"]
        assert sorted(map(tuple, df.collect())) == want == sorted(rows)
        # several files, a stray quote in an unquoted field, text behind a closing quote, an open quote at the end
        d = os.path.join(scratch, "several")
        os.makedirs(d)
        for i in range(3):
            with open(os.path.join(d, f"{i}.csv"), "w", newline="") as f:
                f.write(f'k,v\n{i}0,5" pipe\n{i}1,"two\nlines" more\n{i}2,plain\n' + (f'{i}3,"open\nto the end' if i == 2 else ""))
        got = sorted(map(tuple, readers.load_table(spark, d, fmt="csv").collect()))
        assert [k for k, _ in got] == [0, 1, 2, 10, 11, 12, 20, 21, 22, 23]
        assert got[0][1] == '5" pipe' and got[2][1] == "plain" and got[-1][1] == "open\nto the end"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_documents(spark, scratch):
    p1 = os.path.join(scratch, "list.json")
    with open(p1, "w") as f:
        f.write('[{"a": 1, "n": {"x": 2, "y": {"z": 3}}}, {"a": 4, "n": {"x": 5, "y": {"z": 6}}}]')
    d1 = readers.read_json(spark, p1)
    assert sorted(d1.columns) == ["a", "n.x", "n.y.z"] and d1.count() == 2
    p2 = os.path.join(scratch, "obj.json")
    with open(p2, "w") as f:
        f.write('{"meta": {"v": 1}, "data": [{"a": 1}, {"a": 2}, {"a": 3}]}')
    d2 = readers.read_json(spark, p2)
    assert d2.columns == ["a"] and d2.count() == 3


def test_json_layouts(spark, scratch):
    def read(name, text):
        p = os.path.join(scratch, name)
        with open(p, "w") as f:
            f.write(text)
        return readers.read_json(spark, p)
    cols = read("cols.json", '{"b": [3, 4], "a": [1, 2]}')
    assert cols.columns == ["b", "a"] and sorted(map(tuple, cols.collect())) == [(3, 1), (4, 2)]
    keyed = read("keyed.json", '{"b": {"0": 3, "1": 4}, "a": {"0": 1, "1": 2}}')
    assert keyed.columns == ["b", "a"] and sorted(map(tuple, keyed.collect())) == [(3, 1), (4, 2)]
    first = read("first.json", '{"results": [{"x": 1}, {"x": 2}], "facets": [{"y": 9}]}')
    assert first.columns == ["x"] and first.count() == 2
    assert read("one.json", '{"z": 1, "n": {"m": "t"}}').columns == ["z", "n.m"]


def test_csv_quoting_round_trip(spark, scratch):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines, here"), (3, " blanks "), (4, None), (5, 'ends with "'), (6, "back\\slash")]
    path = os.path.join(scratch, "quoted")
    sinks.write_csv(spark.createDataFrame(rows, "id int, t string"), path)
    assert sorted(map(tuple, readers.load_table(spark, path, fmt="csv").collect())) == rows
    raw = os.path.join(scratch, "raw.csv")
    with open(raw, "w") as f:
        f.write('a,b\n1,"say ""hi"", ok"\n2,"x\ny"\n3,p,q\n')
    assert sorted(map(tuple, readers.load_table(spark, raw).collect())) == [(1, 'say "hi", ok'), (2, "x\ny")]


def test_similarity():
    assert sim.lcs_len("abcde", "ace") == 3
    assert sim.token_set_ratio("climate data", "global climate data set") == 100.0
    assert sim.ratio("abc", "abc") == 100.0 and sim.partial_ratio("abc", "xxabcxx") == 100.0
    assert 0 < sim.token_set_ratio("weather", "whether") < 100


def test_search_equals_brute_force(spark):
    entries = spark.createDataFrame([
        ("s1", "1", "Climate data", "global temperatures", "", "", "", ["weather"], 1),
        ("s1", "2", "Sales", "climate-related sales", "", "", "", [], 2),
        ("s2", "3", "Bioclimate", "plants", "", "", "", ["eco"], 3),
        ("s2", "4", "Other", "nothing here", "", "", "", ["Climate"], 4)], catalog.ENTRY)
    qs = spark.createDataFrame([(1, "climate"), (2, "te data"), (3, "x"), (4, "mate d")], "qid long, query string")
    got = {(r["qid"], r["dataset_id"]) for r in catalog.search(qs, entries).collect()}
    brute = set()
    for e in entries.collect():
        s = " ".join([e["name"], e["description"], " ".join(e["tags"])]).lower()
        for q in qs.collect():
            if len(q["query"].strip()) >= 2 and q["query"].lower() in s:
                brute.add((q["qid"], e["dataset_id"]))
    assert got == brute and (1, "3") in got and (4, "1") in got


def test_rank_dedup_suggest(spark):
    res = spark.createDataFrame([
        (1, "climate data", "s1", "1", "Climate Data", "climate data for all", "", "", "", ["climate"], 1),
        (1, "climate data", "s2", "2", "climate data", "copy", "", "", "", [], 2),
        (1, "climate data", "s2", "3", "Traffic", "cars", "", "", "", [], 3)],
        "qid long, query string, " + catalog.ENTRY)
    ranked = catalog.rank(res)
    kept = [r["dataset_id"] for r in catalog.dedup(ranked).orderBy("rank").collect()]
    assert kept == ["1", "3"]
    hist = spark.createDataFrame([("Climate", "2024-01-01 00:00:00"), ("climbing", "2024-01-03 00:00:00"),
                                  ("Climate", "2024-01-05 00:00:00"), ("Cars", "2024-01-02 00:00:00")],
                                 "query string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    assert [r["query"] for r in catalog.suggest(hist, " cl").collect()] == ["Climate", "climbing"]
    assert catalog.suggest(hist, "c").count() == 0


def test_runs_store(spark, scratch):
    store = runs.RunStore(spark, os.path.join(scratch, "runs"))
    for i in range(2):
        store.save({"id": f"r{i}", "title": f"t{i}", "num_rows": 10, "analysis_config": {"k": 3}},
                   [{"chart_type": "scatter", "title": "a", "plotly_json": "{}"},
                    {"chart_type": "bar", "title": "b", "plotly_json": "{}"}])
    got = store.get("r1").first()
    assert [c["chart_type"] for c in got["charts"]] == ["scatter", "bar"]
    assert store.list().count() == 2
    assert store.delete("r0") and not store.delete("nope")
    assert [r["id"] for r in store.list().collect()] == ["r1"] and store.charts().count() == 2


def test_two_writers_lose_no_run(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor

    from tablens.operators.commits import Conflict
    root = os.path.join(scratch, "runs-two")
    stores = [runs.RunStore(spark, root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: stores[i].save({"id": f"r{i}", "title": "t"}, [{"chart_type": "bar", "title": "b", "plotly_json": "{}"}]), range(4)))
    assert sorted(r["id"] for r in stores[0].list().collect()) == ["r0", "r1", "r2", "r3"] and stores[1].charts().count() == 4
    log = stores[0].log
    assert log.version() == 4
    with pytest.raises(Conflict):
        log.commit(4, {})
    # rows that were written but never committed are not seen; a delete is one entry, an older version is still there, a key can come back
    log.part("runs", spark.createDataFrame([{"id": "lost"}], runs.RUN))
    assert stores[2].delete("r1") and stores[3].runs().count() == 3 and log.read("runs", 4).count() == 4
    assert log.entries()[-1][1]["deletes"] == {"runs": ["r1"], "charts": ["r1"]}
    stores[0].save({"id": "r1", "title": "again"}, [])
    assert stores[0].get("r1").first()["title"] == "again" and stores[0].charts().count() == 3


def test_ticket_store_applies_a_batch_once(spark, scratch):
    from tablens.operators.tickets import TicketStore
    store = TicketStore(spark, os.path.join(scratch, "tickets"))
    new = spark.createDataFrame([("A", None, None, None), ("B", "x", "high", ["t"])], "title string, description string, priority string, tags array<string>")
    assert store.append(new, "2024-01-01 00:00:00", ("load", 1)) and not store.append(new, "2024-01-02 00:00:00", ("load", 1))
    assert sorted((r["id"], r["title"], r["status"]) for r in store.read().collect()) == [(1, "A", "open"), (2, "B", "open")]
    change = spark.createDataFrame([(2, "solved"), (9, "open")], "id long, status string")
    assert store.apply(change, "2024-02-01 00:00:00", batch=("changes", 0))
    # reopened by the next batch; replays of both change nothing
    assert store.apply(spark.createDataFrame([(2, "open")], "id long, status string"), "2024-03-01 00:00:00", batch=("changes", 1))
    for n, day in ((0, "2024-04-01"), (1, "2024-04-02")):
        assert not store.apply(change, f"{day} 00:00:00", batch=("changes", n))
    row = store.read().where("id = 2").first()
    assert row["status"] == "open" and row["solved_at"] is None and str(row["updated_at"]) == "2024-03-01 00:00:00"
    assert store.delete([2]) and [r["id"] for r in store.read().collect()] == [1]
    assert store.append(new, "2024-05-01 00:00:00") and sorted(r["id"] for r in store.read().collect()) == [1, 3, 4]     # no id is given twice


def test_ticket_changes_from_a_restarted_stream_apply_once(spark, scratch):
    from tablens.operators.tickets import SCHEMA, TicketStore
    store, source = TicketStore(spark, os.path.join(scratch, "t2")), os.path.join(scratch, "t2-changes")
    store.append(spark.createDataFrame([("A", None, None, None)], "title string, description string, priority string, tags array<string>"), "2024-01-01 00:00:00")
    spark.createDataFrame([(1, "solved")], "id long, status string").coalesce(1).write.parquet(source)
    for attempt in range(2):       # another checkpoint: the source's batch 0 is delivered again
        q = spark.readStream.schema("id long, status string").parquet(source).writeStream.foreachBatch(
            lambda df, n: store.apply(df, f"2024-02-0{attempt + 1} 00:00:00", batch=("stream", n))).option(
            "checkpointLocation", os.path.join(scratch, f"t2-ckpt{attempt}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert str(store.read().first()["solved_at"]) == "2024-02-01 00:00:00" and store.log.version() == 2 and SCHEMA


def test_series_sample_is_stable(spark):
    rows = spark.createDataFrame([(i, float(i), float(-i), i % 3, int(i % 50 == 0)) for i in range(5000)],
                                 "id long, pc1 double, pc2 double, cluster int, anomaly int")
    a = {r["id"] for r in series.scatter_2d(rows, "id", 2000).collect()}
    b = {r["id"] for r in series.scatter_2d(rows.repartition(7), "id", 2000).collect()}
    assert a == b and len(a) == 2000
    assert series.scatter_2d(rows, "id").count() == 5000
    ov = series.anomaly_overlay(rows, "id", 2000)
    assert ov.count() == 2000 and ov.where("anomaly = 1").count() == 100
    assert series.anomaly_overlay(rows, "id", 100).count() == series.anomaly_overlay(rows, "id").count() == 5000


def _json(scratch, name, text):
    p = os.path.join(scratch, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_normalizers(spark, scratch):
    ckan = _json(scratch, "ckan.json", """[
      {"id": "p1", "title": "T1", "notes": "n", "tags": [{"name": "a"}, {"name": "b"}],
       "resources": [{"format": "", "url": "https://x.org/page"}, {"format": "json", "url": "https://x.org/d.json"},
                     {"format": "CSV", "url": "https://x.org/d.csv"}]},
      {"id": "p2", "title": "T2", "notes": null, "tags": [], "resources": [{"format": "CSV", "url": "https://x.org/landing"}]}]""")
    pk = spark.read.option("multiLine", True).json(ckan)
    first = {r["dataset_id"]: r for r in catalog.normalize_ckan(pk).collect()}
    assert list(first) == ["p1"] and first["p1"]["url"].endswith("d.json") and first["p1"]["format"] == "JSON"
    assert catalog.normalize_ckan(pk, prefer="csv").first()["url"].endswith("d.csv")
    hub = _json(scratch, "hub.json", """[{"id": "org/name", "description": "d", "tags": ["x"], "downloads": 7, "cardData": {}},
      {"id": "solo", "description": null, "tags": [], "downloads": 0, "cardData": {"dataset_size": "1GB"}}]""")
    h = {r["dataset_id"]: r for r in catalog.normalize_hub(spark.read.option("multiLine", True).json(hub)).collect()}
    assert h["org/name"]["name"] == "name" and h["org/name"]["size"] == "7 downloads" and h["solo"]["size"] == "1GB"
    om = _json(scratch, "openml.json", """[{"did": 61, "name": "iris", "quality": [{"name": "NumberOfInstances", "value": "150.0"},
      {"name": "NumberOfFeatures", "value": "5.0"}]}, {"did": 2, "name": "x", "quality": []}]""")
    o = {r["dataset_id"]: r for r in catalog.normalize_openml(spark.read.option("multiLine", True).json(om)).collect()}
    assert o["61"]["size"] == "150 rows × 5 cols" and o["2"]["size"] == ""
    so = _json(scratch, "socrata.json", """[{"resource": {"id": "ab-cd", "name": "S", "description": "d", "columns_field_name": ["c1"]},
      "metadata": {"domain": "data.city.gov"}, "classification": {"categories": ["Health"]}}]""")
    s = catalog.normalize_socrata(spark.read.option("multiLine", True).json(so)).first()
    assert s["url"] == "https://data.city.gov/resource/ab-cd.csv?$limit=50000" and s["tags"] == ["Health"]
    ze = _json(scratch, "zenodo.json", """[{"id": 9, "metadata": {"title": "Z", "description": "<p>Hi <b>there</b></p>", "keywords": ["k"]},
      "files": [{"key": "a.csv", "size": 3000000}, {"key": "b.json", "size": 10}]},
      {"id": 10, "metadata": {"title": "N", "description": ""}, "files": [{"key": "a.pdf", "size": 5}]}]""")
    z = catalog.normalize_zenodo(spark.read.option("multiLine", True).json(ze)).collect()
    assert len(z) == 1 and z[0]["description"] == "Hi there" and z[0]["format"] == "CSV, JSON" and z[0]["size"] == "2.9 MB"


def test_file_gate_and_largest(spark, scratch):
    d = os.path.join(scratch, "folder")
    os.makedirs(os.path.join(d, "a"))
    for name, size in (("a/x.csv", 10), ("a/y.csv", 30), ("a/z.json", 99), ("a/e.parquet", 0), ("a/n.txt", 5)):
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"x" * size)
    inv = {os.path.basename(r["path"]): r for r in content.file_inventory(spark, d, max_bytes=50).collect()}
    assert inv["y.csv"]["ok"] and inv["z.json"]["reason"] == "too large"
    assert "e.parquet" not in inv or inv["e.parquet"]["reason"] == "empty file"   # listing may drop empty files
    assert inv["n.txt"]["reason"] == "unsupported type"
    best = content.largest_per_folder(content.file_inventory(spark, d)).collect()
    assert [os.path.basename(r["path"]) for r in best] == ["y.csv"]      # csv first, then the largest


def test_federate_and_order(spark):
    ok = lambda: spark.createDataFrame([("s", "1", "b", "", "", "", "", [], 1)], catalog.ENTRY)
    bad = lambda: spark.read.json("/nonexistent/path/x.json")
    out, failed = catalog.federate({"good": ok, "bad": bad})
    assert out.count() == 1 and failed == ["bad"]
    res = spark.createDataFrame([("Beta", 1), ("alpha", 2)], "name string, rank int")
    assert [r["name"] for r in catalog.order_results(res, "name").collect()] == ["alpha", "Beta"]


def test_exchange_rows(spark):
    from tablens.operators import chat
    ex = spark.createDataFrame([("s", "Some Feedback here", "thanks", 1), ("s", "hi", "hello", 2)],
                               "session_id string, user_text string, reply_text string, created_at int")
    rows = chat.exchange_rows(ex).collect()
    assert len(rows) == 4 and [r["is_feedback"] for r in rows if r["created_at"] == 1] == [True, True]
