from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablens.operators import chat, joins, labels, tickets, wording

NOW = "2024-05-01 12:00:00"


@pytest.fixture()
def tix(spark):
    new = spark.createDataFrame([("Low one", None, "low", None), ("Crit", "d", "critical", ["ui"]),
                                 ("High", "", "high", ["ui", "db"])],
                                "title string, description string, priority string, tags array<string>")
    return tickets.append(None, new, NOW)


def test_append_order_stats(spark, tix):
    rows = {r["id"]: r for r in tix.collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1]["status"] == "open" and rows[1]["tags"] == []
    order = [r["id"] for r in tickets.ordered(tix).orderBy("position").collect()]
    assert order == [2, 3, 1]                                     # critical > high > low
    solved = tickets.apply_changes(tix, spark.createDataFrame([(2, "solved")], "id long, status string"), NOW)
    st = {(r["dimension"], r["value"]): r["count"] for r in tickets.stats(solved).collect()}
    assert st[("total", None)] == 3 and st[("status", "open")] == 2 and st[("status", "solved")] == 1
    assert tickets.list_tickets(tix, tag="ui").count() == 2
    assert [r["id"] for r in tickets.list_tickets(tix, status="open", priority="high", tag="db").collect()] == [3]


def test_apply_changes_rules(spark, tix):
    ch1 = spark.createDataFrame([(1, "solved", None), (99, "open", None)], "id long, status string, title string")
    t1 = tickets.apply_changes(tix, ch1, "2024-06-01 00:00:00")
    r = {x["id"]: x for x in t1.collect()}
    assert r[1]["status"] == "solved" and r[1]["solved_at"] == datetime(2024, 6, 1)
    assert r[2]["updated_at"] == datetime(2024, 5, 1, 12) and 99 not in r     # untouched / unknown ignored
    t2 = tickets.apply_changes(t1, spark.createDataFrame([(1, "open")], "id long, status string"), "2024-07-01 00:00:00")
    assert t2.where("id = 1").first()["solved_at"] is None                 # reopening clears it


def test_delete_reports_existing(spark, tix):
    remaining, gone = tickets.delete(tix, spark.createDataFrame([(1,), (42,)], "id long"))
    assert sorted(r["id"] for r in remaining.collect()) == [2, 3]
    assert [r["id"] for r in gone.collect()] == [1]


def test_invalid_ticket_fails(spark):
    bad = spark.createDataFrame([("x", None, "urgent", None)], "title string, description string, priority string, tags array<string>")
    with pytest.raises(Exception, match="invalid ticket"):
        tickets.append(None, bad, NOW).collect()


@pytest.mark.parametrize("title,desc,want_t,want_d", [
    ("the login page crashes", "it   is broken ,really", "Fix login page crashes", "It is broken, really."),
    ("Address form layout.", "", "Address form layout", ""),
    ("we need to speed things up", "page is slow", "Add speed things up", "Page is slow."),     # "need" comes before "speed"
    ("dashboard", "nothing", "Implement dashboard", "Nothing."),
    ("Fix  typo .", "done!", "Fix typo", "Done!"),
])
def test_cleanup(spark, title, desc, want_t, want_d):
    df = spark.createDataFrame([(1, title, desc)], "id long, title string, description string")
    r = wording.tidy(df).first()
    assert (r["title"], r["description"]) == (want_t, want_d)
    prev = {x["field"] for x in wording.changes(df).collect()}
    assert prev == {f for f, a, b in (("title", title, want_t), ("description", desc, want_d)) if a != b}


def test_chat_flags_transcripts_context(spark):
    rows = [("s1", 1, "user", "hello"), ("s1", 2, "assistant", "hi"), ("s1", 3, "user", "FEEDBACK: nice"),
            ("s1", 4, "assistant", "thanks"), ("s2", 1, "user", "q"), ("s2", 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "session_id string, created_at int, role string, content string")
    f = chat.flag_feedback(df)
    flags = {(r["session_id"], r["created_at"]): r["is_feedback"] for r in f.collect()}
    assert flags[("s1", 3)] and flags[("s1", 4)] and not flags[("s1", 1)] and not flags[("s2", 2)]
    assert {r["session_id"] for r in chat.feedback_transcripts(f).collect()} == {"s1"}
    assert chat.last_messages(df, n=2).where("session_id = 's1'").count() == 2


def test_session_id_validity(spark):
    ids = ["12345678-1234-5678-1234-567812345678", "{12345678123456781234567812345678}",
           "urn:uuid:12345678-1234-5678-1234-567812345678", "not-a-uuid", ""]
    df = spark.createDataFrame([(i,) for i in ids], "s string")
    assert [r[0] for r in df.select(chat.valid_session_id(F.col("s"))).collect()] == [True, True, True, False, False]


REPLIES = [
    ('{"overview": "o", "clusters": [{"id": 0, "label": "L", "description": "D"}], "quality": "q"}', 1),
    ('```json\n{"overview": "o", "clusters": [], "quality": "q"}\n```', 0),
    ('```\n{"overview": "o", "clusters": [], "quality": "q"}\n```', 0),
    ("not json", None),
    ('{"overview": "o", "quality": "q"}', None),
    ('{"overview": 5, "clusters": [], "quality": "q"}', None),
    ('{"overview": "o", "clusters": [{"id": 1, "label": "x"}, 3, {"id": 2, "label": "y", "description": "z"}], "quality": "q"}', 1),
    ("[1, 2]", None),
]


def test_parse_replies(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, raw string")
    got = {r["i"]: r for r in labels.parse_replies(df).collect()}
    for i, (_, n) in enumerate(REPLIES):
        if n is None:
            assert got[i]["overview"] is None and got[i]["clusters"] is None
        else:
            assert len(got[i]["clusters"]) == n and got[i]["quality"] == "q"
    assert got[6]["clusters"][0]["id"] == 2


def test_merge_labels_and_band(spark):
    prof = spark.createDataFrame([(0, 40, 40.0), (1, 35, 35.0), (2, 25, 25.0)], "cluster_id int, size long, percentage double")
    lab = spark.createDataFrame([(0, "A", "da"), (1, "", ""), (7, "X", "dx")], "id int, label string, description string")
    got = {r["id"]: (r["label"], r["description"]) for r in labels.merge_labels(prof, lab).collect()}
    assert got == {0: ("A", "da"), 1: ("Cluster 1", "No description available."), 2: ("Cluster 2", "No description available.")}
    bands = spark.createDataFrame([(0.1,), (0.3,), (0.6,), (0.9,), (None,)], "s double") \
        .select(labels.quality_band(F.col("s"))).collect()
    assert [r[0] for r in bands] == ["poor", "fair", "good", "excellent", None]


def test_joins(spark):
    left = spark.createDataFrame([(i, f"l{i}") for i in range(6000)], "key int, val_left string")
    right = spark.createDataFrame([(i % 6000, f"r{i}") for i in range(12000)], "key int, val_right string")
    assert joins.join_two(left, right, "key", "inner", "right").count() == 12000
    a = spark.createDataFrame([(1, "x"), (None, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "id int, v string")
    out = joins.join_two(a, b, "id", "outer", "B")
    assert out.columns == ["id", "v", "v_B"] and out.count() == 4      # null keys match nothing
    assert joins.join_two(a, b, "id", "outer", "B", match_nulls=True).count() == 3
    with pytest.raises(ValueError, match="nonexistent"):
        joins.join_two(a, b, "nonexistent", "inner", "B")
    shared = joins.shared_columns([("A", a), ("B", b)])
    assert shared[0]["shared_columns"] == ["id", "v"]


def test_flags_with_gaps_in_the_order(spark):
    rows = [(s, t * t + s, ["user", "assistant"][t % 2], ("feedback " if (s + t) % 3 == 0 else "") + "x")
            for s in range(4) for t in range(s * 7 + 3)]
    df = spark.createDataFrame(rows, "session_id int, created_at int, role string, content string")
    want, prev = set(), None
    for s, t, role, text in sorted(rows):
        hit = role == "user" and "feedback" in text
        flag = hit if role == "user" else prev is not None and prev[0] == s and prev[1] == "user" and prev[2]
        want.add((s, t, flag))
        prev = (s, role, hit)
    assert {(r[0], r[1], r["is_feedback"]) for r in chat.flag_feedback(df).collect()} == want
    last = chat.last_messages(df, n=5)
    assert last.count() == sum(min(5, s * 7 + 3) for s in range(4))


def test_bad_tickets_and_repeated_changes(spark, tix):
    import pytest as pt
    with pt.raises(Exception, match="invalid ticket"):
        tickets.apply_changes(tix, spark.createDataFrame([(1, "bogus")], "id long, status string"), NOW).collect()
    twice = spark.createDataFrame([(1, 1, "solved", None), (1, 2, None, "low"), (1, 3, "open", None)],
                                  "id long, at int, status string, priority string")
    with pt.raises(Exception, match="changed twice"):
        tickets.apply_changes(tix, twice, NOW).collect()
    got = tickets.apply_changes(tix, twice, NOW, order="at")
    assert got.count() == tix.count() and tuple(got.where("id = 1").select("status", "priority").first()) == ("open", "low")
    no_title = spark.createDataFrame([(None, "", "low", [])], "title string, description string, priority string, tags array<string>")
    with pt.raises(Exception, match="invalid ticket"):
        tickets.append(None, no_title, NOW).collect()
    assert tickets.get(tix, 2).count() == 1 and tickets.get(tix, 99).count() == 0


def test_repeated_labels_need_an_order(spark):
    import pytest as pt
    prof = spark.createDataFrame([(0, 4, 100.0)], "cluster_id int, size long, percentage double")
    lab = spark.createDataFrame([(0, "A", "a", 1), (0, "B", "b", 2)], "id int, label string, description string, at int")
    with pt.raises(Exception, match="repeated"):
        labels.merge_labels(prof, lab).collect()
    assert [r["label"] for r in labels.merge_labels(prof, lab, order="at").collect()] == ["B"]


def test_idle_sessions_batch(spark):
    df = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 11:30:00"), ("b", "2024-01-01 09:00:00")],
                               "session_id string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    idle = {r["session_id"] for r in chat.idle_sessions(df, as_of="2024-01-01 12:00:00").collect()}
    assert idle == {"b"}


def test_feature_map_and_summary_text(spark):
    enc = [{"original_column": "color", "encoding_type": "one-hot", "new_columns": ["color_red", "color_blue"]},
           {"original_column": "size", "encoding_type": "label", "new_columns": ["size"]}]
    fmap = {r["feature"]: r["original_column"] for r in labels.feature_map(spark, enc).collect()}
    assert fmap == {"color_red": "color", "color_blue": "color", "size": "size"}
    sizes = spark.createDataFrame([(0, 40, 40.0)], "cluster_id int, size long, percentage double")
    top = spark.createDataFrame([(0, 1, "color_red", 0.9, 0.5, 1.25), (0, 2, "size", 2.0, 2.0, 0.0)],
                                "cluster_id int, rank int, feature string, cluster_mean double, overall_mean double, "
                                "z_deviation double")
    text = labels.summary_text(sizes, top, labels.feature_map(spark, enc)).first()["summary"]
    assert text == ("Cluster 0: 40 samples (40.0%)\n"
                    "  - color: cluster mean=0.9, overall mean=0.5, z=1.25 (above average)\n"
                    "  - size: cluster mean=2.0, overall mean=2.0, z=0.0 (below average)")


def test_record_search_history(spark):
    import tempfile

    from tablens.operators import catalog
    path = tempfile.mkdtemp(prefix="tablens-hist-") + "/history"
    s1 = spark.createDataFrame([("climate", 4, None)], "query string, result_count int, created_at timestamp")
    catalog.record_search(path, s1)
    catalog.record_search(path, s1)
    hist = spark.read.parquet(path)
    assert hist.count() == 2 and [r["query"] for r in catalog.suggest(hist, "cl").collect()] == ["climate"]


def test_stream_exchanges(spark):
    import tempfile

    base = tempfile.mkdtemp(prefix="tablens-w4-")
    src, out, ck = base + "/in", base + "/out", base + "/ck"
    schema = "session_id string, user_text string, reply_text string, created_at int"
    spark.createDataFrame([("s", "feedback: ok", "thanks", 1), ("s", "hi", "hello", 2)], schema).write.parquet(src)
    q = chat.stream_exchanges(spark.readStream.schema(schema).parquet(src), out, ck, available_now=True)
    q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 4 and sum(r["is_feedback"] for r in rows) == 2
    # a rerun from the same checkpoint writes nothing twice
    spark.createDataFrame([("t", "x", "y", 3)], schema).write.mode("append").parquet(src)
    q = chat.stream_exchanges(spark.readStream.schema(schema).parquet(src), out, ck, available_now=True)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 6
