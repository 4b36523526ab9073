import pytest
from pyspark.sql import functions as F

from tablens.operators import prep, profile


def _cls(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return {r["column"]: r.asDict() for r in profile.classify_columns(df).collect()}


def test_classify_rules(spark):
    rows = [(i, ["red", "green", "blue"][i % 3], f"c{i % 15}", f"id{i}", "x", f"{i % 10}.5", i % 2 == 0,
             None if i < 3 else "a") for i in range(30)]
    c = _cls(spark, rows, "n int, color string, cat string, uid string, const string, price string, flag boolean, g string")
    assert c["n"]["suggested_encoding"] is None and c["n"]["cardinality"] is None
    assert c["color"]["suggested_encoding"] == "one-hot" and c["color"]["cardinality"] == 3
    assert c["cat"]["suggested_encoding"] == "label" and c["cat"]["cardinality"] == 15
    assert c["uid"]["is_id_like"] and c["uid"]["suggested_encoding"] is None
    assert c["const"]["suggested_encoding"] is None and c["const"]["cardinality"] == 1
    assert c["price"]["suggested_encoding"] == "numeric-coerce"
    assert c["flag"]["suggested_encoding"] == "boolean" and c["flag"]["cardinality"] == 2
    assert c["g"]["null_count"] == 3 and c["g"]["non_null_count"] == 27


def test_text_dates_classify_as_datetime(spark):
    rows = [(f"2024-01-{d:02d}",) for d in range(1, 21)]
    c = _cls(spark, rows, "d string")
    assert c["d"]["suggested_encoding"] == "datetime"


def test_missing_census(spark):
    df = spark.createDataFrame([(None if i == 0 else float(i), float(i)) for i in range(10)], "a double, b double")
    got = {r["column"]: r["missing"] for r in profile.missing_values(df).collect()}
    assert got == {"a": 1}


def test_encode_one_hot_label_boolean_missing(spark):
    rows = [(i, ["red", "green", "blue"][i % 3] if i % 4 else None, f"v{i % 15}", i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, color string, cat string, flag boolean")
    enc = prep.encode_categoricals(df, "id", ["color", "cat", "flag", "absent"])
    by = {e["original_column"]: e for e in enc.encoding}
    assert by["color"]["encoding_type"] == "one-hot"
    # values sorted by code point ('MISSING' < 'blue'), the first one dropped
    assert by["color"]["new_columns"] == ["color_blue", "color_green", "color_red"]
    assert by["cat"]["encoding_type"] == "label" and enc.label_maps.where("original_column = 'cat'").count() == 15
    assert by["flag"]["encoding_type"] == "boolean"
    out = enc.frame("id").where(F.col("id") == 1).first()
    codes = {r["value"]: r["code"] for r in enc.label_maps.collect()}
    assert out["cat"] == codes["v1"] == sorted(codes).index("v1")


def test_feature_cap_downgrades_to_label(spark):
    rows = [(i, f"a{i % 60}", f"b{i % 60}") for i in range(180)]
    df = spark.createDataFrame(rows, "id long, cat_a string, cat_b string")
    enc = prep.encode_categoricals(df, "id", ["cat_a", "cat_b"], cardinality_threshold=100, max_features=100)
    kinds = sorted(e["encoding_type"] for e in enc.encoding)
    assert kinds == ["label", "one-hot"] and len(enc.names) <= 100


def test_skip_reasons(spark):
    rows = [(i, f"u{i}", "same", ["x", "y"][i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, uid string, const string, ok string")
    enc = prep.encode_categoricals(df, "id", ["uid", "const", "ok"])
    reasons = {s["column"]: s["reason"] for s in enc.skipped}
    assert reasons == {"uid": "ID-like (20 unique values)", "const": "Single value"}


def test_prepare_impute_drop_scale(spark):
    rows = [(i, float(i), None if i else 5.0, float(i % 3), None if i == 4 else float(i * 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, good double, mostly_nan double, also double, one_null double")
    p = prep.prepare_features(df, "id")
    # mostly_nan has 1 of 10 (not < 1.0) so it survives the 10% rule and goes as zero variance
    assert {"column": "mostly_nan", "reason": "Zero variance"} in p.dropped
    assert p.names == ["good", "also", "one_null"]
    s = p.scaled.agg(*[F.avg(c).alias(c) for c in p.names], *[F.stddev_pop(c).alias("s_" + c) for c in p.names]).first()
    for c in p.names:
        assert abs(s[c]) < 1e-9 and abs(s["s_" + c] - 1) < 1e-9
    imputed = p.features.where("id = 4").first()["one_null"]
    assert imputed == 10.0    # median of 0,2,..,18 without 8


def test_too_few_features(spark):
    df = spark.createDataFrame([(i, float(i), "k") for i in range(10)], "id long, x double, c string")
    with pytest.raises(ValueError, match="usable feature"):
        prep.prepare_features(df, "id", categorical=["c"])


def test_datetime_parts(spark):
    base = ["2024-01-01 10:00:00", "2024-03-06 00:00:00", "2024-07-13 05:00:00"]
    rows = [(i, base[(i - 1) % 3]) for i in range(1, 31)]          # 3 distinct of 30: not ID-like
    df = spark.createDataFrame(rows, "id long, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    enc = prep.encode_categoricals(df, "id", ["ts"])
    assert enc.encoding[0]["new_columns"] == ["ts_month", "ts_day_of_week", "ts_hour"]
    got = {r["id"]: (r["ts_month"], r["ts_day_of_week"], r["ts_hour"]) for r in enc.frame("id").collect()}
    assert got[1] == (1, 0, 10) and got[2] == (3, 2, 0) and got[3] == (7, 5, 5)   # Monday = 0


def test_decode_labels(spark):
    maps = spark.createDataFrame([("feat", 0.0, "a"), ("feat", 1.0, "b"), ("feat", 2.0, "c")],
                                 "original_column string, code double, value string")
    cent = spark.createDataFrame([(0, "feat", 0.4), (1, "feat", 1.5), (2, "feat", 10.0), (3, "other", 1.0)],
                                 "cluster_id int, feature string, value double")
    got = {r["cluster_id"]: r["category"] for r in prep.decode_labels(cent, maps).collect()}
    assert got == {0: "a", 1: "c", 2: "c", 3: None}   # 1.5 rounds half to even -> 2


def test_date_test_uses_all_values(spark):
    # the first 50 values are dates, the 60 after them are not
    rows = [(i, f"2024-01-{(i % 28) + 1:02d}" if i < 50 else f"word{i}") for i in range(110)]
    df = spark.createDataFrame(rows, "k int, t string")
    assert {r["column"]: r for r in profile.classify_columns(df).collect()}["t"]["suggested_encoding"] != "datetime"
    got = profile.classify_columns(df.where("k < 90")).collect()
    assert {r["column"]: r for r in got}["t"]["suggested_encoding"] == "datetime"


def test_text_nan_is_missing(spark):
    rows = [(i, float(i % 7), "nan" if i % 6 == 0 else str(i % 40)) for i in range(120)]
    p = prep.prepare_features(spark.createDataFrame(rows, "id long, x double, t string"), "id", ["x"], ["t"])
    known = sorted(i % 40 for i in range(120) if i % 6)
    got = {r["id"]: r["t"] for r in p.features.collect()}
    assert got[0] == (known[49] + known[50]) / 2 and all(v == v for v in got.values())
