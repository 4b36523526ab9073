import numpy as np

from tablens.functions.quantiles import grouped_quantiles, quantiles


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    n = 6000
    vals = np.concatenate([rng.normal(size=n // 2), np.full(n // 3, 7.0), rng.exponential(size=n - n // 2 - n // 3)])
    df = spark.createDataFrame([(float(v), float(v) if i % 5 else None, None, float("nan") if i % 2 else 1.0) for i, v in enumerate(vals)],
                               "a double, b double, empty double, c double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    got = quantiles(df, ["a", "b", "empty", "c"], probs)
    some = np.array([v for i, v in enumerate(vals) if i % 5])
    for p in probs:
        assert abs(got["a", p] - np.quantile(vals, p)) < 1e-12 and abs(got["b", p] - np.quantile(some, p)) < 1e-12
        assert got["empty", p] is None and got["c", p] == 1.0


def test_grouped_quantiles_and_boxes(spark, blobs):
    from tablens.operators import series
    lab = blobs.withColumnRenamed("truth", "cluster")
    rows = lab.collect()
    feats = ["a", "b", "c", "d"]
    got = {(r["cluster_id"], r["feature"]): r for r in series.feature_boxes(lab, feats).collect()}
    assert len(got) == 12 and series.feature_boxes(lab, feats, limit=2).count() == 6
    for (k, f), r in got.items():
        v = np.array([x[f] for x in rows if x["cluster"] == k])
        assert np.allclose([r["min"], r["q1"], r["median"], r["q3"], r["max"], r["mean"]],
                           [*np.quantile(v, [0, .25, .5, .75, 1]), v.mean()])
    assert grouped_quantiles(lab.limit(0), "cluster", feats, [0.5]).count() == 0
