import numpy as np
import pytest
from pyspark.sql import functions as F

from tablens.operators import density, iforest, models, prep


@pytest.fixture(scope="module")
def fitted(spark, blobs):
    p = prep.prepare_features(blobs.drop("truth"), "id")
    m = models.matrix(p)
    x = {r["id"]: np.array(r[models.Z]) for r in m.select("id", models.Z).collect()}
    truth = {r["id"]: r["truth"] for r in blobs.collect()}
    return p, m, x, truth


def brute_silhouette(x, lab):
    ids = sorted(x)
    X = np.array([x[i] for i in ids])
    L = np.array([lab[i] for i in ids])
    d = ((X[:, None] - X[None]) ** 2).sum(-1)      # squared: the linear form
    s = []
    for i in range(len(ids)):
        own = L == L[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, L == c].mean() for c in set(L) if c != L[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_choose_k_and_kmeans(spark, fitted):
    p, m, x, truth = fitted
    k, trace, fit = models.choose_k(m, "id", p.n_rows)
    assert k == 3 and [t[0] for t in trace] == list(range(2, 11)) and all(t[2] for t in trace)
    lab = models.label_rows(m, fit.centres, numbering=models.numbering_by_size(m, fit.centres))
    got = {r["id"]: r["cluster"] for r in lab.select("id", "cluster").collect()}
    # each true blob maps to exactly one cluster
    assert all(len({got[i] for i in got if truth[i] == t}) == 1 for t in range(3))
    sil = models.silhouette(lab, "id")
    assert sil > 0.4
    assert abs(sil - brute_silhouette(x, got)) < 1e-9


def test_kmeans_restarts_and_convergence(spark, fitted):
    p, m, x, _ = fitted
    rows = models.starting_rows(m, "id", p.n_rows)
    single = [models.fit_together(m, [models.plus_plus(rows, 4, models.SEED + r)])[0] for r in range(5)]
    together = models.fit_together(m, [models.plus_plus(rows, 4, models.SEED + r) for r in range(5)])
    assert all(np.allclose(a.centres, b.centres) and abs(a.cost - b.cost) < 1e-9 for a, b in zip(single, together))
    lab, best = models.kmeans(m, "id", 4)
    assert abs(best.cost - min(f.cost for f in single)) < 1e-9 and best.converged
    X = np.array([x[i] for i in sorted(x)])
    near = ((X[:, None] - best.centres) ** 2).sum(-1)
    assert abs(best.cost - near.min(1).sum()) < 1e-6        # and a fixpoint: every centre is the mean of its rows
    assert all(np.allclose(best.centres[c], X[near.argmin(1) == c].mean(0), atol=0.02) for c in range(4))
    with pytest.warns(UserWarning, match="before it converged"):
        _, cut = models.kmeans(m, "id", 9, restarts=2, max_iter=1)
    assert not cut.converged
    few = models.choose_k(m.where("id < 1"), "id", 1)
    assert few.k == 2 and few.fit is None


@pytest.mark.parametrize("d, basis", [(3, 160), (40, 160), (40, 44)])
def test_principal_axes_equal_the_covariance_eigenvectors(spark, d, basis):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(500, d)) @ np.diag(1.5 ** -np.arange(d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] + 100
    m = spark.createDataFrame([([float(v) for v in row],) for row in x], f"{models.Z} array<double>")
    v, share = models.principal_axes(m, 3, basis=basis)
    vals, vecs = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(share, vals[::-1][:3] / vals.sum(), atol=1e-8)
    for j in range(3):
        assert abs(abs(v[:, j] @ vecs[:, -1 - j]) - 1) < 1e-6


def test_principal_axes_of_a_wide_table(spark):
    """6,000 features: no matrix of features x features is made (it would hold 36 million numbers)."""
    from pyspark.sql.types import ArrayType, DoubleType
    d = 6000
    m = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(d)), lambda j: (F.xxhash64("id", j) % 1000) / 1000.0
                                                 + F.when(j <= 300, F.col("id") * 0.1).otherwise(0.0)).cast(ArrayType(DoubleType())).alias(models.Z))
    v, share = models.principal_axes(m, 2)
    x = np.stack([r[0] for r in m.select(models.Z).collect()])
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert v.shape == (d, 2) and abs(share[0] - s[0] ** 2 / (s ** 2).sum()) < 1e-9 and abs(abs(v[:, 0] @ vt[0]) - 1) < 1e-7


def test_silhouette_with_singleton_and_noise(spark, fitted):
    p, m, x, truth = fitted
    lab = {i: (truth[i] if i != 0 else 9) for i in x}
    lab[1] = -1                                    # noise is left out
    df = m.select("id", models.Z).join(spark.createDataFrame(list(lab.items()), "id long, cluster int"), "id")
    got = models.silhouette(df, "id")
    keep = {i: c for i, c in lab.items() if c != -1}
    assert abs(got - brute_silhouette({i: x[i] for i in keep}, keep)) < 1e-9


def test_pca_orthogonal_and_signed(spark, fitted):
    p, m, _, _ = fitted
    pts, v, _ = models.pca_points(p, m)
    assert pts.columns == ["id", "pc1", "pc2", "pc3"]
    c = pts.agg(F.corr("pc1", "pc2"), F.corr("pc1", "pc3"), F.corr("pc2", "pc3")).first()
    assert all(abs(x) < 1e-6 for x in c)
    for j in range(v.shape[1]):
        assert v[np.argmax(np.abs(v[:, j])), j] > 0


def test_isolation_forest_share(spark, fitted):
    p, m, _, _ = fitted
    out = iforest.detect_anomalies(m, "id", p.n_rows, contamination=0.1)
    r = out.agg(F.sum("anomaly"), F.count("*")).first()
    assert 10 <= r[0] <= 20 and r[1] == 150


def test_forest_is_a_table_of_nodes_and_scores_walk_it(spark, fitted):
    p, m, x, _ = fitted
    nodes, psi = iforest.fit_forest(m, "id", p.n_rows, trees=12, psi=64)
    assert psi == 64 and set(nodes.groupby("tree").size() <= 127) == {True} and nodes["tree"].nunique() == 12
    inner = nodes[nodes["feature"] >= 0]
    for t, group in nodes.groupby("tree"):      # sizes of both children add up, depths go down by one
        g = group.set_index("node")
        for r in inner[inner["tree"] == t].itertuples():
            assert g.loc[r.left, "size"] + g.loc[r.right, "size"] == r.size and g.loc[r.left, "depth"] == r.depth + 1

    def walk(v):
        total = 0.0
        for _, group in nodes.groupby("tree"):
            rows = group.set_index("node").to_dict("index")
            k = 0
            while rows[k]["feature"] >= 0:
                k = rows[k]["left"] if v[rows[k]["feature"]] < rows[k]["threshold"] else rows[k]["right"]
            total += rows[k]["depth"] + float(iforest.c_factor(rows[k]["size"]))
        return -2.0 ** (-(total / 12) / float(iforest.c_factor(psi)))

    for r in iforest.scores(m, nodes, psi, ["id"]).where("id < 40").collect():
        assert abs(r["raw"] - walk(x[r["id"]])) < 1e-12


def brute_kdist(x, k):
    X = np.array([x[i] for i in sorted(x)])
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    return dict(zip(sorted(x), np.sort(d, 1)[:, k - 1]))


def test_kth_distance_and_eps(spark, fitted):
    p, m, x, _ = fitted
    got = {r["qid"]: r["kdist"] for r in density.kth_distances_all(m, "id", 5).collect()}
    want = brute_kdist(x, 5)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in x)
    eps = density.auto_eps(m, "id", 5, p.n_rows)
    assert abs(eps - max(float(np.median(list(want.values()))), 0.01)) < 1e-9


def brute_dbscan(x, eps, ms):
    ids = sorted(x)
    X = np.array([x[i] for i in ids])
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= ms
    lab = np.full(len(ids), -1)
    c = 0
    for i in range(len(ids)):            # index-order scan, as a reference implementation does
        if lab[i] != -1 or not core[i]:
            continue
        stack, lab[i] = [i], c
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for t in np.where(nb[j])[0]:
                if lab[t] == -1:
                    lab[t] = c
                    stack.append(t)
        c += 1
    return dict(zip(ids, lab))


def test_dbscan_matches_brute_force(spark, fitted):
    p, m, x, _ = fitted
    for eps, ms in ((0.5, 5), (0.25, 4)):
        out, n = density.dbscan(m, "id", eps, ms, block=40)     # small blocks: many block pairs
        got = {r["id"]: r["cluster"] for r in out.select("id", "cluster").collect()}
        want = brute_dbscan(x, eps, ms)
        assert got == want and n == len({v for v in want.values() if v >= 0})


def test_dbscan_follows_a_long_line(spark):
    """One line of 300 points in single-point blocks is one cluster, however many cells it crosses."""
    rows = [(i, [0.1 * i, 0.0]) for i in range(300)] + [(900, [500.0, 3.0])]
    m = spark.createDataFrame(rows, f"id long, {models.Z} array<double>")
    out, n = density.dbscan(m, "id", 0.25, 3, block=1)
    got = {r["id"]: r["cluster"] for r in out.select("id", "cluster").collect()}
    assert n == 1 and got.pop(900) == -1 and set(got.values()) == {0}


def test_kmeans_step_and_sweep(spark, fitted):
    p, m, x, truth = fitted
    centers = np.array([[0.0] * 4, [1.0] * 4])
    X = np.array([x[i] for i in sorted(x)])
    near = ((X[:, None] - centers[None]) ** 2).sum(-1).argmin(1)
    got = {(r["cluster"], r["position"]): (r["centre"], r["rows"]) for r in models.lloyd_step(m, centers).collect()}
    for c in set(near):
        for j in range(4):
            assert abs(got[c, j][0] - X[near == c, j].mean()) < 1e-9 and got[c, j][1] == (near == c).sum()
    score = models.sweep_silhouettes(m, [centers, centers[:1]])
    lab = dict(zip(sorted(x), near))
    assert abs(score[0] - brute_silhouette(x, lab)) < 1e-9 and score[1] is None


def test_dbscan_crowded_spot_is_exact(spark):
    """A third of the rows sit on one point, another third near it in one box: labels still equal the brute force."""
    rng = np.random.default_rng(5)
    pts = [np.zeros(2)] * 70 + [rng.normal(0, 0.05, 2) for _ in range(70)] + [rng.normal(0, 1.5, 2) for _ in range(140)]
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(pts)]
    m = spark.createDataFrame(rows, f"id long, {models.Z} array<double>")
    x = {i: np.array(v) for i, v in rows}
    for eps, ms in ((0.4, 6), (0.15, 3)):
        out, n = density.dbscan(m, "id", eps, ms, block=8)
        got = {r["id"]: r["cluster"] for r in out.select("id", "cluster").collect()}
        assert got == brute_dbscan(x, eps, ms)
    empty, n = density.dbscan(m.limit(0), "id", 0.4, 3)
    assert n == 0 and empty.count() == 0


def test_crowded_spot_makes_few_pairs_of_boxes(spark):
    """200,000 points in one eps ball (and 2,000 around): the pairs of boxes grow with the rows, not their square."""
    def pairs(n):
        x = F.when(F.col("id") < n, F.array(F.rand(3) * 0.01, F.rand(4) * 0.01)).otherwise(F.array(F.rand(5) * 100, F.rand(6) * 100))
        m = density.durable(spark.range(n + n // 100).select("id", x.alias(models.Z)))
        index = density._Index(m, "id", 0.05, 256)
        counts = index.counts()
        assert counts.where(f"id < {n}").agg(F.min("neighbours")).first()[0] >= n
        return index.open.count() + index.within.count(), index.leaves.count()

    few, _ = pairs(20_000)
    many, leaves = pairs(200_000)
    assert many <= 12 * few and many < leaves * 40 < leaves * leaves / 10


def test_k_distances_compare_few_pairs(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 6)) * 20
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 6))
    x[:40] = x[0]      # equal points
    m = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"id long, {models.Z} array<double>")
    near, told = density.near_distances(m, "id", 9, block=32)
    got = {r["qid"]: r["kdist"] for r in near.collect()}
    want = brute_kdist(dict(enumerate(x)), 9)
    assert len(got) == 3000 and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert told.agg(F.sum("compared")).first()[0] < 3000 ** 2 / 10
    assert density.kth_distances_all(m.limit(0), "id", 3).count() == 0
    few = {r["kdist"] for r in density.kth_distances_all(m.where("id < 3"), "id", 5).collect()}
    assert few == {float("inf")}


def test_generated_row_id_is_durable(spark, blobs):
    p = prep.prepare_features(blobs.drop("id", "truth"))
    assert p.id_col == prep.ROW_ID and p.features.count() == 150
    ids1 = sorted(r[0] for r in p.features.select(p.id_col).collect())
    ids2 = sorted(r[0] for r in p.scaled.select(p.id_col).collect())
    assert ids1 == ids2 and len(set(ids1)) == 150


def test_analyze_save_and_reload(spark, blobs):
    import json
    import tempfile

    from tablens.operators.runs import RunStore
    from tablens.plans.pipeline import analyze, charts, save_analysis
    a = analyze(blobs.drop("truth"), "id", "blobs", "kmeans")
    assert a.n_clusters == 3 and a.silhouette > 0.4 and a.title == "KMEANS Analysis of blobs"
    assert a.rows.count() == 150 and set(a.rows.columns) >= {"id", "cluster", "pc1", "pc2", "pc3", "score", "anomaly"}
    assert len(charts(a)) == 9
    store = RunStore(spark, tempfile.mkdtemp(prefix="tablens-runs-"))
    rid = save_analysis(store, a, {"source": "test", "id": "blobs", "name": "blobs"})
    got = store.get(rid).first()
    assert len(got["charts"]) == 9
    res = json.loads(got["analysis_result"])
    assert spark.read.parquet(res["rows_path"]).count() == 150 and res["n_clusters"] == 3
    a.release()
    assert a.rows.count() == 150          # still computable after the caches are dropped


def test_analyze_dbscan(spark, blobs):
    from tablens.plans.pipeline import analyze
    a = analyze(blobs.drop("truth"), "id", "blobs", "dbscan")
    assert a.rows.count() == 150 and a.n_clusters >= 1
    assert set(a.params) == {"eps", "min_samples"} and a.params["min_samples"] == 5
    assert analyze(blobs.drop("truth"), "id", "blobs", "dbscan", eps=0.7).params["eps"] == 0.7


def test_unknown_algorithm(spark, blobs):
    from tablens.plans.pipeline import analyze
    with pytest.raises(ValueError, match="Unknown algorithm"):
        analyze(blobs.drop("truth"), "id", "blobs", "spectral")


def test_analyze_decodes_label_centroids(spark):
    rows = [(i, float(i % 7), float(i % 5), f"g{i % 12:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, y double, grp string")
    from tablens.plans.pipeline import analyze
    a = analyze(df, "id", "t", "kmeans", 2, categorical=["grp"])
    dec = {(r["cluster_id"], r["feature"]): r["category"] for r in a.centroids_decoded().collect()}
    cats = {v for (c, f), v in dec.items() if f == "grp"}
    assert cats and cats <= {f"g{i:02d}" for i in range(12)}
    assert all(v is None for (c, f), v in dec.items() if f != "grp")


def test_kth_distances_all_blocks(spark, fitted):
    p, m, x, _ = fitted
    got = {r["qid"]: r["kdist"] for r in density.kth_distances_all(m, "id", 7, p.n_rows, block=20).collect()}
    want = brute_kdist(x, 7)
    assert len(got) == 150 and all(abs(got[i] - want[i]) < 1e-9 for i in x)


def test_contamination_bounds(spark, blobs):
    from tablens.plans.pipeline import analyze
    with pytest.raises(ValueError, match="contamination"):
        analyze(blobs.drop("truth"), "id", "blobs", "kmeans", 3, contamination=0.9)
