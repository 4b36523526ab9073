import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablens.llm import blockjoin


def brute(rows, k):
    """{query id: sorted lists of (score, id)} by plain Python."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, x in ok:
        if a % 20 == 0:
            near = []
            for b, y in ok:
                if a != b and len(x) == len(y):
                    s = 0.0
                    for p, q in zip(x, y):
                        s += p * q
                    near.append((s, b))
            out.setdefault(a, []).append(sorted(near, key=lambda t: (-t[0], t[1]))[:k])
    return {a: sorted(lists) for a, lists in out.items() if any(lists)}


def run(spark, data, kind, k=20, **kw):
    df = spark.createDataFrame([(v, i, 1.0) for i, v in data], f"embedding array<{kind}>, vec_id long, score double")
    got = {}
    for r in blockjoin.nearest(df, F.col("vec_id") % 20 == 0, k, **kw).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return got


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_brute_force_over_many_blocks(spark, kind):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    x = base[rng.integers(0, 30, 700)] + rng.normal(scale=0.02, size=(700, 16)) * rng.choice([0, 1], (700, 1))
    x = x.astype(np.float32 if kind == "float" else np.float64)
    rows = [(int(i) - 40, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(900 + i, [float(v) for v in x[3]]) for i in range(60)]           # a large group of copies: ties by id
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [1.0] * 15 + [float("nan")]), (2080, [None] + [1.0] * 15),
             (2100, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (4000, [5.0])]
    got = run(spark, rows, kind, query_rows=20, rows=40)
    want = brute(rows, 20)
    assert set(got) == set(want) and 4000 not in got and len(got[3000]) == 1
    for q, lists in want.items():
        assert [(s, i) for _, s, i in sorted(got[q])] == lists[0], q
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, len(lists[0]) + 1))


def test_repeated_rows_are_listed_each(spark):
    rows = [(20, [1.0, 0.0])] * 2 + [(1, [2.0, 1.0])] * 3 + [(2, [1.0, 9.0])]
    got = run(spark, rows, "double", k=3)
    assert sorted(got[20]) == [(1, 2.0, 1)] * 2 + [(2, 2.0, 1)] * 2 + [(3, 2.0, 1)] * 2
    assert run(spark, [], "double") == {}


def test_extreme_sizes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=4) * 10.0 ** e]) for i, e in enumerate([150, 150, 150, -320, -320, -160, 0, 0, 1, 154] * 6)]
    got = run(spark, rows, "double", rows=10)
    for q, lists in brute(rows, 20).items():
        assert [(s, i) for _, s, i in sorted(got[q])] == lists[0]


def test_few_pairs_are_computed_again():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 1500))        # longer than one exact slice of int8 products
    c = {"id": np.arange(4000), "x": x, **blockjoin.quantise(x)}
    q = {key: v[:40] for key, v in c.items()}
    r, ids, scores, again = blockjoin.tile(q, c, 20)
    full = x[:40] @ x.T
    full[np.arange(40), np.arange(40)] = -np.inf
    assert (ids.reshape(40, 20) == np.argsort(-full, axis=1)[:, :20]).all() and again < 40 * 4000 / 5
    assert np.allclose(scores.reshape(40, 20), -np.sort(-full, axis=1)[:, :20])


def test_bound_holds():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 33)) * 10.0 ** rng.integers(-3, 3, (200, 1))
    a = blockjoin.quantise(x)
    near = (a["q"].astype(float) @ a["q"].astype(float).T) * a["scale"][:, None] * a["scale"]
    bound = a["said"][:, None] * a["rest"] + a["rest"][:, None] * a["length"]
    assert (np.abs(near - x @ x.T) <= bound * (1 + 1e-9)).all()
