import random

from tablens.functions.graph import connected_components


def _brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1400)]          # far longer than any fixed round limit
    star = [(7, 2000 + i) for i in range(300)]
    noise = [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    pairs = chain + star + noise + [(5, 5), (2, 1), (2, 1)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(a, b) if rng.random() < .5 else (b, a) for a, b in pairs] + [(None, 4)], "a long, b long")
    got = {r[0]: r[1] for r in connected_components(df, "a", "b").collect()}
    assert got == _brute(pairs)


def test_components_of_text_nodes_and_no_edges(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    got = {r[0]: r[1] for r in connected_components(df, "a", "b").collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_small_tables_take_few_tasks(spark, monkeypatch):
    """Every task leaves files in every shuffle and checkpoint: a few edges must not be spread over all shuffle partitions."""
    from tablens.functions import graph
    parts, durable = [], graph.durable

    def seen(df):
        out = durable(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(graph, "durable", seen)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)], "a long, b long")
        got = {r[0]: r[1] for r in connected_components(df, "a", "b").collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert len(parts) > 2 and sum(p > 12 for p in parts) <= len(parts) // 2
