import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablens.llm import hnsw, mixing, neardup, neighbours, urlrules


def components(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sets_of(text, width):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute_neardup(rows, width):
    sets = {i: sets_of(t, width) for i, t in rows}
    ids = [i for i, _ in rows]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, pairs).items()}


@pytest.mark.parametrize("width", [2, 5])
def test_neardup_equals_brute_force(spark, width):
    rng = random.Random(width)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t ", "One", "one", "one two", "ONE two", "a b c", "a b c d"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    # a large group whose members link to some and not to others
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        texts.append(" ".join(copy))
    texts += [texts[20]] * 30 + ["x " * 20000 + "end", "x " * 20000 + "end"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, width=width).collect()}
    want = brute_neardup(rows, width)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: n for i, (n, _) in want.items()}
    # the tables miss a link at the threshold once in about 700; components of brute force hold all found ones
    wrong = [i for i in want if got[i]["component_id"] != want[i][1]]
    assert len(wrong) <= 2
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_neardup_null_and_repeated_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "only me here"), (2, "A b c D"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, width=2).collect()), key=str)
    assert got == sorted([(5, 2, False), (5, 2, False), (None, 2, False), (None, None, True), (2, 2, True), (None, None, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    # one id on two texts unites the texts' groups
    rows = [(9, "p q r s"), (9, "t u v w"), (4, "p q r s"), (3, "t u v w"), (8, "x y z")]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, docs.schema)).collect()}
    assert got == {(9, 3), (4, 3), (3, 3), (8, 8)}


def brute_vectors(rows):
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = [(a, b) for k, (a, x, la) in enumerate(ok) for b, y, lb in ok[:k]
             if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98]
    ids = [i for i, *_ in rows if i is not None]
    n = {i: sum(i in p for p in pairs) for i in ids}
    return {i: (n[i], c) for i, c in components(ids, pairs).items()}


@pytest.mark.parametrize("shard_rows", [10_000, 150])
def test_vector_links_equal_brute_force(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for lab, groups, size in ((0, 60, 6), (1, 1, 420), (2, 5, 30), (None, 1, 4)):
        for _ in range(groups):
            c = rng.normal(size=16)
            for _ in range(size):
                rows.append((i, [float(np.float32(x)) for x in c + rng.normal(size=16) * rng.choice([.05, .12, .3])], lab))
                i += 1
    rows += [(i + k, rows[7][1], 0) for k in range(5)]                                   # exact copies
    rows += [(i + 10, None, 0), (i + 11, [0.0] * 16, 0), (i + 12, [float("nan")] + [1.0] * 15, 0), (i + 13, [None] + [1.0] * 15, 0),
             (i + 14, [1.0, 2.0], 0), (i + 15, [2.0, 4.0], 0), (i + 16, [], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit("clash"))
    got = {r["vec_id"]: r for r in neighbours.link_vectors(df, shard_rows=shard_rows).collect()}
    assert len(got) == len(rows)
    want = brute_vectors(rows)
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i in want} == want
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None and got[None]["kept"]
    assert neighbours.link_vectors(df.limit(0)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:400] + rng.normal(size=(400, 24)).astype(np.float32) * .05
    ids, _ = hnsw.search(x, hnsw.build(x), q, 48)
    top = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, top)]) >= .9


URLS = ["http://www.Example.com/en/1", "https://a.example.com/en/x?q=/fr/", "http://shop.net/es/1#top", "http://shop.net/de/1", "HTTP://Net/fr/",
        "http://x.org", "http://com", "no scheme", "", None, "ftp://net.org/es/", "http://b.org/start", "http://c.org/end", "http://d.org/x",
        "http://notexample.com/en/", "://net/es/"]


def brute_rule(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), h + p, v) for v, h, p in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else None


def test_url_rules_and_aliases(spark):
    page = {"http://b.org/start": '<link rel="canonical" href="https://c.org/end">',
            "http://c.org/end": "<META http-equiv=refresh content='0; url=http://shop.net/es/1'>",
            "http://shop.net/de/1": '<link href="/es/2" rel=canonical>',
            "http://d.org/x": '<link rel="canonical" href="http://www.example.com/en/1"><meta http-equiv="refresh" content="1;url=http://shop.net/fr/">'}
    rows = [(i, u, page.get(u)) for i, u in enumerate(URLS)] + [(3, URLS[3], page[URLS[3]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("Rule", F.lit(1))
    got = urlrules.judge(pages, "url", urlrules.page_edges(pages, "url", "html"), urlrules.rule_table(spark)).collect()
    assert len(got) == len(rows)
    extra = {"http://b.org/start": "block", "http://c.org/end": "block", "http://shop.net/de/1": "block", "http://d.org/x": "allow"}
    for r in got:
        host, path, rule = brute_rule(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), r
        assert r["verdict"] == (rule[1] if rule else extra.get(r["url"], "allow")), r
    none = urlrules.judge(pages.limit(0), "url", urlrules.page_edges(pages.limit(0), "url", "html"), urlrules.rule_table(spark))
    assert none.count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(3000)]
    rows += [(None, None, "a"), (7, rows[7][1], rows[7][2]), (9001, " ".join(["w"] * 5000), "b"), (9002, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = {}, {}, {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == size[r["source"]] for r in got)
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:      # the rule, step by step
        free = sum(weight[s] for s in order if s not in capped)
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        want = {s: 2 * size[s] if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if want[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= 5000
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_audit_of_sparse_links_does_not_count_self_matches(monkeypatch):
    """A search that finds nothing but the query itself must not pass the audit."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(2000, 32)))
    x[1000:1020] = unit(x[:20] + .01 * rng.normal(size=(20, 32)))
    other = unit(rng.normal(size=(1500, 32)))
    other[:5] = unit(x[500:505] + .01 * rng.normal(size=(5, 32)))
    dense = unit(x[np.repeat(np.arange(400), 5)] + .01 * rng.normal(size=(2000, 32)))
    def itself(x, levels, q, beam):
        ids = np.full((len(q), beam), -1)
        ids[:, 0] = np.arange(len(q)) % len(x)
        return ids, np.where(ids >= 0, (q[:, None] * x[ids]).sum(axis=2), -1.0)
    monkeypatch.setattr(neighbours.hnsw, "search", itself)
    for q, y, same in ((x, x, True), (x, other, False), (dense, dense, True)):
        q, y = q.astype(np.float32), y.astype(np.float32)
        qs, hits, whole = neighbours._find(q, {"x": y, "levels": None}, .98, same, np.random.default_rng(0))
        r, c = np.nonzero(q @ y.T >= .98 + 1e-5)
        want = {(a, b) for a, b in zip(r.tolist(), c.tolist()) if not (same and a == b)}
        assert want and all(whole[a] or (a, b) in got for got in [set(zip(qs.tolist(), hits.tolist()))] for a, b in want)


def test_graph_is_asked_and_finds_sparse_links(monkeypatch):
    """A shard of 8,192 vectors with 60 near pairs, and another with 25 more: searches go through the graph, no query is compared
    with a whole shard, and at least 0.9 of the links are found."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(8192, 48)))
    x[4000:4060] = unit(x[:60] + .02 * rng.normal(size=(60, 48)))
    y = unit(rng.normal(size=(3000, 48)))
    y[:25] = unit(x[100:125] + .02 * rng.normal(size=(25, 48)))
    asked = []
    search = hnsw.search
    monkeypatch.setattr(neighbours.hnsw, "search", lambda x, levels, q, beam: asked.append((len(q), beam)) or search(x, levels, q, beam))
    index = {"x": x.astype(np.float32), "levels": hnsw.build(x.astype(np.float32))}
    for q, same in ((x, True), (y, False)):
        asked.clear()
        qs, hits, whole = neighbours._find(q.astype(np.float32), index, .98, same, np.random.default_rng(0))
        assert sum(n for n, _ in asked) >= len(q) and not whole.any()
        r, c = np.nonzero(q @ x.T >= .98)
        want = {(a, b) for a, b in zip(r.tolist(), c.tolist()) if not (same and a == b)}
        recall = len(want & set(zip(qs.tolist(), hits.tolist()))) / len(want)
        print("recall", recall, "of", len(want))
        assert len(want) >= 25 and recall >= 0.9
