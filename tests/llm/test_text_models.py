import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablens.llm import decontam, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_em_recovers_labeller_accuracies():
    rng = np.random.default_rng(0)
    y = (rng.random(20000) < .7).astype(int)
    hit = [.9, .8, .75, .6]
    votes = np.array([np.where(rng.random(len(y)) < .3, 2, np.where(rng.random(len(y)) < h, y, 1 - y)) for h in hit]).T
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    p, prior = quality.estimate(pats, counts.astype(float))
    assert abs(prior[1] - .7) < .03
    for i, h in enumerate(hit):
        assert abs(p[1, i, 1] / (p[1, i, 0] + p[1, i, 1]) - h) < .04


def test_quality_against_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    got = quality.score_documents(docs.select("doc_id", "text", "score"))
    assert got.columns == ["doc_id", "text", "score", "kept"]
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= .99 and np.mean(bad) <= .1


def test_quality_of_odd_rows(spark):
    clean = "The report was read aloud in the hall. Nobody spoke for a while, and then all did."
    rows = [(1, None), (2, ""), (3, "  \n "), (4, clean), (4, clean), (5, clean + "\n" + clean.replace("hall", "room") * 3000), (None, "Word.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.score_documents(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(docs.limit(0)).count() == 0
    assert quality.shape(b"Wher,!!") == b"Aa,!"


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs.where("doc_id % 2 = 0"), labels)
    rows = (toxicity.score_toxicity(docs.where("doc_id % 2 = 1"), model)
            .join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").select("y", "toxic").collect())
    hit = sum(r["y"] == 1 and r["toxic"] for r in rows)
    assert hit / sum(r["y"] for r in rows) >= .85 and hit / sum(r["toxic"] for r in rows) >= .97


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some words", "c")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert model is None
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 3 and not any(r["toxic"] for r in got)


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=4000), np.ones(4000)]).astype(np.float32)
    first = (x[:, 0] + rng.normal(size=4000) > 0).astype(float)
    chain = toxicity.fit_chain(x, np.column_stack([first, 1 - first]), np.arange(4000) % 5)
    assert len(chain[0]) == 2 and len(chain[1]) == 3
    p = toxicity.run_chain(x, chain)
    assert np.corrcoef(p[:, 0], p[:, 1])[0, 1] < -.9


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_bit_parallel_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 70))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 90))]
        assert decontam.lcs_length(decontam.Item(np.array(a)).masks, len(a), b) == _lcs(a, b)


def test_leaks_against_brute_force(spark):
    """Every document that holds a whole item is found; every find passes the word checks by brute force."""
    assert decontam.words_in("Été, d'UN__Ão 3.5\n") == [w.encode() for w in ("été", "d", "un", "ão", "3", "5")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(docs, bench).collect()}
    words = lambda t: [w.decode("utf-8", "replace") for w in decontam.words_in(t)]
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    joined = {d: " " + " ".join(w) + " " for d, w in texts.items()}
    whole = {(d, i) for d, t in joined.items() for i, w in items.items() if " " + " ".join(w) + " " in t}
    assert len(whole) > 10 and whole <= set(got)
    for (d, i), r in got.items():
        assert _lcs(items[i], texts[d]) >= r["found"] >= decontam.COVER_WITH_ANSWER * len(items[i])


def test_paraphrases_and_odd_rows(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(30) for _ in range(5)] + [[]]
    copy = list(items[0])
    copy[3], copy[11], copy[20] = "xx", "yy", "zz"
    rows = [(i, " ".join(text(rng.randrange(5, 300)))) for i in range(60)]
    rows += [(100, " ".join(text(40) + copy + text(40))), (101, " ".join(text(90) + items[1])), (None, " ".join(items[2])),
             (103, None), (104, ""), (101, " ".join(text(90) + items[1])), (105, " ".join(text(20000) + items[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(100, 0), (101, 1), (None, 2), (105, 3)}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_altered_items_against_brute_force_verdicts(spark):
    rng = random.Random(8)
    read = lambda name: [decontam.words_in(r["text"]) for r in spark.read.parquet(f"{SF}/{name}.parquet").select("text").collect()]
    texts = sorted(t for t in read("documents") if len(t) > 400)
    pool = [w for t in texts for w in t]
    items = read("benchmark") + [t[:n] for t, n in zip(texts[::7], (260, 300, 350, 400, 280, 320))]
    replaced = lambda x, p: [rng.choice(pool) if rng.random() < p else w for w in x]
    dropped = lambda x, p: [w for w in x if rng.random() >= p]
    inserted = lambda x, p: [y for w in x for y in ([w, rng.choice(pool)] if rng.random() < p else [w])]
    ways = [lambda x: replaced(x, .2), lambda x: dropped(x, .2), lambda x: inserted(x, .6), lambda x: inserted(replaced(x, .15), 1)]
    rows, true = [], [set() for _ in ways]
    for k, way in enumerate(ways):
        for i, x in enumerate(items):
            a, b = rng.randrange(len(pool) - 400), rng.randrange(len(pool) - 400)
            t = pool[a:a + 150] + way(x) + pool[b:b + 150]
            known = decontam._Ids()
            item = decontam.Item(np.array([known[w] for w in x], np.uint32))
            if decontam.is_leak(item, *decontam.verdict(item, [known[w] for w in t])):
                true[k].add((k * len(items) + i, i))
            rows.append((k * len(items) + i, b" ".join(t).decode("utf-8", "replace")))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    bench = spark.createDataFrame([(i, b" ".join(x).decode("utf-8", "replace")) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    for t in true:
        assert len(t) >= .9 * len(items) and len(t & got) >= .9 * len(t)
    assert {(d, i) for t in true for d, i in t if len(items[i]) > 256} <= got


def test_quality_fit_reads_the_full_sample():
    import inspect
    for f in (quality.train, quality.score_documents):
        assert inspect.signature(f).parameters["fit_rows"].default >= 8_000


def test_latent_basis_is_fitted_on_all_passages(spark, monkeypatch):
    class Seen(Exception):
        pass

    def seen(df):
        raise Seen(df.count())

    def make(batches):
        for pdf in batches:
            ids = [np.random.default_rng(i).integers(0, 2**32, 48 * 1000, dtype=np.uint32).tobytes() for i in pdf["id"]]
            yield pdf.assign(ids=ids)[["ids"]]

    words = spark.range(0, 260, 1, 8).mapInPandas(make, "ids binary")
    monkeypatch.setattr(decontam, "durable", seen)
    with pytest.raises(Seen) as told:
        decontam.latent_basis(words, np.ones(decontam.TERMS, np.float32), [])
    assert told.value.args == (260_000,)


def test_gram_products_against_dense():
    rng = np.random.default_rng(5)
    idf = rng.random(decontam.TERMS).astype(np.float32) * 5
    rows = [rng.integers(0, 60, n).astype(np.uint16) for n in (1, 48, 7, 48, 300, 48, 2)] + [np.full(40, decontam.TERMS - 1, np.uint16)]
    q = rng.standard_normal((decontam.TERMS, 5)).astype(np.float32)
    a = np.zeros((len(rows), decontam.TERMS))
    for i, r in enumerate(rows):
        np.add.at(a[i], r, idf[r])
        a[i] /= np.sqrt((idf[r].astype(float) ** 2).sum())
    gram = decontam.Gram(q, idf)
    for part in (rows[:3], rows[3:]):
        gram.add(part)
        gram.add_small(part)
    assert np.allclose(gram.total(), a.T @ (a @ q), atol=1e-3) and np.allclose(gram.small, q.T @ (a.T @ (a @ q)), rtol=1e-4, atol=1e-3)


def test_fit_keeps_two_bytes_a_word_and_parts_words_of_one_bucket(spark, monkeypatch):
    kept, durable = [], decontam.durable
    monkeypatch.setattr(decontam, "durable", lambda df: kept.append(durable(df)) or kept[-1])
    a = np.arange(48, dtype=np.uint32)
    b = a + np.uint32(decontam.TERMS)       # other words in the same buckets
    words = spark.createDataFrame([(bytearray(x.tobytes()),) for x in (a, b, a, a[:5])], "ids binary")
    basis = decontam.latent_basis(words, np.ones(decontam.TERMS, np.float32), [])
    assert np.isfinite(basis).all()
    assert sorted(len(r["p"]) for r in kept[0].collect()) == [10, 96, 96]


def test_overlapping_parts_are_read_once(monkeypatch):
    """Parts of one item overlap many times; they are told out by what holds them all, and the results are the same."""
    rng = np.random.default_rng(2)
    table = rng.standard_normal((decontam.TERMS, decontam.DIMS)).astype(np.float32)
    item = rng.integers(0, 2**32, 40, dtype=np.uint32)
    near = np.tile(rng.permutation(item), 20)           # all of its words, out of order
    texts = [near, np.concatenate([near[:200], item, near[:300]]), item[::-1].copy()]
    searcher, read = decontam.Searcher(table, [item], least_cosine=-1), []
    plain = searcher.in_order
    monkeypatch.setattr(searcher, "in_order", lambda word, item, lo, hi: read.append(int((hi - lo).sum())) or plain(word, item, lo, hi))
    monkeypatch.setattr(searcher, "need", np.array([36]))
    got = {x[:2] for x in searcher.leaks(texts)}
    assert (1, 0) in got and (2, 0) not in got
    once = sum(read)
    read.clear()
    monkeypatch.setattr(searcher, "may_hold", lambda word, item, lo, hi: np.ones(len(item), bool))
    assert {x[:2] for x in searcher.leaks(texts)} == got
    assert 2 * once < sum(read)


@pytest.mark.parametrize("long", [0, 30_000])
def test_common_words_alone_are_not_read(monkeypatch, long):
    """Words that many items share make up no leak, however often a text repeats them; with items of any length."""
    rng = np.random.default_rng(4)
    table = rng.standard_normal((decontam.TERMS, decontam.DIMS)).astype(np.float32)
    ids = rng.permutation(decontam.TERMS).astype(np.uint32)
    common = ids[:12]
    items = [rng.permutation(np.concatenate([common, ids[20 + 18 * i:38 + 18 * i]])) for i in range(40)]
    items += [rng.integers(0, 2**32, long, dtype=np.uint32)] if long else []
    searcher, read = decontam.Searcher(table, items, least_cosine=-1), []
    plain = searcher.in_order
    monkeypatch.setattr(searcher, "in_order", lambda word, item, lo, hi: read.append(len(item)) or plain(word, item, lo, hi))
    assert not list(searcher.leaks([rng.choice(common, 3000)])) and not sum(read)
    near = items[7].copy()
    near[::7] = ids[-5:]                                    # five of 30 words replaced
    texts = [np.concatenate([rng.choice(common, 200), x, rng.choice(common, 90)]) for x in (near, items[3])] + [items[9][::-1]]
    got = sorted(searcher.leaks(texts))
    assert {x[:2] for x in got} == {(0, 7), (1, 3)}
    monkeypatch.setattr(searcher, "may_suffice", lambda held, item: np.ones(len(item), bool))
    assert sorted(searcher.leaks(texts)) == got


def test_document_frequencies_of_terms(spark):
    texts = [[1, 2, 2, 5], [2], [], [5, 1 + decontam.TERMS, 1]] * 3
    words = spark.createDataFrame([(i, bytearray(np.array(t, np.uint32).tobytes())) for i, t in enumerate(texts)], "doc_id long, ids binary")
    idf = decontam.term_weights(words)
    assert np.allclose(idf[[1, 2, 5, 9]], np.log(13 / np.array([7, 7, 7, 1])))
