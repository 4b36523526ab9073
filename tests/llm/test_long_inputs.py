"""Long texts, many matches in one text, long paths."""
import time

import numpy as np
from pyspark.sql import functions as F

from tablens.llm import decontam, pagetext, secrets

from .test_spans import brute_secrets


def test_leaks_of_a_long_text_equal_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2**32, 5000, dtype=np.uint32)
    items = [rng.choice(ids, n) for n in (20, 40, 60, 90, 200)]
    text = rng.choice(ids, 6000)
    for k, x in enumerate(items):
        for at in (k * 1100 + 7, k * 1100 + 505):       # some cross the borders of parts
            copy = x.copy()
            copy[::9] = rng.choice(ids, len(copy[::9]))
            text[at:at + len(x)] = copy
    table = rng.normal(size=(decontam.TERMS, 16)).astype(np.float32)
    whole = {(i, n, a) for _, i, n, a in decontam.Searcher(table, items).leaks([text])}
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 512)
    parts = {(i, n, a) for _, i, n, a in decontam.Searcher(table, items).leaks_of_long(text)}
    assert whole and parts == whole


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token=abc{i:05d} x" for i in range(700)) + " é AKIA" + "A" * 20 + " " + "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, text), (2, text + text), (3, "none")], "doc_id long, text string")
    for r in secrets.findings(docs, "text", secrets.scan(docs, "text"), ["doc_id", "text"]).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == [(x, kind, y) for x, _, kind, y in brute_secrets(r["text"])]
    many = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.concat(F.lit("password: abc"), i, F.lit(" and some more words"))), " ").alias("text"))
    began = time.time()
    assert secrets.scan(many, "text").select(F.size("spans")).first()[0] == 20000 - 99        # abc1 to abc99 are too short
    assert time.time() - began < 30


def test_long_paths(spark):
    rows = [("/a" * 16000 + "/x", "/a" * 16000 + "/y"), ("", ""), ("abc", "abd"), ("abc", "abcdef"), ("é/ü", "é/ö"), ("x", "y"), ("same", "same"), ("z", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    began = time.time()
    got = [r[0] for r in df.select(pagetext._shared_path(F.col("a"), F.col("b"))).collect()]
    assert got == [32001, 0, 2, 3, 2, 0, 4, -1] and time.time() - began < 20
