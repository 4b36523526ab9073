import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablens.llm import acceptor, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def run(spark, rows, most):
    df = spark.createDataFrame([(t, i, "w", 1) for i, t in rows], "text string, doc_id long, word string, n int")
    words = spelling.durable(spelling.vocabulary(df))
    out = spelling.variants(words, most=most)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r[0], r[1] or "", r[2], r[3], r[4], -1 if r[5] is None else r[5]) for r in out.collect())


@pytest.mark.parametrize("most", [20, 32768])
def test_equals_brute_force(spark, most):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "bbbbbbb" * 3]
    weight = [1000 if i % 9 == 0 else 60 if i % 4 == 0 else 3 for i in range(len(base))]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choices(base, weight, k=30):
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abéÀÿ×") + w[k:], w[:k] + rng.choice("abéÀÿ÷") + w[k + 1:]])
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    rows += [(None, "nothing nothing"), (5, None), (6, ""), (7, "short"), *rows[:20]]
    want = brute(rows)
    assert run(spark, rows, most) == want
    assert any(w[2] != w[1] != "" for w in want)        # a chain of forms


def test_starts_as_long_as_words(spark):
    # a shared beginning longer than the shorter words: the cut goes on to their ends
    words = ["abcdefg" + x for x in ("", "h", "hi", "hj", "hij", "hik", "hijk", "i", "ii", "iij")]
    rows = [(i, " ".join(words)) for i in range(4)] + [(9, "x" * 20000 + "A " + "x" * 20000 + "A " + "x" * 20001 + "a " + "x" * 20001 + "a")]
    assert run(spark, rows, 2) == brute(rows)
    assert run(spark, [], 2) == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abcé", min_size=0, max_size=6), max_size=40))
def test_composition_gives_each_pair_once(words):
    words = sorted(words)
    pairs = [(words[i], words[j]) for a, b in acceptor.Acceptor(words).near() for i, j in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(map(frozenset, pairs)))
    assert set(map(frozenset, pairs)) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}


def test_acceptor_is_minimal():
    words = sorted(p + s for p in ("ab", "cd", "xy") for s in ("ing", "ed", "s"))
    a = acceptor.Acceptor(words)
    # final, three inside the endings, one before them, one for each first letter, the root
    assert len(a.final) == 9 and a.words[a.root] == 9
