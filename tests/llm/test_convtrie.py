import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tablens.llm import convtrie
from tablens.llm.perfecthash import PerfectHash


def brute(rows):
    """The nodes by plain Python, as sorted tuples in the order of the columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h, b = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = ts if b == c else own.get(b, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += p not in kids
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def run(spark, rows, segment=None, **kw):
    data = [(t, c, r, x, "own", 3) for c, t, r, x in rows]
    df = spark.createDataFrame(data, "turn long, conv_id long, role string, text string, c string, depth int")
    own = convtrie.durable(convtrie.turns(df))
    got = convtrie.trie(own, convtrie.rebuilt(own), **kw)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["hello there", "  two\twords \n", "", None, "one", "a b c d e f", "é ü"]
    rows = []
    for c in rng.sample(range(-60, 400), 150):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(pool)))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1150) for t in range(5)]              # a large group of copies
    rows += [(c, t, "user", f"same {t}" if t < 3 else f"own {c}") for c in range(1200, 1300) for t in range(5)]
    rows += rows[:40] + [(None, 0, "user", "lost")]
    rng.shuffle(rows)
    assert run(spark, rows, shard_nodes=50) == brute(rows)


def test_one_conversation_over_many_tasks_and_segments(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "SEGMENT", 64)
    rows = [(20, t, "user", f"t{t % 5} x") for t in range(1500)]
    # every conversation one turn longer than the last, all on one path
    rows += [(40 + 20 * k, t, "user", f"g{t}") for k in range(40) for t in range(k + 1)]
    assert run(spark, rows, shard_nodes=40) == brute(rows)


def test_turnless_and_empty(spark):
    c = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 4 == 3 and i % 20)       # all of its turns are replaced
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert run(spark, rows) == brute(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "a")]) == []


def test_long_texts(spark):
    rows = [(c, 0, "user", "word " * 200_000) for c in (20, 40, 60)] + [(40, 1, "user", "end")]
    assert run(spark, rows) == brute(rows)


def test_same_digest_for_two_prefixes_is_an_error(spark):
    row = {"c": 1, "depth": 1, "hi": 5, "phi": 0, "lo": 6, "plo": 0, "l3": 1, "l4": 1, "words": 1, "ends": True}
    paths = spark.createDataFrame(pd.DataFrame([row, row | {"c": 2, "l4": 2}]))
    with pytest.raises(Exception, match="two prefixes share a digest"):
        convtrie.node_table(paths)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3000):
        hi, lo = rng.integers(-2**62, 2**62, (2, n))
        table = PerfectHash(hi, lo)
        assert sorted(table.find(hi, lo)) == list(range(n))
        assert (table.find(hi ^ 1, lo) == -1).all()
    with pytest.raises(ValueError, match="not distinct"):
        PerfectHash(np.array([1, 2, 2]), np.array([4, 5, 5]))
