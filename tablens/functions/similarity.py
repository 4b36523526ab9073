"""Fuzzy text similarity (our definitions; no fuzzy-matching library is installed).

ratio(a, b)     = 100 * 2 * LCS(a, b) / (len a + len b), LCS by the bit-parallel method
                  (one big-integer step per character), so long texts stay cheap.
token_set(a, b) = word sets; 100 when they share words and one side has no others;
                  else the best ratio among {shared, shared+rest_a, shared+rest_b}.
partial(a, b)   = best ratio of the shorter text against every equal-length window of the
                  longer; windows whose character-count bound cannot beat the best are skipped.
These are per-row helpers used inside vectorised (Arrow) UDFs.
"""
from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_len(a: str, b: str) -> int:
    if not a or not b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs_len(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    shared = ta & tb
    ra, rb = sorted(ta - tb), sorted(tb - ta)
    if shared and (not ra or not rb):
        return 100.0
    s = " ".join(sorted(shared))
    sa = (s + " " + " ".join(ra)).strip()
    sb = (s + " " + " ".join(rb)).strip()
    best = ratio(sa, sb)
    if s:
        best = max(best, ratio(s, sa), ratio(s, sb))
    return best


def partial_ratio(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    m = len(short)
    if m == len(long):
        return ratio(short, long)
    need = Counter(short)
    win = Counter(long[:m])
    bounds = []
    overlap = sum(min(c, win[ch]) for ch, c in need.items())
    bounds.append((overlap, 0))
    for i in range(1, len(long) - m + 1):
        out_ch, in_ch = long[i - 1], long[i + m - 1]
        if out_ch != in_ch:
            if win[out_ch] <= need.get(out_ch, 0):
                overlap -= 1
            win[out_ch] -= 1
            win[in_ch] += 1
            if win[in_ch] <= need.get(in_ch, 0):
                overlap += 1
        bounds.append((overlap, i))
    bounds.sort(key=lambda t: (-t[0], t[1]))
    best = 0
    for bound, i in bounds:
        if bound <= best:
            break
        best = max(best, lcs_len(short, long[i:i + m]))
        if best == m:
            break
    top = 100.0 * best / m
    # windows that the ends of the longer text cut off
    for w in range(m - 1, 0, -1):
        if 200.0 * w / (m + w) <= top:
            break
        for part in (long[:w], long[-w:]):
            top = max(top, 200.0 * lcs_len(short, part) / (m + w))
    return top


@F.pandas_udf(T.DoubleType())
def relevance_udf(q: pd.Series, name: pd.Series, desc: pd.Series, tags: pd.Series) -> pd.Series:
    """0.60 token-set(query, name) + 0.25 partial(query, description) +
    0.15 best token-set(query, tag); everything lower-cased."""
    out = []
    for qq, nn, dd, tt in zip(q, name, desc, tags):
        qq = (qq or "").lower()
        score = token_set_ratio(qq, (nn or "").lower()) * 0.60
        score += partial_ratio(qq, (dd or "").lower()) * 0.25
        tl = [] if tt is None else list(tt)
        score += max((token_set_ratio(qq, (t or "").lower()) for t in tl), default=0.0) * 0.15
        out.append(score)
    return pd.Series(out, dtype="float64")
