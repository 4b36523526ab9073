"""Operator 6, benchmark decontamination by latent semantic retrieval.

Words are hashed to term buckets; document frequencies come from all documents. A randomised SVD of
TF-IDF passages (Halko, Martinsson and Tropp: random range, one power step, Rayleigh-Ritz) runs
in tasks over all distinct passages and gives a latent basis. The first
directions tell languages apart rather than passages and are left out; the rest are whitened.

Every document is then read in overlapping windows of three lengths (a quarter of a window
apart); each window's latent vector is compared with the benchmark items it fits in or around.
All candidates (cosine >= ``least_cosine``) are checked on the words themselves: the longest common
subsequence of the item and the words around the window must cover most of the item, or half of
it together with the item's answer (its last words). Only candidates whose words around the window hold
fewer of the item's words than that are passed over; words that many items share count at most as often as the item has them.

Nothing of the corpus reaches the driver but term counts (one per bucket) and the sums of the fit. The
items are sent to the tasks in blocks of bounded size, one pass over the windows for each block.

Null and empty texts hold no window. Items without words match nothing. Repeated rows get equal
results; a null document id is returned as null. Empty tables give no rows. Texts are read whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

TERMS, SKIP, DIMS, EXTRA = 1 << 14, 8, 40, 8
PASSAGE, FIT_TASKS = 48, 16
WINDOWS = (16, 32, 64)
LEAST_COSINE, COVER, COVER_WITH_ANSWER, ANSWER_SHARE, ANSWER_COVER = 0.35, 0.75, 0.6, 0.2, 0.6
#: Words of a block whose item words are counted together, and items that share a table of word places.
COUNTED, ITEM_GROUP = 8, 128
#: Share of a block's items from which a term counts as common.
COMMON = 0.08
ITEM_BLOCK, CHUNK_WORDS = 4096, 1 << 15
#: Words whose windows are compared at a time: for larger tables the system clears new memory each time.
TABLE_WORDS = 1 << 13
#: Lengths of an item up to which overlapping parts of a text are read as one.
STRETCH = 4
#: Lists whose rows are added side by side.
STEP = 1024
_PARTING = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


class _Ids(dict):
    """Ids of single words."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = crc32(w)
        return h


def words_in(text: str | None) -> list[bytes]:
    """Words, letters lower-cased; ASCII punctuation and blanks part them."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTING).split() if text else []


def word_ids(text: str | None) -> np.ndarray:
    """32-bit ids of a text's words (a table of known words takes longer than the hash)."""
    words = words_in(text)
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def hashed_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids) with the word ids of every whole text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [word_ids(t).tobytes() for t in pdf["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(run, f"doc_id {kind}, ids binary"))


def _arrays(col) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint32) for b in col]


def _groups(texts: list[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """Texts in turn, as many as have ``most`` words together, one at least."""
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b]) <= most):
            n += len(texts[b])
            b += 1
        yield texts[a:b]
        a = b


def term_weights(words: DataFrame) -> np.ndarray:
    """Inverse document frequency of every term bucket, from all documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(TERMS, np.int64)
        for pdf in batches:
            n += len(pdf)
            for texts in _groups(_arrays(pdf["ids"]), 1 << 18):
                at = (np.concatenate(texts) & np.uint32(TERMS - 1)).astype(np.uint16)
                order = np.argsort(at, kind="stable")
                term, line = at[order], np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])[order]
                new = np.ones(len(term), bool)      # the first of a text's equal terms
                new[1:] = (term[1:] != term[:-1]) | (line[1:] != line[:-1])
                df += np.bincount(term[new], minlength=TERMS)
        yield pd.DataFrame({"term": np.append(np.nonzero(df)[0], -1), "n": np.append(df[df > 0], n)})

    rows = words.select("ids").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}      # at most one row per bucket
    total = counts.pop(-1, 0)
    df = np.zeros(TERMS)
    df[list(counts)] = list(counts.values())
    return np.log((total + 1) / (df + 1)).astype(np.float32)


def _added(table: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each of the lists at[first:first + size] the sum of its rows of ``table``, one place of all lists after another."""
    order = np.argsort(-size, kind="stable")
    out = np.zeros((len(size), table.shape[1]), np.float32)
    room = np.empty((min(STEP, len(order)), table.shape[1]), np.float32)
    for a in range(0, len(order), STEP):
        some = order[a:a + STEP]
        begin, long = first[some], size[some]
        acc = np.zeros((len(some), table.shape[1]), np.float32)
        for c, m in enumerate(np.searchsorted(-long, -np.arange(1, long[0] + 1), side="right").tolist()):    # lists of more than c rows
            row = table.take(at[begin[:m] + c], axis=0, out=room[:m], mode="clip")
            acc[:m] += row
        out[some] = acc
    return out


class Gram:
    """(A'A) q over passages given in parts, as lists of term buckets. A row of A is a passage's TF-IDF weights, scaled to length 1:
    idf goes into q and the sum, the lengths into the passages' vectors, so nothing is as long as the words and as wide as q."""

    def __init__(self, q: np.ndarray, idf: np.ndarray):
        self.idf, self.table = idf, (q * idf[:, None]).astype(np.float32)
        self.sum = np.zeros(q.shape, np.float32)
        self.small = np.zeros((q.shape[1], q.shape[1]))

    def _vectors(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All terms of the passages, how many each has, its length as weights, and A q."""
        at = np.concatenate(rows).astype(np.uint16)         # TERMS fit; 16 bits are sorted by radix
        size = np.array([len(r) for r in rows])
        first = np.cumsum(size) - size
        norm = np.sqrt(np.add.reduceat(self.idf[at] ** 2, first))[:, None] + np.float32(1e-9)
        return at, size, norm, _added(self.table, at, first, size) / norm

    def add_small(self, rows: list[np.ndarray]) -> None:
        """q' (A'A) q, which takes no more than A q."""
        y = self._vectors(rows)[-1]
        self.small += y.T @ y

    def add(self, rows: list[np.ndarray]) -> None:
        at, size, norm, y = self._vectors(rows)
        y /= norm
        # the passages of each term, in lists of at most 16
        order = np.argsort(at, kind="stable")
        line = np.repeat(np.arange(len(rows), dtype=np.int32), size)[order]
        begin = np.searchsorted(at[order], np.arange(TERMS + 1, dtype=np.int32))
        held = np.diff(begin)
        lists = -(-held // 16)
        term = np.repeat(np.arange(TERMS), lists)
        nth = np.arange(len(term)) - np.repeat(np.cumsum(lists) - lists, lists)
        some = _added(y, line, begin[term] + 16 * nth, np.minimum(16, held[term] - 16 * nth))
        term, begin = np.unique(term, return_index=True)
        self.sum[term] += np.add.reduceat(some, begin, axis=0)

    def total(self) -> np.ndarray:
        return self.sum * self.idf[:, None]


def latent_basis(words: DataFrame, idf: np.ndarray, items: list[np.ndarray], seed: int = 3) -> np.ndarray:
    """(terms, DIMS) weights; a passage's latent vector is the sum of its words' rows."""
    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, told = [], []
            for x in _arrays(pdf["ids"]):
                terms = (x & np.uint32(TERMS - 1)).astype(np.uint16)
                for i in range(0, len(x), PASSAGE):
                    out.append(terms[i:i + PASSAGE].tobytes())
                    told.append(crc32(x[i:i + PASSAGE]))
            yield pd.DataFrame({"p": out, "words": told})

    # distinct passages, so that copies do not bend the basis: their term buckets, two bytes each, told apart by their words
    fit = durable(words.select("ids").mapInPandas(passages, "p binary, words long").distinct())

    def product(q: np.ndarray, small: bool = False) -> np.ndarray:
        """(A'A) q, or q' (A'A) q, one partial sum per task."""
        def added(batches: Iterator[list[np.ndarray]]) -> np.ndarray:
            gram = Gram(q, idf)
            for rows in batches:
                if rows:
                    (gram.add_small if small else gram.add)(rows)
            return gram.small if small else gram.total()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z = added([np.frombuffer(b, np.uint16) for b in pdf["p"]] for pdf in batches)
            yield pd.DataFrame({"z": [z.astype(np.float32).tobytes()]})

        def total(pdf: pd.DataFrame) -> pd.DataFrame:       # FIT_TASKS rows
            return pd.DataFrame({"z": [sum(np.frombuffer(b, np.float32).astype(np.float64) for b in pdf["z"]).astype(np.float32).tobytes()]})

        summed = fit.select("p").coalesce(FIT_TASKS).mapInPandas(run, "z binary").groupBy().applyInPandas(total, "z binary").first()
        own = added([[x & np.uint32(TERMS - 1) for x in items if len(x)]])
        return own + (0 if summed is None else np.frombuffer(summed["z"], np.float32).reshape(own.shape).astype(np.float64))

    width = SKIP + DIMS + EXTRA
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((TERMS, width)))[0].astype(np.float32)
    q = np.linalg.qr(product(q))[0].astype(np.float32)
    q = np.linalg.qr(product(q))[0].astype(np.float32)
    small = product(q, small=True)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    pick = np.argsort(-values)[SKIP:SKIP + DIMS]
    sigma = np.sqrt(np.maximum(values[pick], 1e-12))
    basis = (q @ vectors[:, pick]) / np.maximum(sigma, 1e-3 * sigma.max(initial=1e-6))
    return (basis * idf[:, None]).astype(np.float32)


class Item:
    """A benchmark item: word places for the bit-parallel subsequence, and its answer's."""

    def __init__(self, ids: np.ndarray):
        self.size = len(ids)
        self.masks: dict[int, int] = {}
        for i, w in enumerate(ids.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.tail = max(1, round(self.size * ANSWER_SHARE))


def lcs_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    full = v = (1 << size) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - bin(v).count("1")


def verdict(item: Item, words: list[int]) -> tuple[int, int]:
    """Words of the item, and of its answer, found in order."""
    n = lcs_length(item.masks, item.size, words)
    if n < COVER_WITH_ANSWER * item.size:
        return n, 0
    skip = item.size - item.tail
    tail = {w: m >> skip for w, m in item.masks.items() if m >> skip}
    return n, lcs_length(tail, item.tail, words)


def is_leak(item: Item, found: int, answer: int) -> bool:
    return found >= COVER * item.size or (found >= COVER_WITH_ANSWER * item.size and answer >= ANSWER_COVER * item.tail)


def _scales(size: int) -> list[int]:
    """The longest window within the item's length and the shortest that holds it."""
    within = [i for i, w in enumerate(WINDOWS) if w <= size][-1:]
    around = [i for i, w in enumerate(WINDOWS) if w >= size][:1]
    return sorted({*within, *around})


class Searcher:
    """Finds the items of one block in texts, given as word ids."""

    def __init__(self, table: np.ndarray, items: list[np.ndarray], least_cosine: float = LEAST_COSINE):
        self.least, self.facts = least_cosine, [Item(x) for x in items]
        latent = np.zeros((len(items), table.shape[1]), np.float32)
        has = np.zeros((TERMS + 1, len(items)), np.uint8)       # the last term stands for padding
        by_scale: list[list[int]] = [[] for _ in WINDOWS]
        for i, x in enumerate(items):
            at = x & np.uint32(TERMS - 1)
            has[at, i] = 1
            v = table[at].sum(axis=0)
            norm = np.linalg.norm(v)
            if norm > 0:
                latent[i] = v / norm
                for k in _scales(len(x)):
                    by_scale[k].append(i)
        self.size = np.array([f.size for f in self.facts])
        # 1 for a term of the item, and 16 for one that few items have, so that a block's sum holds both counts
        common = has.sum(axis=1, dtype=np.int64) >= max(2, COMMON * len(items))
        self.has = has * np.where(common, 1, 17).astype(np.uint8)[:, None]
        self.common = np.array([common[x & np.uint32(TERMS - 1)].sum() for x in items], np.int64)
        self.need = np.ceil(COVER_WITH_ANSWER * self.size - 1e-9).astype(np.int64)
        self.mine = [np.array(x, np.int64) for x in by_scale]
        self.latent = [np.ascontiguousarray(latent[x].T) for x in by_scale]
        # the words that are checked reach an item's length around a window, and half its scale's longest item
        longest = [max([w] + [self.facts[i].size for i in x]) for w, x in zip(WINDOWS, by_scale)]
        self.reach = [np.maximum(n // 2, self.size) for n in longest]
        # both counts of a part share a number
        room = max(w + 2 * int(r.max(initial=0)) for w, r in zip(WINDOWS, self.reach)) + 2 * COUNTED
        self.count, self.half = (np.uint32, 16) if room < 1 << 16 else (np.uint64, 32)
        self.grid = np.vstack([table, np.zeros((1, table.shape[1]), np.float32)])
        # places of each word in the items of up to 64 words: a row a word, a column an item; row 0 for other words
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint32), *items]))
        self.rows, self.places = [], []
        for a in range(0, len(items), ITEM_GROUP):
            group = items[a:a + ITEM_GROUP]
            own = np.unique(np.concatenate(group))
            row = np.zeros(len(self.words) + 1, np.int32)
            row[np.searchsorted(self.words, own)] = np.arange(1, len(own) + 1)
            places = np.zeros((len(own) + 1, ITEM_GROUP), np.uint64)
            for c, x in enumerate(group):
                if len(x) <= 64:
                    np.bitwise_or.at(places[:, c], np.searchsorted(own, x) + 1, np.uint64(1) << np.arange(len(x), dtype=np.uint64))
            self.rows.append(row)
            self.places.append(places.ravel())

    def in_order(self, word: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of items of up to 64 words and text parts [lo, hi), many at a time."""
        n = np.zeros(len(item), np.int64)
        order = np.lexsort((lo - hi, item // ITEM_GROUP))       # within a group the longest parts first
        group = item[order] // ITEM_GROUP
        for g in np.unique(group):
            mine = order[np.searchsorted(group, g):np.searchsorted(group, g, side="right")]
            at = self.rows[g][word].astype(np.int64) * ITEM_GROUP
            for a in range(0, len(mine), 8192):
                some = mine[a:a + 8192]
                col, begin, length = item[some] % ITEM_GROUP, lo[some], (hi - lo)[some]
                full = np.uint64(2**64 - 1) >> (64 - self.size[item[some]]).astype(np.uint64)
                v = full.copy()
                steps = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")     # parts of at least so many words
                for j, m in enumerate(steps.tolist()):
                    x = v[:m]
                    u = x & self.places[g][at[begin[:m] + j] + col[:m]]
                    v[:m] = (x + u) | (x - u)
                n[some] = self.size[item[some]] - np.bitwise_count(v & full)
        return n

    def may_suffice(self, held: np.ndarray, item: np.ndarray) -> np.ndarray:
        """False only for text parts with fewer of the item's words than a leak needs: no subsequence is longer than the item's words in
        the part, nor than those that few items have and the item's own common ones."""
        need = self.need[item]
        few = (held >> self.half).astype(np.int64)
        return (few + self.common[item] >= need) & ((held & ((1 << self.half) - 1)).astype(np.int64) >= need)

    def may_hold(self, word: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """False only for text parts that lie in a longer one without enough of the item's words in order. Most of an item's parts
        overlap, so these are read once, in stretches of up to STRETCH parts' length."""
        order = np.lexsort((lo, item))
        i, a, b = item[order], lo[order], hi[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (a[1:] >= b[:-1])
        # a run of overlapping parts is cut at multiples of the stretch, counted from the run's first part
        run = np.cumsum(new) - 1
        cut = (a - a[new][run]) // (STRETCH * self.size[i])
        new[1:] |= cut[1:] != cut[:-1]
        stretch = np.cumsum(new) - 1
        whole = np.flatnonzero(new)
        begin, end, mine = a[whole], np.maximum.reduceat(b, whole), i[whole]
        ok = self.size[mine] > 64
        ok[~ok] = self.in_order(word, mine[~ok], begin[~ok], end[~ok]) >= self.need[mine[~ok]]
        out = np.empty(len(i), bool)
        out[order] = ok[stretch]
        return out

    def leaks_of_long(self, text: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``leaks`` of one long text, in parts. Parts begin at whole windows and overlap by all that a window may read, so
        every window of the text lies with its surroundings in one of them."""
        whole = max(WINDOWS)
        over = -(-(max(int(r.max(initial=0)) for r in self.reach) + whole) // whole) * whole
        step = max(whole, CHUNK_WORDS // whole * whole)
        best: dict[int, tuple[int, int]] = {}
        for a in range(0, len(text), step):
            for _, i, n, answer in self.leaks([text[max(0, a - over):a + step + over]]):
                best[i] = max(best.get(i, (0, 0)), (n, answer))
        for i, (n, answer) in best.items():
            yield 0, i, n, answer

    def candidates(self, docs: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """The words of all texts in a row, lists of (document, item, from, to) of the parts of it that may hold an item, and where each
        text begins."""
        length = np.array([len(x) for x in docs])
        size = -(-length // 16) * 16 + 48       # whole blocks, and a gap to the next text
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.full(first[-1] + max(WINDOWS), TERMS, np.int32)
        word = np.full(len(flat), len(self.words), np.int64)
        for x, a in zip(docs, first):
            flat[a:a + len(x)] = x & np.uint32(TERMS - 1)
            at = np.minimum(np.searchsorted(self.words, x), len(self.words) - 1)
            word[a:a + len(x)] = np.where(self.words[at] == x, at, len(self.words))
        fours = flat.reshape(-1, 4)
        blocks = self.grid[fours[:, 0]]
        for c in (1, 2, 3):
            blocks += self.grid[fours[:, c]]
        # words of each item before each block, and in the upper half those that few items have
        parts = flat.reshape(-1, COUNTED)
        held = self.has[parts[:, 0]]
        for c in range(1, COUNTED):
            held += self.has[parts[:, c]]
        held = held.astype(self.count)
        before = np.zeros((len(held) + 1, len(self.facts)), self.count)
        np.cumsum((held & 15) | (held >> 4 << self.half), axis=0, dtype=self.count, out=before[1:])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for s, w in enumerate(WINDOWS):
            if s:
                blocks = blocks[:-1:2] + blocks[1::2] if len(blocks) % 2 == 0 else blocks[:-2:2] + blocks[1::2]
            if not len(self.mine[s]) or len(blocks) < 4:
                continue
            v = blocks[:-1] + blocks[1:]
            v = v[:-2] + v[2:]
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            v /= np.maximum(norm, 1e-6)[:, None]
            hit = np.flatnonzero(v @ self.latent[s] >= self.least)
            win = hit // len(self.mine[s])
            item, start = self.mine[s][hit - win * len(self.mine[s])], win * (w // 4)
            d = (np.searchsorted(first, np.arange(len(v)) * (w // 4), side="right") - 1)[win]
            inside = d < len(docs)
            item, start, d = item[inside], start[inside], d[inside]
            lo = np.maximum(first[d], start - self.reach[s][item])
            hi = np.maximum(lo, np.minimum(first[d] + length[d], start + w + self.reach[s][item]))
            keep = self.may_suffice(before[-(-hi // COUNTED), item] - before[lo // COUNTED, item], item)
            found.append((d[keep], item[keep], lo[keep], hi[keep]))
        return word, found, first[:-1]

    def leaks(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, found, answer) of every leak."""
        words, found, begins, n, size = [], [], [], 0, 0
        for some in _groups(docs, TABLE_WORDS):
            word, parts, first = self.candidates(some)
            found += [(d + n, item, lo + size, hi + size) for d, item, lo, hi in parts]
            words.append(word)
            begins.append(first + size)
            n, size = n + len(some), size + len(word)
        if not found:
            return
        word, first = np.concatenate(words), np.concatenate(begins)
        d, item, lo, hi = (np.concatenate(x) for x in zip(*found))
        keep = np.flatnonzero(self.may_hold(word, item, lo, hi))
        d, item, lo, hi = d[keep], item[keep], lo[keep], hi[keep]
        small = self.size[item] <= 64
        keep = ~small
        keep[small] = self.in_order(word, item[small], lo[small], hi[small]) >= self.need[item[small]]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, x, y in zip(d[keep].tolist(), item[keep].tolist(), (lo - first[d])[keep].tolist(), (hi - first[d])[keep].tolist()):
            n, answer = verdict(self.facts[i], docs[d][x:y].tolist())
            if is_leak(self.facts[i], n, answer):
                best[d, i] = max(best.get((d, i), (0, 0)), (n, answer))
        for (d, i), (n, answer) in best.items():
            yield d, i, n, answer


def search(words: DataFrame, table: np.ndarray, items: list[tuple[object, np.ndarray]], item_type: str,
           least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, item_id, found, answer, item_words) for every leak, one row per document and item."""
    doc_type = words.schema["doc_id"].dataType.simpleString()
    names, ids = [i for i, _ in items], [x for _, x in items]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(table, ids, least_cosine)
        for pdf in batches:
            docs, texts = pdf["doc_id"].tolist(), _arrays(pdf["ids"])
            a = 0
            while a < len(docs):
                b, n = a, 0
                while b < len(docs) and (b == a or n + len(texts[b]) <= CHUNK_WORDS):
                    n += len(texts[b])
                    b += 1
                leaks = searcher.leaks(texts[a:b]) if n <= CHUNK_WORDS else searcher.leaks_of_long(texts[a])
                rows = [(docs[a + d], names[i], found, answer, searcher.facts[i].size) for d, i, found, answer in leaks]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "found", "answer", "item_words"])
                a = b

    return words.mapInPandas(run, f"doc_id {doc_type}, item_id {item_type}, found long, answer long, item_words long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, found, answer, item_words) for every document that holds a benchmark item."""
    words = durable(hashed_words(docs, id_col, text_col))
    idf = term_weights(words)
    item_type = benchmark.schema[item_col].dataType.simpleString()
    doc_type = docs.schema[id_col].dataType.simpleString()
    table, out, block = None, None, []

    def passed(block):
        return durable(search(words, table, block, item_type))

    for r in benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).toLocalIterator():
        ids = word_ids(r["t"])
        if not len(ids):
            continue
        block.append((r["i"], ids))
        if len(block) == ITEM_BLOCK:
            table = latent_basis(words, idf, [x for _, x in block]) if table is None else table
            found = passed(block)
            out, block = found if out is None else out.unionByName(found), []
    if block:
        table = latent_basis(words, idf, [x for _, x in block]) if table is None else table
        found = passed(block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = words.sparkSession.createDataFrame([], f"doc_id {doc_type}, item_id {item_type}, found long, answer long, item_words long")
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items: doc_id, n_items, their ids, and the best cover."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs, bench)
    # a document's list is bounded by the benchmark
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.round(F.max(F.col("found") / F.col("item_words")), 6).alias("best_cover"), F.lit(True).alias("contaminated"))
