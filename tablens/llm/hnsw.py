"""A hierarchical navigable small-world graph over one bounded shard, in NumPy batches.

Points are inserted level by level from the top (points of higher levels first), in batches that
double: a batch searches the graph made so far, adds its own nearest mates, keeps a diverse
choice of neighbours, and its targets take the reverse edges under the same choice.
All searches advance a whole batch of queries at once.
"""
from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, BATCH = 16, 32, 1024


def beam_search(x: np.ndarray, adj: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int):
    """(ids, sims) of the ``beam`` best points found for each query, best first; -1 where fewer."""
    nq, n = len(q), len(x)
    rows = np.arange(nq)
    seen = np.zeros((nq, n), bool)
    seen[rows, start] = True
    ids = np.full((nq, beam), -1, np.int64)
    sims = np.full((nq, beam), -np.inf, np.float32)
    shut = np.ones((nq, beam), bool)        # expanded, or an empty place
    ids[:, 0], sims[:, 0], shut[:, 0] = start, np.einsum("qd,qd->q", x[start], q), False
    live = rows
    while len(live):
        best = np.where(shut[live], -np.inf, sims[live]).argmax(axis=1)
        go = ~shut[live, best]
        live, best = live[go], best[go]
        if not len(live):
            break
        shut[live, best] = True
        near = adj[ids[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[r, c] = np.einsum("kd,kd->k", x[near[r, c]], q[live[r]])
        # rows whose worst place beats all that is new stay as they are
        gain = new.max(axis=1) > sims[live].min(axis=1)
        if gain.any():
            k, at = live[gain], np.where(fresh[gain], near[gain], -1)
            all_s = np.concatenate([sims[k], new[gain]], axis=1)
            all_i = np.concatenate([ids[k], at], axis=1)
            all_x = np.concatenate([shut[k], ~fresh[gain]], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            line = np.arange(len(k))[:, None]
            ids[k], sims[k], shut[k] = all_i[line, top], all_s[line, top], all_x[line, top]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """For each row up to ``degree`` of its candidates (best first, -1 empty): one is taken if it is
    nearer to the row's point than to any taken before; free places go to the best left over."""
    rows, width = cand.shape
    v = x[np.maximum(cand, 0)]
    mutual = np.einsum("rad,rbd->rab", v, v)
    taken = np.zeros((rows, width), bool)
    count = np.zeros(rows, int)
    for j in range(width):
        worst = np.where(taken[:, :j], mutual[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
        ok = (cand[:, j] >= 0) & (count < degree) & (sims[:, j] > worst)
        taken[:, j] = ok
        count += ok
    rank = np.where(cand < 0, 2 * width + 1, np.where(taken, 0, width) + np.arange(width))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(cand, order, 1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out


def _sorted_unique(cand: np.ndarray, sims: np.ndarray):
    """Candidates best first, repeated ones emptied."""
    by_id = np.argsort(cand, axis=1, kind="stable")
    c = np.take_along_axis(cand, by_id, 1)
    s = np.take_along_axis(sims, by_id, 1)
    again = np.zeros(c.shape, bool)
    again[:, 1:] = c[:, 1:] == c[:, :-1]
    c, s = np.where(again, -1, c), np.where(again | (c < 0), -np.inf, s)
    order = np.argsort(-s, axis=1, kind="stable")
    return np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)


def _build_level(x: np.ndarray, nodes: np.ndarray, starts: np.ndarray, degree: int) -> np.ndarray:
    """Adjacency over positions in ``nodes``; ``starts`` gives each node the position to search from
    (its nearest node of the level above, always inserted before it)."""
    n, v = len(nodes), x[nodes]
    adj = np.full((n, degree), -1, np.int64)
    done = 0
    while done < n:
        size = min(max(64, done), BATCH, n - done)
        new = np.arange(done, done + size)
        q = v[new]
        cand, sims = np.zeros((size, 0), np.int64), np.zeros((size, 0), np.float32)
        if done:
            begin = np.minimum(starts[new], done - 1)
            cand, sims = beam_search(v, adj, q, begin, min(BUILD_BEAM, done))
        mates = q @ q.T
        np.fill_diagonal(mates, -np.inf)
        k = min(degree, size - 1)
        if k > 0:
            top = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            cand = np.concatenate([cand, new[top]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(mates, top, 1)], axis=1)
        if cand.shape[1]:
            cand, sims = _sorted_unique(cand, sims)
            adj[new] = _choose(v, cand, sims, degree)
            src, col = np.nonzero(adj[new] >= 0)
            _take_reverse(v, adj, adj[new][src, col], new[src], degree)
        done += size
    return adj


def _take_reverse(v: np.ndarray, adj: np.ndarray, target: np.ndarray, source: np.ndarray, degree: int) -> None:
    """Adds ``source`` to each ``target``'s neighbours, by the same choice."""
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    uniq, first, counts = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(uniq), BATCH):
        u, f, c = uniq[lo:lo + BATCH], first[lo:lo + BATCH], counts[lo:lo + BATCH]
        width = int(c.max())
        place = np.arange(width)[None, :]
        more = np.where(place < c[:, None], source[np.minimum(f[:, None] + place, len(source) - 1)], -1)
        if width > 2 * degree:      # a much chosen point looks at its nearest new neighbours
            s = np.where(more >= 0, np.einsum("rwd,rd->rw", v[np.maximum(more, 0)], v[u]), -np.inf)
            more = np.take_along_axis(more, np.argpartition(-s, 2 * degree - 1, axis=1)[:, :2 * degree], 1)
        cand = np.concatenate([adj[u], more], axis=1)
        sims = np.where(cand >= 0, np.einsum("rwd,rd->rw", v[np.maximum(cand, 0)], v[u]), -np.inf).astype(np.float32)
        cand, sims = _sorted_unique(cand, sims)
        adj[u] = _choose(v, cand, sims, degree)


def build(x: np.ndarray, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top down as (nodes, adjacency); ``x`` holds unit vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(n)) / np.log(DEGREE)).astype(int), 6)
    if n:
        level[rng.integers(n)] = level.max() + 1    # one entry point on top
    order = np.argsort(-level, kind="stable")
    levels = []
    for lev in range(int(level.max()) if n else -1, -1, -1):
        nodes = order[:int((level >= lev).sum())]
        starts = np.zeros(len(nodes), np.int64)
        if levels:      # nodes above keep their position; the others begin at their nearest node above
            up = len(levels[-1][0])
            starts[:up] = 0
            if len(nodes) > up:
                starts[up:] = _descend(x, levels, x[nodes[up:]])
        levels.append((nodes, _build_level(x, nodes, starts, 2 * DEGREE if lev == 0 else DEGREE)))
    return levels


def _descend(x: np.ndarray, levels, q: np.ndarray) -> np.ndarray:
    """Position, in the lowest of ``levels``, of the nearest node found for each query. A node has the
    same position on every level it is on."""
    at = np.zeros(len(q), np.int64)
    for nodes, adj in levels:
        v = x[nodes]
        for lo in range(0, len(q), BATCH):
            s = slice(lo, lo + BATCH)
            at[s] = beam_search(v, adj, q[s], at[s], 1)[0][:, 0]
    return at


def search(x: np.ndarray, levels, q: np.ndarray, beam: int):
    """(ids into x, sims) of up to ``beam`` points for each query."""
    nodes, adj = levels[-1]
    start = _descend(x, levels[:-1], q) if len(levels) > 1 else np.zeros(len(q), np.int64)
    v = x[nodes]
    ids, sims = [], []
    for lo in range(0, len(q), BATCH):
        i, s = beam_search(v, adj, q[lo:lo + BATCH], start[lo:lo + BATCH], min(beam, len(x)))
        ids.append(np.where(i >= 0, nodes[np.maximum(i, 0)], -1))
        sims.append(s)
    return np.concatenate(ids), np.concatenate(sims)
