"""A minimised acceptor of sorted words, and its composition with a one-edit transducer and itself, in NumPy.

The words are added in order; a state is closed once no later word passes through it and merged with an equal one, so the
states left are the minimal automaton's. Arcs lie in one sorted array, and each arc knows how many words come
before it, so that a path gives the place of its word.

A composed state is (left state, right state, edit spent or not). Before the edit both sides are one state; the edit is spent by two
different arcs of it (replaced) or by one arc on the right alone (inserted), at the first letter in which the two words differ. Behind it both
sides take equal arcs; where they meet in one state their words are equal to the end and are listed at once. Pairs of
states that share no word length are left out. Composed states wait on a stack in pieces, so memory is bounded.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 17


class Acceptor:
    """The minimal automaton of ``words`` (sorted by code point, distinct)."""

    def __init__(self, words: list[str]):
        known: dict = {}
        path = [[False, [], []]]        # final, labels, targets; a target is set once its state is closed

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, labels, targets = path.pop()
                path[-1][2].append(known.setdefault((final, *labels, *targets), len(known)))

        last = ""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            close(same)
            for letter in word[same:]:
                path[-1][1].append(ord(letter))
                path.append([False, [], []])
            path[-1][0] = True
            last = word
        close(0)
        final, labels, targets = path[0]
        self.root = known.setdefault((final, *labels, *targets), len(known))        # states come after their targets

        degree = np.fromiter(((len(key) - 1) // 2 for key in known), np.int64, len(known))
        self.final = np.fromiter((key[0] for key in known), bool, len(known))
        self.start = np.concatenate([[0], np.cumsum(degree)])
        self.label, self.target, self.skip = (np.zeros(self.start[-1], np.int64) for _ in range(3))
        self.words = np.zeros(len(known), np.int64)
        lengths = [0] * len(known)      # bit k: a word of k letters more, k counted modulo 64
        for state, key in enumerate(known):
            a, d = self.start[state], int(degree[state])
            self.label[a:a + d], self.target[a:a + d] = key[1:1 + d], key[1 + d:]
            n, mask = int(key[0]), int(key[0])
            for j, to in enumerate(key[1 + d:]):
                self.skip[a + j] = n
                n += int(self.words[to])
                mask |= (lengths[to] << 1 | lengths[to] >> 63) & 0xFFFFFFFFFFFFFFFF
            self.words[state], lengths[state] = n, mask
        self.lengths = np.array(lengths, np.uint64)
        self.wide = int(self.label.max(initial=0)) + 1
        self.key = np.repeat(np.arange(len(known)), degree) * self.wide + self.label        # sorted: arcs of a state are

    def _arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the states, arc) of all arcs of the states."""
        n = self.start[states + 1] - self.start[states]
        who = np.repeat(np.arange(len(states)), n)
        return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[states], n)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.lengths[a] & self.lengths[b]) != 0

    def _edits(self, state: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """The composed states entered by the edit at paths (state, place of their first word)."""
        who, arc = self._arcs(state)
        to, at = self.target[arc], place[who] + self.skip[arc]
        # one arc on the right alone; the left may not go on with the same letter, else the words differ later
        yield state[who], place[who], to, at, self.label[arc]
        # two arcs of one state: each with those after it
        n = np.bincount(who, minlength=len(state))
        after = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(who))
        left = np.repeat(np.arange(len(who)), after)
        right = np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after) + left + 1
        yield to[left], at[left], to[right], at[right], np.full(len(left), -1)

    def near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places of words that differ by one edit, each pair once, in pieces."""
        open_paths = [(np.array([self.root]), np.zeros(1, np.int64))]
        stack: list = []
        while open_paths or stack:
            if not stack:
                state, place = open_paths.pop()
                for entered in self._edits(state, place):
                    fit = self._fit(entered[0], entered[2])
                    stack.append(tuple(x[fit] for x in entered))
                who, arc = self._arcs(state)
                to, at = self.target[arc], place[who] + self.skip[arc]
                size = max(1, _PIECE // 64)      # a state has some ninety arcs at most, so some 4,000 pairs of them
                open_paths += [(to[i:i + size], at[i:i + size]) for i in range(0, len(to), size)]
                continue
            a, ia, b, ib, ban = stack.pop()
            if len(a) > _PIECE:
                stack += [tuple(x[i:i + _PIECE] for x in (a, ia, b, ib, ban)) for i in range(0, len(a), _PIECE)]
                continue
            same = (a == b) & (ban < 0)
            if same.any():
                n = self.words[a[same]]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(ia[same], n) + step, np.repeat(ib[same], n) + step
            a, ia, b, ib, ban = (x[~same] for x in (a, ia, b, ib, ban))
            both = self.final[a] & self.final[b]
            if both.any():
                yield ia[both], ib[both]
            who, arc = self._arcs(a)
            go = self.label[arc] != ban[who]
            who, arc = who[go], arc[go]
            want = b[who] * self.wide + self.label[arc]
            other = np.searchsorted(self.key, want)
            hit = other < len(self.key)
            hit[hit] = self.key[other[hit]] == want[hit]
            who, arc, other = who[hit], arc[hit], other[hit]
            to_a, to_b = self.target[arc], self.target[other]
            fit = self._fit(to_a, to_b)
            if fit.any():
                who, arc, other = who[fit], arc[fit], other[fit]
                stack.append((to_a[fit], ia[who] + self.skip[arc], to_b[fit], ib[who] + self.skip[other], np.full(len(who), -1)))
