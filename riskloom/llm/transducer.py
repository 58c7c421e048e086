"""Minimal acyclic transducer from words (bytes) to id sequences, as flat arrays.

Words that end alike share their states. Every transition carries how many
smaller words it passes by; their sum along a word is the word's number, and
its ids stand in one table at that number. All words of a batch walk the
arrays together, one byte a step.
"""

from __future__ import annotations

from array import array

import numpy as np


def _minimal(words: list[bytes]) -> tuple[list, list[bool]]:
    """Each state's transitions (byte, state, byte, state, ...) in order of bytes, and whether a word ends there.

    Words come sorted. A state that turns out to equal another is given up and
    its place used again, so that no more are held than the result has, and one word's.
    """
    edges: list = [[]]
    final = [False]
    free: list[int] = []
    register: dict[tuple, int] = {}
    path: list[int] = []  # states of the last word, below the start, not yet merged

    def merge(depth: int) -> None:
        while len(path) > depth:
            child = path.pop()
            key = (final[child], *edges[child])
            same = register.setdefault(key, child)
            if same == child:
                edges[child] = key[1:]
            else:
                edges[child] = None
                free.append(child)
                edges[path[-1] if path else 0][-1] = same

    last = b""
    for w in words:
        if w == last and path:
            continue
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        merge(k)
        state = path[-1] if path else 0
        for byte in w[k:]:
            if free:
                child = free.pop()
                edges[child], final[child] = [], False
            else:
                child = len(edges)
                edges.append([])
                final.append(False)
            edges[state] += byte, child
            path.append(child)
            state = child
        final[state] = True
        last = w
    merge(0)
    return edges, final


def compile_lexicon(ids_of: dict[bytes, list[int]]) -> bytes:
    """The transducer of all words as one block: a header of lengths, then int64 arrays."""
    words = sorted(w for w in ids_of if w)
    return compile_sorted(words, np.cumsum([0, *(len(ids_of[w]) for w in words)]),
                          np.array([i for w in words for i in ids_of[w]], np.int64))


def compile_sorted(words: list[bytes], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """``compile_lexicon`` of sorted words without the empty one; word k has ids[offsets[k]:offsets[k + 1]]."""
    edges, final = _minimal(words)
    number, order, todo = {0: 0}, [0], [0]
    while todo:
        for t in edges[todo.pop()][1::2]:
            if t not in number:
                number[t] = len(order)
                order.append(t)
                todo.append(t)
    below: dict[int, int] = {}
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            below[s] = final[s] + sum(below[t] for t in edges[s][1::2])
        elif s not in below:
            stack.append((s, True))
            stack += [(t, False) for t in edges[s][1::2] if t not in below]
    rows = array("q")
    for s in order:
        skip = int(final[s])
        for byte, t in zip(edges[s][::2], edges[s][1::2]):
            rows.extend((number[s] * 256 + byte, number[t], skip))
            skip += below[t]
    table = np.frombuffer(rows, np.int64).reshape(-1, 3) if rows else np.zeros((0, 3), np.int64)
    table = table[np.argsort(table[:, 0])]
    parts = [table[:, 0], table[:, 1], table[:, 2], np.array([final[s] for s in order], np.int64), offsets, ids]
    head = np.array([len(parts), *map(len, parts)], np.int64)
    return b"".join(np.ascontiguousarray(a, np.int64).tobytes() for a in [head, *parts])


class Lexicon:
    """A compiled transducer in any int64 buffer, such as a memory map."""

    def __init__(self, block: np.ndarray):
        sizes = block[1:1 + int(block[0])]
        at = np.cumsum([1 + len(sizes), *sizes])
        self.keys, self.to, self.skip, self.final, self.offsets, self.ids = (
            block[a:b] for a, b in zip(at[:-1], at[1:]))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if it is not in the lexicon."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return out
        lens = np.array([len(w) for w in words])
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        alive = np.flatnonzero(lens > 0)
        state, total = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        step = 0
        while len(alive):
            key = state * 256 + data[start[alive] + step]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[pos] == key
            alive, pos = alive[ok], pos[ok]
            state, total = self.to[pos], total[ok] + self.skip[pos]
            step += 1
            ends = lens[alive] == step
            out[alive[ends]] = np.where(self.final[state[ends]] == 1, total[ends], -1)
            alive, state, total = alive[~ends], state[~ends], total[~ends]
        return out

    def sequence(self, number: int) -> list[int]:
        return self.ids[self.offsets[number]:self.offsets[number + 1]].tolist()
