"""Word and shingle hashes of whole texts, from Arrow buffers, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 21  # bytes of text worked on at once; a longer text is a chunk of its own
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = U(0x9E3779B97F4A7C15)
_STEP = U(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, 1024), _BASE))])
    return _powers


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts buf[offs[i]:offs[i+1]], and where each text's words begin."""
    ns = _WORD[buf]
    start = ns.copy()
    start[1:] &= ~ns[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    start[heads] = ns[heads]
    at = np.flatnonzero(ns)
    if not len(at):
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    first = np.flatnonzero(start[at])
    lens = np.diff(np.append(first, len(at)))
    pos = np.arange(len(at)) - np.repeat(first, lens)
    vals = (_LOWER[buf[at]].astype(U) + U(1)) * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(vals, first)), np.searchsorted(at[first], offs)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of consecutive texts; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[
        texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        yield i, raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of every text.

    A shingle is ``width`` consecutive words; a text of fewer words has its
    whole sequence as the only one, a text without words none.
    """
    weights = np.cumprod(np.full(width, _STEP))
    for base, buf, offs in chunks(texts):
        h, at = word_hashes(buf, offs)
        n = len(h) - width + 1
        if n > 0:
            every = h[:n] * weights[0]
            for k in range(1, width):
                every += h[k:k + n] * weights[k]
            every = mix(every)
        for d in range(len(offs) - 1):
            a, b = at[d], at[d + 1]
            if b - a >= width:
                s = np.sort(every[a:b - width + 1])
                yield base + d, s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                yield base + d, mix(np.sum(h[a:b] * weights[:b - a], keepdims=True) + U(b - a))
            else:
                yield base + d, np.zeros(0, U)
