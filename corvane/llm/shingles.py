"""Word and shingle hashes of whole batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, 1 << 16), base, np.uint64)
        row[0] = 1
        have = _powers[base] = np.multiply.accumulate(row)
    return have[:n]


def text_slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with a bounded number of text bytes (one long text may have more)."""
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    start = 0
    for i in range(1, len(texts) + 1):
        if i == len(texts) or ends[i + 1] - ends[start] > most_bytes:
            yield batch.slice(start, i - start)
            start = i


def raw_texts(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (nulls: none) and where each begins and ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words, and each text's first word and the one after its last."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64), np.zeros(len(ends) - 1, np.int64)
    space = _IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    word = ~space
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    stops = np.flatnonzero(word & (after | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * powers(_INVERSE, n)[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, ends[:-1]), np.searchsorted(starts, ends[1:])


def shingle_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, in order, and where each text's begin and end.

    A text of fewer words, but not none, has one: all its words.
    """
    n_words = last - first
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first - ends[:-1], counts) + np.arange(ends[-1])
    length = np.repeat(np.minimum(n_words, size), counts)
    total = length.astype(np.uint64) * _PLACE[15]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    short = (n_words < size).any()
    for k in range(size):
        part = padded[at + k] * _PLACE[k]
        total += np.where(k < length, part, _U(0)) if short else part
    return mix(total), ends


def distinct(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and where they begin and end."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return (np.concatenate(sets) if sets else hashes[:0]), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def segment_reduce(ufunc: np.ufunc, values: np.ndarray, ends: np.ndarray, empty: int = 0) -> np.ndarray:
    """ufunc over each text's values; texts without values get empty."""
    out = np.full(len(ends) - 1, empty, values.dtype)
    full = ends[1:] > ends[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, ends[:-1][full])
    return out
