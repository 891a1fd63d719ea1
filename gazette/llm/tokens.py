"""Words of whole texts as 64-bit hashes, taken over Arrow buffers with numpy.

A word's hash is a polynomial over its bytes modulo 2**64 with a table of random byte
values, so the hashes of all words of a batch come from one running sum. Words of more than SHORT bytes, for which
polynomials of this kind have constructible collisions, are hashed one by one by xxhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
#: Bytes worked on at a time; a longer text is taken whole.
STEP = 1 << 20
#: Bytes of the longest word that is hashed by the running sum.
SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit keys over all others."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_VALUES = mix((np.arange(1, 257, dtype=U64)) * U64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = {_BASE: np.ones(1, U64), _BACK: np.ones(1, U64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if len(_powers[base]) < n:
        factors = np.full(n, base, U64)
        factors[0] = 1
        out = np.multiply.accumulate(factors)
        if n > 2 * STEP:
            return out
        _powers[base] = out
    return _powers[base][:n]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins and ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(at, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


#: Everything but ASCII letters, digits and the bytes of other scripts.
SIGNS = np.ones(256, dtype=bool)
SIGNS[128:] = False
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def spans(data: np.ndarray, ends: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word, and the number of words before each text."""
    solid = ~blank[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def _groups(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about STEP bytes."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + STEP, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hashed(texts: pa.Array, lower: bool = True, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of words before each text (one more than texts)."""
    data, ends = raw(texts)
    out, counts = [], [np.zeros(1, np.int64)]
    total = 0
    for i, j in _groups(ends):
        own, at = data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        starts, stops, before = spans(own, at, blank)
        part = _LOWER[own] if lower else own
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_VALUES[part] * _power(_BASE, len(part) + 1)[: len(part)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * _power(_BACK, len(part) + 1)[starts]
        h = mix(h + (stops - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
        for w in np.flatnonzero(stops - starts > SHORT).tolist():
            h[w] = xxhash.xxh64_intdigest(part[starts[w] : stops[w]].tobytes())
        out.append(h)
        counts.append(before[1:] + total)
        total += len(starts)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate(counts)


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; shorter input gives none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(k), U64)
    for i in range(k):
        out = out * U64(0x2545F4914F6CDD1D) + h[i : i + n]
        out ^= out >> U64(29)
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values of a short array."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingles(texts: pa.Array, k: int = 5, at_once: int = 1024) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``k`` words; fewer words make one run; none, none."""
    for i in range(0, len(texts), at_once):
        h, at = hashed(texts.slice(i, at_once))
        runs = chained(h, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield distinct(runs[a : b - k + 1] if b - a >= k else chained(h[a:b], b - a) if b > a else h[:0])
