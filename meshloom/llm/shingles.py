"""Word shingles of whole batches of texts, hashed with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18
_DRAW = np.random.default_rng(20240611)
_BYTE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_MULTIPLIER)
_DOWN = _powers(pow(_MULTIPLIER, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of bytes; equal spans get equal hashes wherever they are.

    Prefix sums of a polynomial are taken over chunks; a span that crosses
    chunks is put together from its parts, so its place doesn't matter.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    for base in range(0, len(data), _CHUNK):
        top = min(base + _CHUNK, len(data))
        a, b = np.searchsorted(ends, base, side="right"), np.searchsorted(starts, top, side="left")
        if a == b:
            continue
        sums = np.empty(top - base + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data[base:top]] * _UP[: top - base], out=sums[1:])
        s, e = np.maximum(starts[a:b], base) - base, np.minimum(ends[a:b], top) - base
        part = (sums[e] - sums[s]) * _DOWN[s]
        over = starts[a:b] < base  # only the first can begin in an earlier chunk
        if over.any():
            for k in np.flatnonzero(over):
                part[k] = int(part[k]) * pow(_MULTIPLIER, int(base - starts[a + k]), 1 << 64) & 0xFFFFFFFFFFFFFFFF
        out[a:b] += part
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts on end and the offset of each, with the end's."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.frombuffer(data.tobytes().lower(), dtype=np.uint8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``words`` words.

    A text of fewer words has its whole sequence as the only one; one without
    words has none.
    """
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = True, True
    np.not_equal(space[1:], space[:-1], out=edge[1:-1])
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    word = ~space[starts] if len(starts) else np.empty(0, bool)
    starts, ends = starts[word], ends[word]
    hashes = span_hashes(data, starts, ends)
    factors = [np.uint64(f) for f in (0x9DDFEA08EB382D69 ^ np.arange(words, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)]
    n = max(0, len(hashes) - words + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k, f in enumerate(factors):
        grams = mix(grams + hashes[k : k + n] * f)
    first = np.searchsorted(starts, offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            own = np.sort(grams[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            one = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + 1])
            out.append(one)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
