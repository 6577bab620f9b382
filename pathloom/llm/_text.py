"""Array kernels over the bytes of many texts at once.

A piece of texts is one run of UTF-8 bytes; word limits, word hashes and windows of words come from whole-array
operations, so that Python runs a few instructions per piece and not per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes up to which spans are hashed side by side, eight bytes a round; longer ones are hashed one by one.
ROUNDS = 4
#: The low 0 to 8 bytes of a number.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: An odd factor for each word of a window.
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit moves each output bit, and no two inputs have one output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 limits between them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data is not None and limits[-1] > limits[0] else np.zeros(0, np.uint8)
    return data, limits - limits[0]


def runs(member: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a limit."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[limits] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, member[:-1]
    starts = np.flatnonzero(member & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, member[1:]
    return starts, np.flatnonzero(member & (~after | cut[1:])) + 1


def words(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, a longest run without 0x20 or 0x09-0x0D."""
    starts, ends = runs(~_SEPARATORS[data], limits)
    return starts, ends, np.searchsorted(limits, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies; with `lower`, of A-Z as a-z. Eight bytes
    at a time go through `mix`, so spans of one length up to eight bytes never share a hash, and others by chance only."""
    import xxhash

    if lower:
        data = _LOWER[data]
    starts, size = np.asarray(starts, np.int64), np.asarray(ends - starts, np.int64)
    eights = np.zeros(len(data) // 8 + 2, "<u8")
    eights.view(np.uint8)[: len(data)] = data
    out = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(1))
    for r in range(ROUNDS):
        if not r:
            at, place, left = slice(None), starts, size
        else:
            at = np.flatnonzero((size > 8 * r) & (size <= 8 * ROUNDS))
            if not len(at):
                break
            place, left = starts[at] + 8 * r, size[at] - 8 * r
        first, turn = place >> 3, ((place & 7) << 3).astype(np.uint64)
        value = (eights[first] >> turn) | ((eights[first + 1] << U(1)) << (U(63) - turn))
        out[at] = mix(out[at] ^ (value & _LOW[np.clip(left, 0, 8)]))
    for i in np.flatnonzero(size > 8 * ROUNDS).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + size[i]])
    return out


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's number of each run of `size` words of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += hashes[k : k + n] * _FACTORS[k]
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    return mix(h[first]), first


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `size`-word shingles, A-Z lowered; a text with fewer words has
    its whole sequence as one shingle, a text without words none."""
    data, limits = raw(column)
    starts, ends, owner = words(data, limits)
    h = span_hashes(data, starts, ends, lower=True)
    shingles, first = windows(h, owner, size)
    n = len(column)
    at = np.searchsorted(owner[first], np.arange(n + 1))
    word_at = np.searchsorted(owner, np.arange(n + 1))
    out = []
    for i in range(n):
        s = shingles[at[i] : at[i + 1]]
        count = word_at[i + 1] - word_at[i]
        if 0 < count < size:
            s = np.full(1, count, np.uint64)
            for x in h[word_at[i] : word_at[i + 1]]:
                s = mix(s * U(0xD6E8FEB86659FD93) + x)
        elif len(s):
            s = np.sort(s)
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        out.append(s)
    return out
