"""Runs of words as byte ranges of one buffer, and XXH64 of many ranges at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from . import text as tx

#: As LOWER; ASCII white space becomes a blank.
SPACED = bytes(32 if 9 <= c <= 13 else c for c in tx.LOWER)
VECTOR_BYTES = 4096  # longer ranges are hashed one by one

# Fixed values of XXH64.
_P1, _P2, _P3 = np.uint64(11400714785074694791), np.uint64(14029467366897019727), np.uint64(1609587929392839161)
_P4, _P5 = np.uint64(9650029242287828579), np.uint64(2870177450012600261)


def packed_words(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, at) of the words of all texts, where ``table`` maps what divides words to a blank. Words of
    a text lie in order with one blank between them, so that a run of words is one range. ``at``: where each text's
    words begin (one entry more than texts)."""
    column = tx.translated(texts, table)
    _, offsets, data = column.buffers()
    n = len(column)
    if data is None or not data.size or not n:
        empty = np.empty(0, np.int64)
        return np.zeros(8, np.uint8), empty, empty, np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[: n + 1]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]]
    word = raw != 32
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, after = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    after[:-1] &= ~word[1:] | edge[1:-1]
    starts, lasts = np.flatnonzero(first), np.flatnonzero(after)
    keep = word.copy()
    keep[1:] |= word[:-1]
    place = np.cumsum(keep) - 1
    buffer = np.concatenate([raw[keep], np.zeros(8, np.uint8)])
    return buffer, place[starts], place[lasts] + 1, np.searchsorted(starts, offsets)


def runs(at: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, at) of all runs of ``width`` consecutive words, text by text; with ``short``, a text of fewer words
    is one run."""
    n = np.diff(at)
    m = np.maximum(n - width + 1, (n > 0) if short else 0)
    first = tx.gather(at[:-1], m)
    last = np.minimum(first + width - 1, np.repeat(at[1:] - 1, m))
    return first, last, np.concatenate([[0], np.cumsum(m)])


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _lane(total, lane: np.ndarray) -> np.ndarray:
    return _turned(total + lane * _P2, 31) * _P1


def _stripes(eight: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The state after all whole stripes of 32 bytes; ranges in descending order of size, each of one stripe or more."""
    v = [np.full(len(at), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
    at, stripes = at.copy(), size >> 5
    for k in range(int(stripes[0])):
        go = int(np.searchsorted(-stripes, -k, side="left"))  # those with more than k come first
        for j in range(4):
            v[j][:go] = _lane(v[j][:go], eight[at[:go] + 8 * j])
        at[:go] += 32
    joined = _turned(v[0], 1) + _turned(v[1], 7) + _turned(v[2], 12) + _turned(v[3], 18)
    for x in v:
        joined = (joined ^ _lane(np.uint64(0), x)) * _P1 + _P4
    return joined


def xxh64(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of the ranges of ``buffer``, which ends with eight bytes that belong to none."""
    eight = np.ndarray(len(buffer) - 7, "<u8", buffer=buffer, strides=(1,))
    four = np.ndarray(len(buffer) - 3, "<u4", buffer=buffer, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.full(len(starts), np.uint64(seed) + _P5, np.uint64)
        wide = np.flatnonzero(lengths >= 32)
        if len(wide):
            wide = wide[np.argsort(-lengths[wide], kind="stable")]
            wide = wide[int(np.searchsorted(-lengths[wide], -VECTOR_BYTES, side="left")) :]
        if len(wide):
            h[wide] = _stripes(eight, starts[wide], lengths[wide], np.uint64(seed))
        h += lengths.astype(np.uint64)
        left, at = lengths & 31, starts + (lengths & ~31)
        for k in range(3):
            go = np.flatnonzero(left >> 3 > k)
            h[go] = _turned(h[go] ^ _lane(np.uint64(0), eight[at[go] + 8 * k]), 27) * _P1 + _P4
        at, left = at + (left & 24), left & 7
        go = np.flatnonzero(left >= 4)
        h[go] = _turned(h[go] ^ (four[at[go]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at, left = at + (left & 4), left & 3
        for k in range(3):
            go = np.flatnonzero(left > k)
            h[go] = _turned(h[go] ^ (buffer[at[go] + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(lengths > VECTOR_BYTES):
        h[k] = xxhash.xxh64_intdigest(buffer[starts[k] : starts[k] + lengths[k]].tobytes(), seed)
    return h
