"""Sets of word shingles as sorted 64-bit hashes, and their MinHash samples and odd sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import text as tx

BANDS, ROWS, BITS = 48, 4, 512
SAMPLES = BANDS * ROWS
_seeds = np.random.default_rng(20240229)
_A = (_seeds.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _seeds.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct shingles, sorted, one text after the other; and where each text's begin (one entry more
    than texts). Fewer words than ``width`` are one shingle; no words, none."""
    words, at = tx.split_words(tx.translated(texts, tx.LOWER))
    codes, distinct = tx.coded(words)
    own = tx.hashed(distinct)[codes] if len(distinct) else np.empty(0, np.uint64)
    n = np.diff(at)
    rolled = own.copy()
    for j in range(1, width):
        rolled = tx.mixed(rolled[: max(0, len(own) - j)]) + own[j:]
    rolled = tx.mixed(rolled)
    sets, ends = [], np.zeros(len(n) + 1, np.int64)
    for k, m in enumerate(n):
        if m >= width:
            some = np.unique(rolled[at[k] : at[k + 1] - width + 1])
        elif m:
            x = own[at[k] : at[k] + 1]
            for j in range(1, m):
                x = tx.mixed(x) + own[at[k] + j : at[k] + j + 1]
            some = tx.mixed(x + np.uint64(m))
        else:
            some = rolled[:0]
        sets.append(some)
        ends[k + 1] = ends[k] + len(some)
    return (np.concatenate(sets) if sets else rolled[:0]), ends


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit sums per set that identify it; zero for empty sets."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[full, j] = np.add.reduceat(tx.mixed(sets ^ np.uint64(salt)), at[full])
    return out.view(np.int64)


def samples(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of MinHash samples per set that isn't empty."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), SAMPLES), np.uint32)
    if len(starts):
        x = (sets >> np.uint64(32)).astype(np.uint32)
        buffer = np.empty_like(x)
        for i in range(SAMPLES):
            np.multiply(x, _A[i], out=buffer)
            buffer += _B[i]
            out[:, i] = np.minimum.reduceat(buffer, starts)
    return out


def bands(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of ROWS samples; keys of different bands differ too."""
    x = mins.astype(np.uint64).reshape(len(mins), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(mins), BANDS)).copy()
    for j in range(ROWS):
        key = tx.mixed(key + x[:, :, j] + np.uint64(1))
    return key.view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Each sample flips one of BITS bits: rows of BITS / 8 bytes. Samples that two sets share cancel in the XOR."""
    place = (tx.mixed(mins.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)
    flat = np.bincount((place + BITS * np.arange(len(mins))[:, None]).ravel(), minlength=BITS * len(mins))
    return np.packbits((flat & 1).astype(np.uint8).reshape(len(mins), BITS), axis=1)


def most_odd_bits(similarity: float, deviations: float = 6.0) -> int:
    """A bound on the XOR's population count that sets of this similarity stay below with near certainty."""
    differ = SAMPLES * (1 - similarity)
    mean = BITS / 2 * (1 - np.exp(-4 * differ / BITS))
    slope = 2 * np.exp(-4 * differ / BITS)
    spread = slope**2 * differ * similarity + BITS / 4 * (1 - np.exp(-8 * differ / BITS))
    return int(mean + deviations * np.sqrt(spread))


def parities(sets: np.ndarray, at: np.ndarray, least: int = 256, most: int = 8192) -> list[bytes]:
    """An odd sketch of each whole set that isn't empty: a power of two of bits, four per element or more up to ``most``."""
    out = []
    for k in np.flatnonzero(np.diff(at)):
        own = sets[at[k] : at[k + 1]]
        bits = min(most, max(least, 1 << int(4 * len(own) - 1).bit_length()))
        out.append(np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def _folded(parity: list[bytes], words: int) -> np.ndarray:
    """Parity sketches as rows of ``words`` 64-bit integers, longer ones folded by XOR, shorter ones left at 0."""
    out = np.zeros((len(parity), words), np.uint64)
    for k, raw in enumerate(parity):
        if len(raw) >= 8 * words:
            out[k] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)
    return out


def parity_distances(parity: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Population count of the XOR of two parity sketches each, the longer one folded; and their bits."""
    words = np.fromiter(map(len, parity), np.int64, len(parity)) // 8
    common = np.minimum(words[left], words[right])
    apart = np.empty(len(left), np.int64)
    for w in np.unique(common):
        mine = np.flatnonzero(common == w)
        rows, inverse = np.unique(np.concatenate([left[mine], right[mine]]), return_inverse=True)
        table = _folded([parity[k] for k in rows], int(w))
        a, b = inverse[: len(mine)], inverse[len(mine) :]
        step = max(1, 500_000 // int(w))
        for at in range(0, len(mine), step):
            apart[mine[at : at + step]] = np.bitwise_count(table[a[at : at + step]] ^ table[b[at : at + step]]).sum(axis=1)
    return apart, common * 64


def most_parity(total: np.ndarray, bits: np.ndarray, similarity: float, deviations: float = 6.0) -> np.ndarray:
    """A bound on that distance for sets of this similarity and total size. Elements in one set only flip a bit each, so
    their number is a sure bound; where they are many for the bits, collisions make the distance smaller."""
    differ = np.floor(total * (1 - similarity) / (1 + similarity) + 1e-9)
    mean = bits / 2 * (1 - np.exp(-2 * differ / bits))
    spread = np.sqrt(bits / 4 * (1 - np.exp(-4 * differ / bits)) * np.minimum(1, differ / bits))
    return np.minimum(differ, mean + deviations * spread + 1)
