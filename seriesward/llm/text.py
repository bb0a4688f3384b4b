"""Arrow helpers: batches in bounded slices, ASCII folding, words as integer codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

#: Every byte to itself, A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER; every ASCII byte that is no letter and no digit becomes a blank.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def spare(df, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(df, text):
    """``df`` with ``text`` as a string, and the name it has there: that of the column itself where it is a string, so
    that texts aren't sent to the workers twice; else a new last column."""
    if dict(df.dtypes).get("text") == "string":
        return df, "text"
    name = spare(df, "_text")
    return df.withColumn(name, text.cast("string")), name


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of ``column``; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def filled(column: pa.Array) -> pa.Array:
    """Strings without nulls and without an offset into a larger buffer."""
    out = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([out]) if not out.offset else pa.array(out.to_pylist(), pa.large_string())


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """Each byte of the texts mapped by ``table``, which leaves bytes from 128 on as they are."""
    column = filled(column)
    _, offsets, data = column.buffers()
    if data is None or not data.size:
        return column
    return pa.Array.from_buffers(pa.large_string(), len(column), [None, offsets, pa.py_buffer(data.to_pybytes().translate(table))])


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and where each text's words begin (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(column)
    words, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    words, offsets = words[offsets[0] : offsets[-1]], offsets - offsets[0]
    keep = pc.greater(pc.binary_length(words), 0)
    if pc.all(keep, min_count=0).as_py():
        return words, offsets
    # The splitter yields empty words at the ends of a text.
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return words.filter(keep), before[offsets]


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """An integer per word, and the distinct words these integers stand for."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def hashed(strings: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each string, the same on every machine."""
    return pd.util.hash_array(np.array(strings, dtype=object), categorize=False) if strings else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
