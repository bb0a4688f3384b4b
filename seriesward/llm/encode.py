"""Encode columns of texts with a public tokenizer, each distinct piece of a slice only once."""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import LOWER, coded, filled, gather, split_words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: How a tokenizer's texts may be cut without a change of its ids.
#: dropped: white space only separates words. leading: one blank belongs to the word after it. whole: never cut.
PIECES = ("dropped", "leading", "whole")
MOST_PIECES = 400_000

#: Texts with white space other than single blanks and line breaks between words; they are encoded whole.
_ODD = (
    "[\\x00-\\x09\\x0b-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
    "|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
)
#: Pieces that normalising and splitting leave as they are.
_PLAIN = {"dropped": re.compile("[a-zß-öø-ÿ]+"), "leading": re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")}
_BYTE = np.arange(256)
_LETTER = ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) & (_BYTE < 128)
_PUNCT = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~((_BYTE >= 48) & (_BYTE <= 57)) & (_BYTE != 39)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it is printable, else as the next free letter from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) if b in kept else chr(256 + sum(1 for x in range(b) if x not in kept)) for b in range(256)}


_LETTERS = _byte_letters()
_loaded: dict = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids. Keeps the ids of the pieces met so far, ``MOST_PIECES`` at most, then starts anew."""

    def __init__(self, path: str, pieces: str = "whole"):
        from tokenizers import Tokenizer

        if pieces not in PIECES:
            raise ValueError(f"pieces is one of {PIECES}")
        self.tokenizer, self.pieces = Tokenizer.from_file(path), pieces
        self._forget()

    def _forget(self):
        self._index: dict[str, int] = {}
        self._ids, self._n = np.empty(1 << 16, np.uint32), 0
        self._starts, self._lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def rest(self):
        """After a task: forget the pieces and give memory back to the system; an idle worker would keep it."""
        self._forget()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
        if trim:
            trim(0)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """As ``_encode``; plain words go straight to the model."""
        model, plain, letters = self.tokenizer.model, _PLAIN[self.pieces].fullmatch, _LETTERS
        out, rest = [], []
        for k, t in enumerate(texts):
            if plain(t):
                out.append([x.id for x in model.tokenize(t.encode().decode("latin-1").translate(letters))])
            else:
                out.append(None)
                rest.append(k)
        for k, ids in zip(rest, self._encode([texts[k] for k in rest])):
            out[k] = ids
        return out

    def _places(self, texts: list[str]) -> np.ndarray:
        """Where the ids of these texts are, encoding those not met before."""
        if len(self._index) + len(texts) > MOST_PIECES:
            self._forget()
        index = self._index
        new = [t for t in texts if t not in index]
        for at in range(0, len(new), 20_000):
            ids = self._pieces(new[at : at + 20_000])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            total, first = int(lengths.sum()), len(index)
            while self._n + total > len(self._ids):
                self._ids = np.concatenate([self._ids, np.empty_like(self._ids)])
            while first + len(ids) > len(self._starts):
                self._starts = np.concatenate([self._starts, np.empty_like(self._starts)])
                self._lengths = np.concatenate([self._lengths, np.empty_like(self._lengths)])
            self._ids[self._n : self._n + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
            self._lengths[first : first + len(ids)] = lengths
            self._starts[first : first + len(ids)] = self._n + np.cumsum(lengths) - lengths
            self._n += total
            for k, t in enumerate(new[at : at + 20_000]):
                index[t] = first + k
        return np.fromiter((index[t] for t in texts), np.int64, len(texts))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: none), and where each text's ids begin (one entry more than texts)."""
        column = filled(column)
        if self.pieces == "dropped":
            return self._joined(*split_words(self._cut(column)))
        if self.pieces == "leading":
            odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(column), bool)
        if odd.all():
            return self._whole(column.to_pylist())
        plain = self._lead(column.filter(pa.array(~odd)))
        if not odd.any():
            return plain
        whole = self._whole(column.filter(pa.array(odd)).to_pylist())
        lengths, starts = np.empty(len(column), np.int64), np.empty(len(column), np.int64)
        for mask, (_, offsets), base in ((~odd, plain, 0), (odd, whole, len(plain[0]))):
            lengths[mask], starts[mask] = np.diff(offsets), base + offsets[:-1]
        ids = np.concatenate([plain[0], whole[0]])[gather(starts, lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(texts)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        return flat, np.concatenate([[0], np.cumsum(lengths)])

    def _cut(self, column: pa.Array) -> pa.Array:
        """Separators where a new piece begins: between a letter and a sign after it, which no tokenizer here joins,
        and with ``leading`` around line breaks and before blanks. Capitals fold where white space is dropped."""
        column = filled(column)
        _, offsets, data = column.buffers()
        text = data.to_pybytes() if data is not None else b""
        at = np.frombuffer(offsets, np.int64)[: len(column) + 1]
        if not text:
            return column
        fold = self.pieces == "dropped"
        special = b"<|" in text  # may spell a special token
        if fold and not special:
            text = text.translate(LOWER)
        raw = np.frombuffer(text, np.uint8)
        mark = np.zeros(len(raw), bool)
        if not special:
            letter = _LETTER[raw]
            after = raw[1:] >= 0x80
            letter[1:] |= after & (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            mark[1:] = _PUNCT[raw[1:]] & letter[:-1]
        if not fold:
            breaks = raw == 10
            mark |= breaks | (raw == 32)
            mark[1:] |= breaks[:-1]
        places = np.flatnonzero(mark)
        out = np.full(len(raw) + len(places), 32 if fold else 0, np.uint8)
        kept = np.ones(len(out), bool)
        kept[places + np.arange(len(places))] = False
        out[kept] = raw
        moved = at + np.searchsorted(places, at)
        return pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(out)])

    def _lead(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces: a line break, a line's first word, a later word with its blank, signs after a word."""
        lists = pc.split_pattern(self._cut(column), "\x00")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return self._joined(lists.values[offsets[0] : offsets[-1]], offsets - offsets[0])

    def _joined(self, pieces: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = coded(pieces)
        places = self._places(distinct)
        starts, lengths = self._starts[places], self._lengths[places]
        each = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        return self._ids[gather(starts[codes], each)], ends[offsets]


def encoder(path: str, pieces: str) -> Encoder:
    """The worker's encoder of this vocabulary."""
    if (path, pieces) not in _loaded:
        _loaded[path, pieces] = Encoder(path, pieces)
    return _loaded[path, pieces]
