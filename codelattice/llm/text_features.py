"""Per-text counts that the quality operators share, computed for a slice of whole texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codelattice.llm.common import words_of

BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 8


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (the finaliser of SplitMix64), element-wise."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, counts: np.ndarray, width: int = WINDOW_WORDS) -> np.ndarray:
    """Per text: words inside windows of ``width`` words that the text holds twice or more.

    Windows meet as 64-bit hashes of their word codes; the texts of a slice never mix.
    """
    n = len(codes)
    owner = np.repeat(np.arange(len(counts)), counts)
    if n < width:
        return np.zeros(len(counts), np.int64)
    each, key = mixed(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + each[j : n - width + 1 + j]
    inside = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    key = mixed(key[inside] + owner[inside].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    # A hash of the hash first: only windows that share its place with another are sorted.
    bits = max(10, min(22, int(len(key)).bit_length() + 1))
    place = (key >> np.uint64(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.bincount(place, minlength=1 << bits)[place] > 1)
    order = some[np.argsort(key[some], kind="stable")]
    ranked = key[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    starts = inside[order[same[1:] | same[:-1]]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=len(counts)).astype(np.int64)


class TextCounts:
    """Counts of a slice; everything dear is computed on first use and only once."""

    def __init__(self, texts: pa.Array):
        self.texts, self.n = texts, len(texts)
        self._strings = self._bytes = self._codes = self._lines = self._distinct = None
        flat, self.n_words = words_of(texts, lower=False)
        self.flat = flat
        owner = np.repeat(np.arange(self.n), self.n_words)
        self.word_chars = np.bincount(owner, weights=pc.utf8_length(flat).to_numpy(zero_copy_only=False), minlength=self.n).astype(np.int64)

    def strings(self) -> list[str]:
        if self._strings is None:
            self._strings = self.texts.to_pylist()
        return self._strings

    def byte_counts(self) -> np.ndarray:
        """How often each byte value occurs in each text."""
        if self._bytes is None:
            out = np.zeros((self.n, 256), np.int64)
            for i, t in enumerate(self.texts):
                if raw := t.as_buffer():
                    out[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            self._bytes = out
        return self._bytes

    def codes(self) -> np.ndarray:
        if self._codes is None:
            self._codes = self.flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return self._codes

    def symbols(self) -> np.ndarray:
        return self.byte_counts()[:, list(SYMBOLS)].sum(1)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them equal to an earlier line."""
        if self._lines is None:
            filled, same = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            for i, t in enumerate(self.strings()):
                own = [x for x in t.split("\n") if x.strip(BLANKS)]
                filled[i], same[i] = len(own), len(own) - len(set(own))
            self._lines = filled, same
        return self._lines

    def repeats(self) -> np.ndarray:
        return repeated_words(self.codes(), self.n_words)

    def distinct_words(self) -> np.ndarray:
        owner = np.repeat(np.arange(self.n, dtype=np.int64), self.n_words)
        codes = self.codes()
        if not len(codes):
            return np.zeros(self.n, np.int64)
        pairs = np.unique(owner * (int(codes.max()) + 1) + codes)
        return np.bincount(pairs // (int(codes.max()) + 1), minlength=self.n).astype(np.int64)

    def at(self, rows: np.ndarray) -> RowCounts:
        return RowCounts(self, rows)


class RowCounts:
    """The counts of some rows of a slice. Cheap counts are shared with the slice; others cover these rows alone."""

    def __init__(self, whole: TextCounts, rows: np.ndarray):
        self.whole, self.rows = whole, rows
        self.n_words, self.word_chars = whole.n_words[rows], whole.word_chars[rows]

    def byte_counts(self) -> np.ndarray:
        return self.whole.byte_counts()[self.rows]

    def symbols(self) -> np.ndarray:
        return self.whole.symbols()[self.rows]

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x[self.rows] for x in self.whole.lines())

    def distinct_words(self) -> np.ndarray:
        """Distinct words of these rows only."""
        whole = self.whole
        owner = np.repeat(np.arange(whole.n, dtype=np.int64), whole.n_words)
        wanted = np.zeros(whole.n, bool)
        wanted[self.rows] = True
        keep = wanted[owner]
        if not keep.any():
            return np.zeros(len(self.rows), np.int64)
        codes, span = whole.codes()[keep], int(whole.codes().max()) + 1
        return np.bincount(np.unique(owner[keep] * span + codes) // span, minlength=whole.n)[self.rows].astype(np.int64)
