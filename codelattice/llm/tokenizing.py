"""Whole-text encoding with a public tokenizer file, one library call per distinct piece of text.

A byte-pair tokenizer first cuts a text into pieces by a pattern and then encodes each piece
alone. Texts are cut here only at places where that pattern always cuts (before white space that
follows a non-space, and between a run of Latin letters and a run of ASCII punctuation), so the
ids of the parts, in order, are the ids of the text.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from codelattice.llm.common import words_of

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: ASCII punctuation without the apostrophe, which starts contractions.
MARKS = re.escape('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
PARTS = re.compile(rf"[{LETTERS}]++(?![^{LETTERS}{MARKS}])|[{MARKS}]++(?![^{LETTERS}{MARKS}])|.++", re.DOTALL)
PLAIN = re.compile(rf"[{LETTERS}]+|[{MARKS}]+")
#: The usual word. With marks after it, it is not held itself: its parts mostly are.
USUAL = re.compile(rf"( ?)([{LETTERS}]+)([{MARKS}]*)")
SPACED = re.compile(r"\s*+\S++|\s++")
#: Texts with any of these leave the fast path: runs of white space, other white space, edges, the marker.
ODD_SPACE = r"[ \n]{2}|[\t\r\f\v\x00\x1c-\x1f]|\x{85}|^[ \n]|[ \n]$|[\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level tokenizers use for each byte (the public rule)."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


class PieceEncoder:
    """Encodes batches of texts; keeps at most ``cache`` distinct pieces between batches.

    The pieces are held in two halves: a full ``young`` half becomes the ``old`` one, and what is
    found there moves back. So words that go on occurring stay when many new ones come.
    """

    def __init__(self, path: str, cache: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        described = json.loads(self.tokenizer.to_str())
        self.lowers = "Lowercase" in json.dumps(described["normalizer"])
        self.spaces = described["normalizer"] is None  # white space is kept as part of pieces
        self.model = self.tokenizer.model
        self.letters = byte_alphabet()
        self.young, self.old, self.half = {}, {}, max(cache // 2, 1)

    def _plain(self, piece: str, lead: str) -> bytes:
        """Ids of one run of letters or marks, with the byte-level sign of a space before it."""
        if self.lowers:
            piece = piece.lower()
            if not PLAIN.fullmatch(piece):
                return self._library(piece)
        if not piece.isascii():  # ASCII letters and marks stand for themselves
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(lead + piece)]).tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _solved(self, text: str) -> bytes:
        """Ids of a piece that is not held."""
        lead, rest = "", text
        if self.spaces and text[:1] == " ":
            lead, rest = self.letters[32], text[1:]
        elif self.spaces and text[:1] == "\n" and len(text) > 1 and not text[1].isspace():
            return self.piece("\n") + self.piece(text[1:])
        if not rest or not PLAIN.fullmatch(rest):
            parts = PARTS.findall(rest)
            if len(parts) > 1:
                return self.piece(text[: len(text) - len(rest)] + parts[0]) + b"".join(map(self.piece, parts[1:]))
            return self._library(text)
        return self._plain(rest, lead)

    def piece(self, text: str) -> bytes:
        """Ids of one word with the white space before it, as bytes of uint32."""
        done = self.young.get(text)
        if done is None:
            done = self.old.get(text)
            if done is None:
                space, letters, marks = usual.groups() if (usual := USUAL.fullmatch(text)) else ("", "", "")
                if marks:
                    return self.piece(space + letters) + self.piece(marks)
                done = self._plain(letters, space and self.letters[32]) if letters and (self.spaces or not space) else self._solved(text)
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[text] = done
        return done

    def _lookup(self, flat: pa.Array, counts: np.ndarray, before: str) -> tuple[np.ndarray, np.ndarray]:
        coded = flat.dictionary_encode()
        found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if before:
            found = ["\n" + w[1:] if w[:1] == "\x00" else before + w for w in found]
        out = pa.array(list(map(self.piece, found)), pa.large_binary()).take(coded.indices)
        raw = out.buffers()[2]
        places = np.concatenate([[0], np.cumsum(pc.binary_length(out).to_numpy(zero_copy_only=False) // 4, dtype=np.int64)])
        ends = np.cumsum(counts)
        return np.frombuffer(raw, np.uint32, places[-1]) if places[-1] else np.zeros(0, np.uint32), places[ends] - places[ends - counts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and how many each text has."""
        if not self.spaces:
            return self._lookup(*words_of(texts, self.lowers), "")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        ids, sizes = [None] * len(texts), np.zeros(len(texts), np.int64)
        if not odd.all():
            plain = texts.filter(pa.array(~odd))
            # The first word has no space before it; a marker stands for the line ends.
            first = pc.extract_regex(plain, r"^(?P<w>[^ \n]*)").field("w")
            lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \x00"), " ")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            starts = np.cumsum(counts) - counts
            keep = np.ones(len(flat), bool)
            keep[starts] = False
            body, size = self._lookup(flat.filter(pa.array(keep)), counts - 1, " ")
            heads = [self.piece(w) for w in first.to_pylist()]
            ends = np.cumsum(size)
            for k, (i, head) in enumerate(zip(np.flatnonzero(~odd), heads, strict=True)):
                ids[i] = (np.frombuffer(head, np.uint32), body[ends[k] - size[k] : ends[k]])
                sizes[i] = len(head) // 4 + size[k]
        for i in np.flatnonzero(odd):
            one = np.frombuffer(b"".join(map(self.piece, SPACED.findall(texts[int(i)].as_py()))), np.uint32)
            ids[i], sizes[i] = (one,), len(one)
        return np.concatenate([p for parts in ids for p in parts]) if ids else np.zeros(0, np.uint32), sizes


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one end id to every document."""
    at = np.cumsum(sizes)
    return np.insert(ids, at, np.uint32(end)), sizes + 1
