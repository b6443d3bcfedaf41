"""SentencePiece encoding and decoding with a given model file.

An Aho-Corasick automaton over the pieces reads each text once; at every position its output links
name the pieces that end there, and each relaxes the best score of that position (Viterbi). Bytes
of characters that no piece covers fall back to the model's byte pieces. Where no piece holds a
word sign after another character the best path of a text is the best paths of its words one
after another, so a word is solved once and kept; a model with such pieces is solved per text.
Equal scores: the longer last piece wins.

Null text counts as empty (no ids, score 0). Repeated rows and keys give a row each. Extra columns
are ignored. Spaces are written as the word sign, one is put before a text that is not empty;
decoding takes it away again, so a text holding the word sign itself comes back with a space.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, ragged, text_slices

SIGN = "▁"
#: What an uncovered character costs beyond the worst piece, for each of its bytes.
UNKNOWN_PENALTY = 10.0


class PieceModel:
    """Pieces, scores, automaton and byte pieces of one model file; solved words are kept up to a bound."""

    def __init__(self, path: str, cache: int = 200_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.fallback = min((self.scores[i] for i in plain), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        self.automaton.make_automaton()
        self.singles = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1}
        self.by_word = not any(SIGN in self.pieces[i].lstrip(SIGN) for i in plain)
        self.no_break = not any("\n" in self.pieces[i] for i in plain)
        self.bytes = [self.pieces[i].encode() for i in range(n)]
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.cache, self.limit = {}, cache

    def solve(self, text: str) -> tuple[float, list[int]]:
        """Best path of one escaped text: its score and ids.

        Matches come by their end, so all paths to a piece's start are settled when the piece is met.
        A character with a piece of its own never needs its bytes, as those cost more.
        """
        n = len(text)
        best, size_to, piece_to = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        bare = [] if self.singles.issuperset(text) else [i for i, c in enumerate(text, 1) if c not in self.singles]
        for end, (size, score, piece) in self.automaton.iter(text):
            end += 1
            while bare and bare[0] < end:
                self._spell(text, bare.pop(0), best, size_to, piece_to)
            reached = best[end - size] + score
            if reached > best[end] or (reached == best[end] and size > size_to[end]):
                best[end], size_to[end], piece_to[end] = reached, size, piece
        for at in bare:
            self._spell(text, at, best, size_to, piece_to)
        ids, at = [], n
        while at:
            if piece_to[at] < 0:
                ids.extend(self.byte_ids.get(b, self.unknown) for b in reversed(text[at - 1].encode("utf-8", "replace")))
            else:
                ids.append(piece_to[at])
            at -= size_to[at]
        ids.reverse()
        return best[n], ids

    def _spell(self, text: str, at: int, best: list, size_to: list, piece_to: list) -> None:
        """Relax the end of an uncovered character by its bytes."""
        cost = best[at - 1] + self.fallback * len(text[at - 1].encode("utf-8", "replace"))
        if cost > best[at]:
            best[at], size_to[at], piece_to[at] = cost, 1, -1

    def unit(self, text: str) -> tuple[float, bytes]:
        found = self.cache.get(text)
        if found is None:
            score, ids = self.solve(text)
            if len(self.cache) >= self.limit:
                self.cache.clear()
            found = self.cache[text] = (score, array("I", ids).tobytes())
        return found

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = SIGN + text.replace(" ", SIGN)
        return re.findall(f"{SIGN}*[^{SIGN}]+|{SIGN}+", escaped) if self.by_word else [escaped]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of all texts, the id count and the score of each text."""
        fast = self.by_word and self.no_break
        odd = pc.match_substring_regex(texts, rf"  |^ | $|[\x00{SIGN}]").to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
        if not fast:
            odd[:] = True
        ids, sizes, scores = [b""] * len(texts), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if not odd.all():
            plain = texts.filter(pa.array(~odd))
            lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \x00"), " ")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            known = [self.unit(SIGN + w if w[:1] != "\x00" else "\n" + w[1:]) for w in coded.dictionary.to_pylist()]
            index = coded.indices.to_numpy(zero_copy_only=False)
            size = np.fromiter((len(k[1]) for k in known), np.int64, len(known)) // 4
            score = np.fromiter((k[0] for k in known), np.float64, len(known))
            flat = ragged(np.frombuffer(b"".join(k[1] for k in known), np.uint32), (np.cumsum(size) - size)[index], size[index])
            owner = np.repeat(np.arange(len(counts)), counts)
            own = np.bincount(owner, weights=size[index], minlength=len(counts)).astype(np.int64)
            raw, ends = flat.tobytes(), np.cumsum(own)
            at = np.flatnonzero(~odd)
            sizes[at], scores[at] = own, np.bincount(owner, weights=score[index], minlength=len(counts))
            for i, a, b in zip(at.tolist(), (ends - own).tolist(), ends.tolist(), strict=True):
                ids[i] = raw[4 * a : 4 * b]
        for i in np.flatnonzero(odd).tolist():
            parts = [self.unit(u) for u in self.units(texts[i].as_py())]
            ids[i], scores[i] = b"".join(p[1] for p in parts), sum(p[0] for p in parts)
            sizes[i] = len(ids[i]) // 4
        return np.frombuffer(b"".join(ids), np.uint32), sizes, scores

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the word sign put before it is taken away."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SIGN, " ")
        return text[1:] if text[:1] == " " else text


_MODELS: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model per Python worker and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, n_tokens, score, ids as bytes of little-endian uint32) of every whole text.

    With ``decoded`` a column of that name holds the text that the ids decode to.
    """
    fields = [(key, pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("ids", pa.binary())]
    schema = pa.schema(fields + [("decoded", pa.string())] * decoded)

    def run(batches):
        one = piece_model(model)
        for batch in text_slices(batches, text, 4 << 20):
            ids, sizes, scores = one.encode(batch.column(text))
            raw, cuts = ids.tobytes(), [0, *np.cumsum(sizes).tolist()]
            back = {"decoded": [one.decode(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]} if decoded else {}
            yield batch_of(schema, **{key: batch.column(key)}, n_tokens=sizes, score=scores, ids=[raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)], **back)

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} long, n_tokens long, score double, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of encoded rows."""
    schema = pa.schema([(key, pa.int64()), ("text", pa.string())])

    def run(batches):
        one = piece_model(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [one.decode(np.frombuffer(i or b"", np.uint32)) for i in part.column("ids").to_pylist()]
                yield batch_of(schema, **{key: part.column(key)}, text=texts)

    return rows.select(F.col(key).cast("long").alias(key), "ids").mapInArrow(run, f"{key} long, text string")
