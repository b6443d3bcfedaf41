"""SentencePiece, token-id files, packing."""

import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codelattice.llm import huffman_ids, packing, sentencepiece_codec
from codelattice.llm.tokenizing import PieceEncoder
from helpers import odd_rows, odd_texts, prose, table

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_equal_whole_texts(path):
    texts = [t or "" for t in odd_texts()] + prose(20) + ["'tis we'll 'S It'S", "x…y .….", "a\xa0b  c", "Ábc É. .́x", "<|endoftext|> a", "İstanbul ǅa Σας", "a\x85b\x1cc", "é'sé .'ll!'ve"]
    random.seed(2)
    texts += ["".join(random.choice("abZ é.'!12 \n\t# ") for _ in range(random.randint(0, 40))) for _ in range(300)]
    ids, sizes = PieceEncoder(path, cache=50).encode(pa.array(texts, pa.large_string()))
    ends, encode = np.cumsum(sizes), library(path)
    for text, end, n in zip(texts, ends, sizes, strict=True):
        assert ids[end - n : end].tolist() == encode(text), text


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_common_pieces_are_solved_once(path, monkeypatch):
    one, solved = PieceEncoder(path, cache=60), []
    plain = one._plain
    monkeypatch.setattr(one, "_plain", lambda piece, lead: solved.append(piece) or plain(piece, lead))
    letters = "abcdefghij"
    common = ["common" + c for c in letters]
    for k in range(30):  # new words, with and without marks, pass the cache many times over
        rare = [f"rare{letters[k // 10]}{letters[k % 10]}{c}" for c in letters]
        text = " ".join(["x", *common, *(w + "," for w in common), *rare, *(w + "." for w in rare)])
        ids, sizes = one.encode(pa.array([text], pa.large_string()))
        assert ids.tolist() == library(path)(text) and sizes.tolist() == [len(ids)]
    assert all(solved.count(w) == 1 for w in common)
    assert len(solved) <= 10 + 300 + 4
    assert len(one.young) + len(one.old) <= 60


def test_packing_tiles_windows(spark):
    docs = table(spark, odd_rows())
    got = packing.pack(docs, BYTE, end_id=0, window=16).select("doc_id", "start", "length", packing.crc_of("ids").alias("crc"), "doc_tokens", "sequence_id", "offset").collect()
    at = sorted((r["sequence_id"] * 16 + r["offset"], r["length"]) for r in got)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:], strict=False))
    encode = library(BYTE)
    want = [packing.brute_force([(k, t)], encode, 0, 1 << 40)[0] for k, t in odd_rows()]
    assert sum(w[2] for w in want) == sum(r["length"] for r in got)
    whole = packing.pack(docs, BYTE, end_id=0, window=1 << 40).select("doc_id", "length", packing.crc_of("ids").alias("crc")).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in whole) == sorted((str(w[0]), w[2], w[3]) for w in want)


def test_packing_equals_brute_force_in_one_partition(spark):
    rows = [(k, t) for k, t in odd_rows() if k is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in packing.pack(docs, BYTE, window=32).select("doc_id", "start", "length", packing.crc_of("ids"), "doc_tokens", "sequence_id", "offset").collect()]
    assert got == packing.brute_force(rows, library(BYTE), 0, 32)
    joined = packing.sequences(packing.pack(docs, BYTE, window=32)).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 4 * r["n"] for r in joined) and all(r["n"] == 32 for r in joined[:-1])


def test_packing_empty_table(spark):
    assert packing.pack(table(spark, []), BYTE).count() == 0


def test_code_lengths_are_prefix_free_and_limited():
    random.seed(3)
    for n in (1, 2, 3, 50, 3000):
        counts = np.array([random.choice([0, 1, 2, 5, 10**random.randint(0, 9)]) for _ in range(n)])
        lengths = huffman_ids.code_lengths(counts, 16)
        used = lengths[lengths > 0].astype(float)
        assert ((lengths > 0) == (counts > 0)).all() and (2.0**-used).sum() <= 1 and lengths.max(initial=0) <= 16


def test_code_lengths_are_optimal_without_pressure():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((huffman_ids.code_lengths(counts) * counts).sum()) == total


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
def test_bit_streams_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 700).astype(np.uint32)
    lengths = huffman_ids.code_lengths(np.bincount(ids, minlength=700))
    raw, marks = huffman_ids.write_bits(ids, lengths, huffman_ids.canonical_codes(lengths))
    assert (huffman_ids.read_bits(raw, n, marks, huffman_ids.decode_table(lengths)) == ids).all()


def test_id_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(huffman_ids, "SEGMENT_IDS", 700)
    path = huffman_ids.write_ids(table(spark, odd_rows()), WORD, 2, tempfile.mkdtemp(prefix="ids-") + "/set")
    got = huffman_ids.read_ids(spark, path).orderBy("start").collect()
    encode = library(WORD)
    want = sorted((-1 if k is None else k, zlib.crc32(np.array([*encode(t), 2], "<u4").tobytes())) for k, t in odd_rows())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(bytes(r["ids"]))) for r in got) == want
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0


def test_id_files_of_an_empty_table(spark):
    path = huffman_ids.write_ids(table(spark, []), WORD, 2, tempfile.mkdtemp(prefix="ids-") + "/set")
    assert huffman_ids.read_ids(spark, path).count() == 0


def brute_viterbi(model, text):
    pieces = {p: (s, i) for i, (p, s) in enumerate(zip(model.pieces, model.scores, strict=True)) if i > 2 and i not in model.byte_ids.values()}
    n = len(text)
    best, back = [(0.0, 0)] + [(-np.inf, 0)] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(end):
            if text[start:end] in pieces:
                score, i = pieces[text[start:end]]
                if best[start][0] + score > best[end][0] or (best[start][0] + score == best[end][0] and end - start > best[end][1]):
                    best[end], back[end] = (best[start][0] + score, end - start), (start, [i])
        raw = text[end - 1].encode()
        if best[end - 1][0] + model.fallback * len(raw) > best[end][0]:
            best[end], back[end] = (best[end - 1][0] + model.fallback * len(raw), 1), (end - 1, [model.byte_ids[b] for b in raw])
    ids, at = [], n
    while at:
        start, own = back[at]
        ids, at = own + ids, start
    return best[n][0], ids


def test_sentencepiece_is_the_best_path():
    model = sentencepiece_codec.PieceModel(PIECE, cache=40)
    random.seed(4)
    texts = [t or "" for t in odd_texts() if len(t or "") < 200] + prose(3, size=20)
    texts += ["".join(random.choice("abc de\nthé日 ") for _ in range(random.randint(0, 50))) for _ in range(60)]
    ids, sizes, scores = model.encode(pa.array(texts, pa.large_string()))
    ends = np.cumsum(sizes)
    for i, text in enumerate(texts):
        own = ids[ends[i] - sizes[i] : ends[i]]
        escaped = sentencepiece_codec.SIGN + text.replace(" ", sentencepiece_codec.SIGN) if text else ""
        score, want = brute_viterbi(model, escaped)
        assert own.tolist() == want and abs(score - scores[i]) <= 1e-9 * max(1, abs(score))
        assert model.decode(own) == text


def test_sentencepiece_round_trip(spark):
    coded = sentencepiece_codec.encode(table(spark, odd_rows()), PIECE)
    got = sentencepiece_codec.decode(coded, PIECE).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(k), t or "") for k, t in odd_rows())
    assert sentencepiece_codec.encode(table(spark, []), PIECE).count() == 0
