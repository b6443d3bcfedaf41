"""Token-id files: canonical length-limited Huffman coding of ids, in blocks with bit-offset checkpoints.

Whole texts are encoded, dealt into key ranges and sorted. One pass counts all ids (a histogram as
large as the vocabulary), code lengths come from package-merge under a bit limit, codes are
canonical, so the code book of a data set is one length per id. A data set is a folder with
``codebook`` (one row) and ``segments``: Parquet rows that each hold whole documents of one key
range, their ids as one bit stream, and the bit offset of every block. Blocks need nothing but
their offset, so a segment is decoded block-parallel with one table look-up per id.

Null text counts as empty (the end id alone). Empty tables give an empty data set. Repeated rows
and keys are kept, ordered by their ids; null keys come first. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, staged, text_slices
from codelattice.llm.tokenizing import encoder, with_end
from codelattice.session import stage_root

BLOCK = 512
SEGMENT_IDS = 1 << 20
MAX_BITS = 16


# ---------------------------------------------------------------- code book

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths under a limit (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    own: list[np.ndarray] = []
    level = weights
    is_own = np.ones(len(weights), bool)
    own.append(is_own)
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        level, is_own = both[rank], rank < len(weights)
        own.append(is_own)
    lengths, take = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for is_own in reversed(own):
        singles = int(is_own[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes that follow from the lengths alone: by length, then by id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    sizes = lengths[order].astype(int)
    for size in np.unique(sizes):
        members = order[sizes == size]
        code <<= int(size) - last
        codes[members] = code + np.arange(len(members), dtype=np.uint64)
        code, last = code + len(members), int(size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every bit pattern of the longest length: the id it starts with, and that code's length."""
    width = max(1, int(lengths.max(initial=0)))
    ids, sizes = np.zeros(1 << width, np.uint32), np.zeros(1 << width, np.uint8)
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.left_shift(1, width - lengths[order].astype(np.int64))
    filled = int(span.sum())
    assert (codes[order] << (width - lengths[order].astype(np.uint64)) == (np.cumsum(span) - span).astype(np.uint64)).all()
    ids[:filled], sizes[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, sizes, width


# ---------------------------------------------------------------- bit streams

def write_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids and the bit offset of each block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    lane = starts >> 5
    value = codes[ids] << (64 - (starts & 31) - size).astype(np.uint64)
    words = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 2, np.uint32)
    if len(ids):
        first = np.concatenate([[0], np.flatnonzero(np.diff(lane)) + 1])
        total = np.add.reduceat(value, first)
        at = lane[first]
        words[at] += (total >> np.uint64(32)).astype(np.uint32)
        words[at + 1] += total.astype(np.uint32)
    return words.astype(">u4").tobytes(), starts[::BLOCK]


def read_bits(raw: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All ids of a segment; every block advances one id per step from its own offset."""
    ids, sizes, width = table
    if not n:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(raw, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    at = np.asarray(checkpoints, np.int64).copy()
    out = np.zeros((min(BLOCK, n), len(at)), np.uint32)
    tail = n - (len(at) - 1) * BLOCK  # ids of the last block
    down = np.uint64(64 - width)
    for step in range(len(out)):
        if step == tail:
            at = at[:-1]
        if not len(at):
            break
        seen = ((pairs[at >> 5] << (at & 31).astype(np.uint64)) >> down).astype(np.int64)
        out[step, : len(at)] = ids[seen]
        at += sizes[seen]
    return out.T.reshape(-1)[:n] if len(out) == BLOCK else out.T.reshape(-1)


# ---------------------------------------------------------------- data sets

def _bounds(docs: DataFrame, key: str, parts: int) -> np.ndarray:
    """Key quantiles that deal the documents into ranges; one number per range."""
    marks = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx(key, marks, F.lit(10_000)).alias("q")).first()["q"] if marks else None
    return np.unique(np.array(found or [], np.int64))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> str:
    """Encode whole texts and write them as a coded data set in ascending key order."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, key, parts)
    raw_schema = pa.schema([(key, pa.int64()), ("range", pa.int32()), ("n", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        one = encoder(tokenizer)
        small = one.tokenizer.get_vocab_size() <= 1 << 16
        for batch in text_slices(batches, text, 12 << 20):
            ids, sizes = with_end(*one.encode(batch.column(text)), end_id)
            raw, width = ids.astype("<u2" if small else "<u4").tobytes(), 2 if small else 4
            ends = np.cumsum(sizes)
            keys = batch.column(key)
            at = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(), side="left") if len(bounds) else np.zeros(len(sizes))
            yield batch_of(raw_schema, **{key: keys}, range=at.astype(np.int32), n=sizes, ids=[raw[width * (b - m) : width * b] for b, m in zip(ends.tolist(), sizes.tolist(), strict=True)])

    run_schema = pa.schema([*raw_schema, ("range_start", pa.int64())])

    def running(batches):
        total, last = 0, None
        for batch in batches:
            which, n = batch.column("range").to_numpy(), batch.column("n").to_numpy()
            start = np.zeros(len(n), np.int64)
            for r in np.unique(which):
                total, last = (total if r == last else 0), r
                own = which == r
                ends = total + np.cumsum(n[own])
                start[own], total = ends - n[own], int(ends[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in raw_schema), pa.array(start)], schema=run_schema)

    raw = docs.mapInArrow(encode, f"{key} long, range int, n long, ids binary")
    dealt = raw.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", key, "ids")
    rows = staged(dealt.mapInArrow(running, f"{key} long, range int, n long, ids binary, range_start long"), "sorted_ids")

    def widen(raw_ids: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw_ids, "<u2" if len(raw_ids) == 2 * n else "<u4").astype(np.uint32)

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw_ids, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                own = np.bincount(widen(raw_ids, n))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "c"])

    counted = rows.select("ids", "n").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["c"].to_numpy(np.int64)
    lengths = code_lengths(counts, max_bits)
    codes = canonical_codes(lengths)

    def pack(batches):
        for batch in batches:
            which, n, start = (batch.column(c).to_numpy() for c in ("range", "n", "range_start"))
            group = np.cumsum(n) // SEGMENT_IDS
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(which) != 0)) + 1).tolist(), len(n)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                ids = np.concatenate([widen(r, m) for r, m in zip(batch.column("ids")[a:b].to_pylist(), n[a:b].tolist(), strict=True)])
                bits, marks = write_bits(ids, lengths, codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(which[a])], pa.int32()), pa.array([int(start[a])]), pa.array([len(ids)]), pa.array([batch.column(key)[a:b].to_pylist()], pa.list_(pa.int64())), pa.array([n[a:b]], pa.list_(pa.int64())), pa.array([marks], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                    names=["range", "range_start", "n", "keys", "sizes", "checkpoints", "bits"],
                )

    rows.mapInArrow(pack, "range int, range_start long, n long, keys array<long>, sizes array<long>, checkpoints array<long>, bits binary").write.parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/codebook")
    return path


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Documents of a coded data set: (key, start, n_tokens, ids as bytes of little-endian uint32)."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    segments = spark.read.parquet(f"{path}/segments")
    totals = segments.groupBy("range").agg(F.max(F.col("range_start") + F.col("n")).alias("n")).orderBy("range").collect()
    before = dict(zip([r["range"] for r in totals], np.cumsum([0] + [r["n"] for r in totals]).tolist(), strict=False))
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches):
        table = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = read_bits(row["bits"], row["n"], row["checkpoints"], table)
                raw, sizes = ids.astype("<u4").tobytes(), np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                yield batch_of(schema, **{key: row["keys"]}, start=before[row["range"]] + row["range_start"] + ends - sizes, n_tokens=sizes, ids=[raw[4 * (b - m) : 4 * b] for b, m in zip(ends.tolist(), row["sizes"], strict=True)])

    return segments.mapInArrow(decode, f"{key} long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    """A fresh folder for one data set in the shared folder."""
    return f"{stage_root(spark)}/{uuid.uuid4().hex}/token_ids"


def checksum(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
