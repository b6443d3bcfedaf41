"""Packing: concatenate all documents' ids and cut them into fixed windows.

Two passes. The first encodes every whole text where it is read, appends the end id and stores the
ids with the running total inside the partition; the second adds the prefix sum of the partition
totals, which turns running totals into global offsets, and cuts at multiples of the window. A
document that crosses a window (or a partition's end) gives one record on either side. Nothing is
shuffled: only one total per partition (one number for each input partition) reaches the driver.

Null text counts as empty (one piece, the end id). Empty tables give no pieces. Repeated rows and
repeated or null keys are packed once per row. Extra columns are ignored. Only the last window
can be short; it is the one that is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, staged, text_slices
from codelattice.llm.tokenizing import encoder, with_end

WINDOW = 1024


def encoded(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, part, part_start, n, ids): ids as bytes of little-endian uint32, end id included.

    ``part_start`` counts the ids before the row inside its partition ``part``.
    """
    schema = pa.schema([(key, pa.int64()), ("part", pa.int64()), ("part_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        part, total, one = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in text_slices(batches, text, 12 << 20):
            ids, sizes = with_end(*one.encode(batch.column(text)), end_id)
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            yield batch_of(
                schema, **{key: batch.column(key)}, part=np.full(len(sizes), part), part_start=total + ends - sizes, n=sizes,
                ids=[raw[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)],
            )
            total += int(ends[-1])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(encode, f"{key} long, part long, part_start long, n long, ids binary")


def partition_offsets(rows: DataFrame) -> dict[int, int]:
    """Ids before each partition; one number per partition that wrote rows."""
    totals = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n")).alias("total")).orderBy("part").collect()
    ends = np.cumsum([0] + [r["total"] for r in totals])
    return {r["part"]: int(e) for r, e in zip(totals, ends, strict=False)}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (key, start, length, doc_tokens, sequence_id, offset, ids) that tile the windows without gaps."""
    rows = staged(encoded(docs, tokenizer, end_id, key, text), "packed_ids")
    before = partition_offsets(rows)
    schema = pa.schema([(key, pa.int64()), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])

    def cut(batches):
        for batch in batches:
            part, inside, n = (batch.column(c).to_numpy() for c in ("part", "part_start", "n"))
            if not len(n):
                continue
            first = np.array([before[p] for p in part.tolist()], np.int64) + inside
            pieces = (first + n - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = (first // window)[row] + nth
            start = np.maximum(sequence * window, first[row])
            end = np.minimum((sequence + 1) * window, (first + n)[row])
            ids = batch.column("ids")
            raws = [ids[i].as_buffer() for i in range(len(n))]
            local = start - first[row]
            yield batch_of(
                schema, **{key: batch.column(key).take(pa.array(row))}, start=local, length=end - start, doc_tokens=n[row],
                sequence_id=sequence, offset=start - sequence * window,
                ids=[memoryview(raws[r])[4 * a : 4 * (a + m)].tobytes() for r, a, m in zip(row.tolist(), local.tolist(), (end - start).tolist(), strict=True)],
            )

    return rows.mapInArrow(cut, f"{key} long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows themselves: (sequence_id, n, ids); a window holds at most its fixed number of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), joined.alias("ids"))


def crc_of(column: str):
    """Unsigned crc32 of a binary column (the checksum that zlib gives)."""
    return F.crc32(F.col(column))


def brute_force(texts: list[tuple[int, str | None]], encode, end_id: int, window: int) -> list[tuple]:
    """The pieces of a small list in the given order (for tests)."""
    out, at = [], 0
    for key, text in texts:
        ids = [*encode(text or ""), end_id]
        start = 0
        while start < len(ids):
            take = min(window - at % window, len(ids) - start)
            raw = np.array(ids[start : start + take], "<u4").tobytes()
            out.append((key, start, take, zlib.crc32(raw), len(ids), at // window, at % window))
            start, at = start + take, at + take
    return out
