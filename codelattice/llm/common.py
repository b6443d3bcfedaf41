"""Shared helpers: batches of whole texts, staged tables, folds and bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.session import stage_root

#: Text bytes that one Python step works on at a time.
SLICE_BYTES = 6 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a derived table to the shared folder and read it back (survives lost executors)."""
    path = f"{stage_root(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(column: str, modulus: int):
    """crc32 of a key as text, modulo: the fold a document belongs to."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of the key: the documented bound of a fit."""
    return rows.orderBy(F.xxhash64(key), F.col(key)).limit(limit)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``limit`` text bytes; texts stay whole, null becomes empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, text, column)
        size = pc.binary_length(column).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // limit
        start = 0
        for end in [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]:
            yield batch.slice(start, end - start)
            start = int(end)


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate flat[start : start + length] of every entry."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
    return flat[index]


def words_of(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of characters other than ASCII white space) of all texts, and the word count of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.not_equal(flat, pa.scalar("", flat.type))
    if pc.all(filled).as_py() is False:
        keep = filled.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        flat, counts = flat.filter(filled), np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)
    return flat, counts


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def keep_rows(docs: DataFrame, text: str, keep) -> DataFrame:
    """Rows of a table, all columns unchanged, for which ``keep`` (a slice's texts to a mask) holds."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            only = batch.select([text])
            mask = np.concatenate([keep(part.column(text)) for part in text_slices([only], text)])
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)
