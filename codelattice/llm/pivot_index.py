"""Near-duplicate vectors by an index of nearest reference points.

A vector is described by the set of its nearest reference points; their order is not used. Inverted lists hold the vectors of
every set of ``SHARED`` points: two vectors that share at least so many of their ``NEAREST``
points meet in a list, others do not. Candidates of a list are verified by their cosine in double
precision, each pair in one list only (that of their smallest shared points). The reference points
are a bounded sample; every vector is indexed. Equal vectors are reduced to one first. A list
longer than ``TILE`` is cut into blocks and its pairs of blocks are dealt out, so no task holds a
long list; what leaves a list is one row per vector (how many links, and the smallest vector of
its group there), never all pairs.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
link with nothing, as do rows with a null key. Empty tables give empty results. Repeated rows
count as vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, staged
from codelattice.llm.components import connected_components, merge_labels

PIVOTS, NEAREST, SHARED, TILE = 256, 6, 3, 2_048
#: Vectors that the reference points are chosen from.
SAMPLE = 4_096
COSINE = 0.9


def _digests(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, digest, vector): the digest is null for vectors that link with nothing."""
    schema = pa.schema([(key, pa.int64()), ("digest", pa.binary()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            column, digests, vectors = batch.column(vector), [], []
            for i, usable in enumerate(column.is_valid().to_pylist()):
                values = column[i].values if usable else None
                x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if usable and values.null_count == 0 else None
                if x is None or len(x) != width or not np.isfinite(x).all() or not x.any():
                    digests.append(None)
                    vectors.append(None)
                else:
                    digests.append(xxhash.xxh128_digest(x.tobytes()))
                    vectors.append(x)
            yield batch_of(schema, **{key: batch.column(key)}, digest=digests, vector=vectors)

    return rows.mapInArrow(run, f"{key} long, digest binary, vector array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def described(x: np.ndarray, points: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest reference points of each row, nearest first."""
    return np.argsort(-np.round(unit(x) @ points.T, 12), axis=1, kind="stable")[:, :nearest].astype(np.int64)


def far_points(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` rows, each the one least similar to those chosen before it."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def list_keys(tops: np.ndarray, shared: int, pivots: int) -> np.ndarray:
    """One number for every set of ``shared`` points among each row's nearest, [row, set]."""
    ordered = np.sort(tops, axis=1)
    sets = list(itertools.combinations(range(tops.shape[1]), shared))
    out = np.zeros((len(tops), len(sets)), np.int64)
    for column in range(shared):
        out = out * pivots + ordered[:, [s[column] for s in sets]]
    return out


def smallest_shared(a: np.ndarray, b: np.ndarray, shared: int, pivots: int) -> np.ndarray:
    """Key of the smallest ``shared`` points that two rows have in common."""
    common = np.where((a[:, :, None] == b[:, None, :]).any(2), a, pivots)
    common.sort(axis=1)
    out = np.zeros(len(a), np.int64)
    for column in range(shared):
        out = out * pivots + common[:, column]
    return out


def _verify(rep: np.ndarray, copies: np.ndarray, x: np.ndarray, tops: np.ndarray, left: np.ndarray | None, key: int, cosine: float, shared: int, pivots: int):
    """(rep, root, links) of one list, or of one pair of its blocks."""
    u = unit(x)
    near = u @ u.T >= cosine
    near = np.triu(near, 1) if left is None else near & left[:, None] & ~left[None, :]
    i, j = np.nonzero(near)
    own = smallest_shared(tops[i], tops[j], shared, pivots) == key
    i, j = i[own], j[own]
    if not len(i):
        return None
    links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    labels = merge_labels(np.arange(len(rep)), i, j)
    lowest = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(lowest, labels, rep)
    some = links > 0
    return rep[some], lowest[labels][some], links[some].astype(np.int64)


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    spark = rows.sparkSession
    rows = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    width = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").first()
    every = staged(_digests(rows, key, vector, width["w"] if width else 0), "vectors")
    usable = every.where(F.col(key).isNotNull() & F.col("digest").isNotNull())
    single = staged(usable.groupBy("digest").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "distinct_vectors")
    sample = single.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vector").collect()
    points = far_points(unit(np.array([r["vector"] for r in sample], np.float64)), pivots) if sample else np.zeros((0, 1))
    pivots, nearest = max(len(points), 1), min(nearest, len(points))
    shared = min(shared, nearest)
    listed = pa.schema([("list", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64())), ("tops", pa.list_(pa.int64()))])

    def describe(batches):
        for batch in batches:
            if not batch.num_rows or not shared:
                continue
            tops = described(matrix(batch.column("vector")), points, nearest)
            keys = list_keys(tops, shared, pivots)
            row = np.repeat(np.arange(batch.num_rows), keys.shape[1])
            take = pa.array(row)
            yield batch_of(listed, list=keys.reshape(-1), rep=batch.column("rep").take(take), copies=batch.column("copies").take(take), vector=batch.column("vector").take(take), tops=list(tops[row]))

    lists = single.select("rep", "copies", "vector").mapInArrow(describe, "list long, rep long, copies long, vector array<double>, tops array<long>")
    long_lists = staged(lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("list", F.ceil(F.col("n") / tile).cast("int").alias("blocks")), "list_blocks")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = lists.join(long_lists, "list").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("list", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "copies", "vector", "tops")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")

    def verify(batches):
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table):
            n = table.num_rows
            cols = {c: table.column(c).combine_chunks() for c in ("list", "lo", "hi", "own", "rep", "copies")}
            keys, lo, hi, own, rep, copies = (cols[c].to_numpy() for c in ("list", "lo", "hi", "own", "rep", "copies"))
            x, tops = matrix(table.column("vector").combine_chunks()), matrix(table.column("tops").combine_chunks())
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            ends = np.append(cuts[1:], n)
            out = []
            for a, b in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist(), strict=True):
                left = None if lo[a] == hi[a] else own[a:b] == lo[a]
                found = _verify(rep[a:b], copies[a:b], x[a:b], tops[a:b], left, keys[a], cosine, shared, pivots)
                if found is not None:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "root", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            marks = [table.column(c) for c in ("list", "lo", "hi")]
            last = tuple(m[table.num_rows - 1].as_py() for m in marks)
            same = np.logical_and.reduce([m.to_numpy() == v for m, v in zip(marks, last, strict=True)])
            whole = int(np.argmax(same))  # rows before the last list, which may go on in the next batch
            if whole:
                yield from solve(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    found = staged(dealt.mapInArrow(verify, "rep long, root long, links long"), "vector_links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b"))
    named = single.select("digest", "rep", "copies").join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    unlinked = F.col("digest").isNull() | F.col(key).isNull()
    alone = every.where(unlinked).select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    out = every.where(~unlinked).select(key, "digest").join(named, "digest").select(key, "n_links", "component_id").unionByName(alone)
    return out.select(key, "n_links", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)).alias("kept"))
