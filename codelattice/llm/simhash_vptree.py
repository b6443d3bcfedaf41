"""SimHash near-duplicates with vantage-point trees.

Fingerprints are made of whole texts where they are read; equal ones are reduced to one row first.
Two fingerprints within four bits agree, up to one bit, on at least one of four 16-bit blocks, so
there is one tree for each block: a node has a vantage point and a radius in the block's Hamming
distance, and a branch is pruned where the triangle bound leaves no partner within one bit. Where
a block no longer separates (many fingerprints share its bits) nodes go on with the distance of
all 64 bits and a bound of four. The top of each tree comes from a bounded sample and cuts the
fingerprints into shards; a fingerprint lies in one shard and also visits the later shards that
its bound reaches, so every pair within four bits meets. Shards go on splitting in memory, compare
what is left exactly, and return one link per fingerprint to its group, never all pairs.

Null text counts as empty; texts without words have fingerprint zero and link like any other.
Rows with a null key get the component of their fingerprint. Empty tables give empty results.
Repeated rows and keys give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, staged, text_slices
from codelattice.llm.components import connected_components, merge_labels

SHINGLE, SEED, BITS, BLOCKS = 4, 42, 4, 4
ALL = (1 << 64) - 1
#: Fingerprints that shape the top of the trees; fingerprints a shard shall hold; pairs compared at once.
SAMPLE, SHARD, PAIRS = 8_192, 60_000, 1 << 21


# ---------------------------------------------------------------- fingerprints

def fingerprint_batch(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """SimHash of every text: bit is 1 if set in over half of the hashes of its word shingles."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    filled = pc.not_equal(flat, pa.scalar("", flat.type)).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    if not filled.all():
        flat, owner = flat.filter(pa.array(filled)), owner[filled]
        counts = np.bincount(owner, minlength=len(counts)).astype(np.int64)
    out = np.zeros(len(counts), np.uint64)
    if not len(flat):
        return out
    # All words of the slice, one space after each; a shingle is a stretch of these bytes.
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(pa.string())), " ")[0].as_buffer())
    end = np.cumsum(size + 1) - 1
    start = end - size
    shingles = np.maximum(counts - width + 1, 1) * (counts > 0)
    first = np.repeat((np.cumsum(counts) - counts), shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.repeat(np.minimum(counts, width), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    some = np.flatnonzero(shingles)
    edges = np.cumsum(shingles)[some]
    step = 200_000  # shingles whose bits are spread out at once; texts may go across
    votes = np.zeros((len(some), 64), np.int64)
    for a in range(0, len(hashes), step):
        part = hashes[a : a + step]
        lo, hi = np.searchsorted(edges, a, side="right"), np.searchsorted(edges, a + len(part) - 1, side="right")
        cuts = np.concatenate([[0], edges[lo:hi] - a]).astype(np.int64)
        spread = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes[lo : hi + 1] += np.add.reduceat(spread, cuts, axis=0, dtype=np.int32)
    set_bits = (2 * votes > shingles[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(set_bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with the fingerprint's 64 bits as a long."""
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in text_slices(batches, text, 4 << 20):
            yield batch_of(schema, **{key: batch.column(key)}, fp=fingerprint_batch(batch.column(text)).view(np.int64))

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} long, fp long")


def _text_prints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, fp) of rows with a key; the digest tells texts apart, null from empty as well."""
    schema = pa.schema([(key, pa.int64()), ("digest", pa.string()), ("fp", pa.int64())])
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text), digest_of(text).alias("digest"))

    def run(batches):
        for batch in text_slices(batches, text, 4 << 20):
            yield batch_of(schema, **{key: batch.column(key)}, digest=batch.column("digest"), fp=fingerprint_batch(batch.column(text)).view(np.int64))

    return rows.mapInArrow(run, f"{key} long, digest string, fp long")


def digest_of(text: str):
    return F.coalesce(F.md5(F.col(text).cast("string").cast("binary")), F.lit(""))


# ---------------------------------------------------------------- vantage-point trees

def distance(x: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(point)) & np.uint64(mask)).astype(np.int16)


def block_mask(block: int) -> int:
    return ((1 << 64 // BLOCKS) - 1) << (block * 64 // BLOCKS)


def choose(x: np.ndarray, mask: int, reach: int, draw: np.random.Generator) -> tuple[int, int, int, int] | None:
    """(mask, reach, vantage point, radius) that parts x best; None if no distance parts it."""
    for own_mask, own_reach in ((mask, reach), (ALL, BITS)):
        best = None
        for point in x[draw.integers(0, len(x), 6)].tolist():
            d = distance(x, point, own_mask)
            radius = int(np.median(d)) or 1
            for cut in (radius, radius + 1):
                inside = int((d < cut).sum())
                crossing = int(((d < cut + own_reach) & (d >= cut - own_reach)).sum())
                worst = max(inside, len(x) - inside) + crossing
                if 0 < inside < len(x) and (best is None or worst < best[0]):
                    best = (worst, point, cut)
        if best is not None and best[0] < 1.7 * len(x):
            return own_mask, own_reach, best[1], best[2]
        if own_mask == ALL:
            break
    return None


def grow(sample: np.ndarray, block: int, leaves: int) -> list:
    """The top of one tree: nested lists [mask, reach, point, radius, inside, outside]; a leaf is its number."""
    draw = np.random.default_rng(block)
    count = 0

    def build(x: np.ndarray, mask: int, reach: int, parts: float):
        nonlocal count
        found = choose(x, mask, reach, draw) if parts > 1 and len(x) >= 16 else None
        if found is None:
            count += 1
            return count - 1
        mask, reach, point, radius = found
        d = distance(x, point, mask)
        share = float((d < radius).mean())
        return [mask, reach, point, radius, build(x[d < radius], mask, reach, parts * share), build(x[d >= radius], mask, reach, parts * (1 - share))]

    return [build(sample, block_mask(block), BITS // BLOCKS, leaves)] if len(sample) else [0]


def route(tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, whether at home) of every fingerprint: its own leaf and the later ones its bound reaches."""
    home = np.zeros(len(x), np.int64)
    rows, leaves = [], []

    def walk(node, at: np.ndarray, own: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            home[at[own]] = node
            rows.append(at)
            leaves.append(np.full(len(at), node))
            return
        mask, reach, point, radius, inside, outside = node
        d = distance(x[at], point, mask)
        for child, near, in_it in ((inside, d < radius + reach, d < radius), (outside, d + reach >= radius, d >= radius)):
            walk(child, at[near], own[near] & in_it[near])

    walk(tree, np.arange(len(x)), np.ones(len(x), bool))
    row, leaf = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
    keep = leaf >= home[row]
    row, leaf = row[keep], leaf[keep]
    return row, leaf, leaf == home[row]


def link_shard(x: np.ndarray, home: np.ndarray, block: int) -> np.ndarray:
    """Label of every fingerprint of a shard: home rows link among themselves and with visitors."""
    labels = np.arange(len(x))
    draw = np.random.default_rng(len(x))

    def compare(h: np.ndarray, v: np.ndarray) -> None:
        both = np.concatenate([h, v])
        for a in range(0, len(h), 1024):
            own = h[a : a + 1024]
            for b in range(a, len(both), 2048):
                other = both[b : b + 2048]
                near = np.bitwise_count(x[own][:, None] ^ x[other][None, :]) <= BITS
                near &= labels[own][:, None] != labels[other][None, :]
                i, j = np.nonzero(near)
                if len(i):
                    merge_labels(labels, own[i], other[j])

    stack = [(np.flatnonzero(home), np.flatnonzero(~home), block_mask(block), BITS // BLOCKS)]
    while stack:
        h, v, mask, reach = stack.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        found = choose(x[h], mask, reach, draw) if len(h) * (len(h) // 2 + len(v)) > PAIRS else None
        if found is None:
            compare(h, v)
            continue
        mask, reach, point, radius = found
        dh, dv = distance(x[h], point, mask), distance(x[v], point, mask)
        crossing = h[(dh >= radius) & (dh < radius + reach)]
        stack.append((h[dh < radius], np.concatenate([v[dv < radius + reach], crossing]), mask, reach))
        stack.append((h[dh >= radius], v[dv + reach >= radius], mask, reach))
    return labels


# ---------------------------------------------------------------- the operator

def _links(named: DataFrame, sample: int, shard: int) -> DataFrame:
    """Links (a, b) between the ``rep`` values of distinct fingerprints (fp, rep) within the bit bound."""
    total = named.count()
    spark = named.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) / BLOCKS, total / shard)
    some = np.array([r["fp"] for r in named.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    # A shard needs rows enough to be worth a task.
    leaves = max(1.0, min(parts, total / 2_000))
    trees = [grow(some, block, leaves)[0] for block in range(BLOCKS)]
    routed = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("fp", pa.int64()), ("rep", pa.int64()), ("home", pa.bool_())])

    def deal(batches):
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
            for block, tree in enumerate(trees):
                row, leaf, home = route(tree, fp.view(np.uint64))
                yield batch_of(routed, tree=np.full(len(row), block, np.int32), leaf=leaf.astype(np.int32), fp=fp[row], rep=rep[row], home=home)

    def link(pdf):
        import pandas as pd

        rep = pdf["rep"].to_numpy(np.int64)
        labels = link_shard(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool), int(pdf["tree"].iloc[0]))
        apart = labels != np.arange(len(labels))
        return pd.DataFrame({"a": rep[apart], "b": rep[labels[apart]]})

    dealt = named.mapInArrow(deal, "tree int, leaf int, fp long, rep long, home boolean")
    return dealt.groupBy("tree", "leaf").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(key, fp, component_id) of every document; component_id is the smallest key reachable by links."""
    prints = staged(fingerprints(docs, key, text), "fingerprints")
    single = staged(prints.groupBy("fp").agg(F.min(key).alias("rep")), "distinct_fingerprints")
    groups = connected_components(_links(single.where(F.col("rep").isNotNull()), sample, shard))
    named = single.join(groups, single["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicate texts, all columns unchanged.

    Groups are those of the texts, so rows that share a key and differ in text stay or go on their own. A
    group keeps the row with the smallest key (and digest); rows equal in both are one document. Rows with
    a null key are kept.
    """
    prints = staged(_text_prints(docs, key, text), "text_fingerprints")
    single = staged(prints.groupBy("fp").agg(F.min(F.struct(key, "digest")).alias("first")), "distinct_fingerprints")
    groups = connected_components(_links(single.select("fp", F.col("fp").alias("rep")), sample, shard))
    chosen = single.join(groups, single["fp"] == groups["node"], "left").groupBy(F.coalesce("component", "fp").alias("member")).agg(F.min("first").alias("first"))
    wanted = chosen.select(F.col(f"first.{key}").alias("key"), F.col("first.digest").alias("digest"))
    rows = docs.where(F.col(key).isNotNull()).select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"), digest_of(text).alias("digest"))
    kept = rows.join(wanted, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.where(F.col(key).isNull()))


def hex_of(column: str):
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
