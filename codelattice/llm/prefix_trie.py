"""Conversation prefix trie: shared openings of rebuilt conversations, with totals over every subtree.

1. Turns are range-partitioned by (conversation, order) and numbered where they lie; only the fragment of the
   conversation that goes on from an earlier partition needs a shift, one number per partition, so a
   conversation with a third of all turns is spread over tasks.
2. A node is known by the sum of position-dependent hashes of its turns (four 32-bit sums), which is a
   prefix sum: blocks of ``BLOCK`` turns are summed apart and shifted by the sums of the earlier blocks.
3. Nodes are an aggregate over (node, member) rows. Nodes with the same members form a segment (an unbranched
   stretch of the trie, known by smallest member and number of members). There are at most two segments per
   conversation however long it is, and all else is worked out on segments.
4. Subtree totals by time-forward processing: segments are sorted externally (Spark's spilling sort) by
   reverse level order, and a segment's total is sent to its parent through a priority queue keyed by the
   parent's place in that order, so it arrives when the parent is reached. The queue writes sorted runs to
   task-owned scratch files when it grows. A shard is a subtree with at most ``limit`` members whose parent has
   more; shards are dealt over tasks by hash. What leaves a shard is summed per receiver and then goes the same
   way through the segments above all shards. Each of these has over ``limit`` member rows, and ``limit``
   grows with the turns, so there are at most ``TOP_NODES`` of them at any size (or fewer members than
   ``LEAST_MEMBERS``). Segments with a single member are leaves worth nothing and never enter a queue.
5. Nodes read their totals from their segment: leaves are equal along it, saved tokens shrink by a prefix sum.
   Member lists are hashed as a stream: ids are joined to chunks where they lie, and chunks pass in order
   through SHA-256, which itself can't be split; nothing is held whole.

Defined results. Turns are ordered by turn (null first), then role, then text; null role or text becomes empty.
Rows without a conversation id belong to no conversation and make no node. Repeated rows are turns of their own.
An empty table gives no rows (there is no member to name the root). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, staged

BLOCK = 4096
TOP_NODES = 1 << 17
LEAST_MEMBERS = 1024
GROUP = 20
HEADS = 3
CHUNK = 1024
LIMB = 2**32
WORD = r"[^\x20\x09-\x0D]+"
ROOT = (0, 0)


# ---------------------------------------------------------------- rebuilt conversations

def _numbered(talks: DataFrame) -> DataFrame:
    """(conv, position, digest, words) of all turns; positions from 0 within the conversation."""
    rows = talks.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Boundaries are sampled, so their keys are short; they order rows as the sort below does.
    begins = F.when(F.length("role") < 40, F.substring("text", 1, 120)).otherwise("")
    dealt = rows.repartitionByRange(parts, "conv", F.asc_nulls_first("turn"), F.substring("role", 1, 40), begins)
    order = dealt.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    slim = order.select("conv", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))

    def number(batches):
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            new = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
            starts = np.zeros(len(conv), np.int64)
            starts[new] = new
            place = np.arange(len(conv)) - np.maximum.accumulate(starts) + np.where(np.arange(len(conv)) < (new[0] if len(new) else len(conv)), at, 0)
            last, at = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), part)), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    found = staged(slim.mapInArrow(number, "conv long, digest binary, words long, part long, place long"), "numbered_turns")
    ends = found.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max(F.struct("conv", "place")).alias("end")).orderBy("part").collect()
    shift, open_conv, seen = {}, None, 0
    for r in ends:
        begun = seen if r["first"] == open_conv else 0
        if begun:
            shift[r["part"]] = (r["first"], begun)
        open_conv, seen = r["last"], r["end"]["place"] + 1 + (begun if r["first"] == r["last"] else 0)
    if not shift:
        return found.select("conv", F.col("place").alias("position"), "digest", "words")
    moved = talks.sparkSession.createDataFrame([(p, c, n) for p, (c, n) in shift.items()], "part long, conv long, moved long")
    return found.join(moved, ["part", "conv"], "left").select("conv", (F.col("place") + F.coalesce("moved", F.lit(0))).alias("position"), "digest", "words")


def _limbs(depth: Column, digest: Column) -> list[Column]:
    """Four 32-bit hashes of a turn at its place, as longs."""
    one, two = F.xxhash64(depth, digest), F.xxhash64(digest, F.lit("second"), depth)
    low = lambda x: x.bitwiseAND(F.lit(LIMB - 1))
    return [low(one), low(F.shiftrightunsigned(one, 32)), low(two), low(F.shiftrightunsigned(two, 32))]


def _node(limbs: list[Column]) -> list[Column]:
    """Two longs that name the node with these sums."""
    kept = [F.pmod(x, F.lit(LIMB)) for x in limbs]
    return [F.shiftleft(kept[1], 32).bitwiseOR(kept[0]), F.shiftleft(kept[3], 32).bitwiseOR(kept[2])]


def _members(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, depth, n0, n1, p0, p1, words, before) and all conversations (conv, turns of the head)."""
    turns = staged(_numbered(talks), "turns")
    blocks = turns.groupBy("conv", F.expr(f"position div {BLOCK}").alias("block")).agg(F.count(F.lit(1)).alias("n")).select("conv", "block")
    base = F.col("conv") - F.col("conv") % GROUP
    heads = turns.where((F.col("position") < HEADS) & (F.col("conv") % GROUP == 0)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("position", "digest", "words"))).alias("head"))
    own = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4)).cast("int")
    convs = blocks.where("block = 0").select("conv", base.alias("base"), own.alias("h")).join(heads, "base", "left")
    convs = staged(convs.select("conv", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<position:bigint,digest:binary,words:bigint>>")), F.lit(1), F.col("h")).alias("head")), "conversations")

    def head_sum(i: int, upto: Column) -> Column:
        part = F.transform(F.slice("head", F.lit(1), upto), lambda x: _limbs(x["position"] + 1, x["digest"])[i])
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def head_words(upto: Column) -> Column:
        return F.aggregate(F.transform(F.slice("head", F.lit(1), upto), lambda x: x["words"]), F.lit(0).cast("long"), lambda a, x: a + x)

    def row(depth: Column, sums: list[Column], own_limbs: list[Column], words: Column, upto: Column) -> list[Column]:
        n, p = _node(sums), _node([s + LIMB - o for s, o in zip(sums, own_limbs, strict=True)])
        return [F.col("conv"), depth.cast("long").alias("depth"), n[0].alias("n0"), n[1].alias("n1"), p[0].alias("p0"), p[1].alias("p1"), words.alias("words"), (upto - words).alias("before")]

    # the head's turns
    nth = convs.where(F.size("head") > 0).select("conv", "head", F.explode(F.sequence(F.lit(1), F.size("head"))).alias("d"))
    nth = nth.select("conv", "head", "d", F.element_at("head", F.col("d")).alias("x"))
    opened = nth.select(*row(F.col("d"), [head_sum(i, F.col("d")) for i in range(4)], _limbs(F.col("d").cast("long"), F.col("x.digest")), F.col("x.words"), head_words(F.col("d"))))
    # the conversation's own turns, block by block
    known = blocks.join(convs.select("conv", "h", F.size("head").alias("opened"), *(head_sum(i, F.size("head")).alias(f"s{i}") for i in range(4)), head_words(F.size("head")).alias("sw")), "conv")
    later = turns.withColumn("block", F.expr(f"position div {BLOCK}")).join(known, ["conv", "block"]).where("position >= h")
    later = later.withColumn("depth", F.col("position") - F.col("h") + F.col("opened") + 1)
    later = later.select("conv", "block", "depth", "words", *(x.alias(f"l{i}") for i, x in enumerate(_limbs(F.col("depth"), F.col("digest")))), *(F.col(f"s{i}") for i in range(4)), "sw")
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = staged(later.select("conv", "block", "depth", "words", *(f"l{i}" for i in range(4)), *((F.sum(f"l{i}").over(inside) + F.col(f"s{i}")).alias(f"t{i}") for i in range(4)), (F.sum("words").over(inside) + F.col("sw")).alias("tw")), "prefix_sums")
    whole = later.groupBy("conv", "block").agg(*(F.sum(f"l{i}").alias(f"b{i}") for i in range(4)), F.sum("words").alias("bw"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select("conv", "block", *(F.sum(c).over(earlier).alias(c) for c in ("b0", "b1", "b2", "b3", "bw"))).where("b0 is not null")
    summed = later.join(carry, ["conv", "block"], "left")
    sums = [F.col(f"t{i}") + F.coalesce(f"b{i}", F.lit(0)) for i in range(4)]
    closed = summed.select(*row(F.col("depth"), sums, [F.col(f"l{i}") for i in range(4)], F.col("words"), F.col("tw") + F.coalesce("bw", F.lit(0))))
    return opened.unionByName(closed), convs.select("conv")


# ---------------------------------------------------------------- time-forward processing

RECORD = np.dtype([("level", "<i8"), ("k0", "<i8"), ("k1", "<i8"), ("leaves", "<i8"), ("saved", "<i8")])


class SpillingQueue:
    """Messages (level, k0, k1, leaves, saved), smallest first; runs over ``limit`` go to scratch files of this task."""

    def __init__(self, limit: int = 1 << 18, read: int = 1 << 12):
        self.limit, self.read = limit, read
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.spills = 0

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.heap.sort()
        for start in range(0, len(self.heap), self.read):
            file.write(np.array(self.heap[start : start + self.read], RECORD).tobytes())
        file.seek(0)
        self.heap, self.spills = [], self.spills + 1
        self._next(self._stored(file))

    def _stored(self, file):
        with file:
            while raw := file.read(self.read * RECORD.itemsize):
                yield from np.frombuffer(raw, RECORD).tolist()

    def _next(self, run) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (tuple(head), self.spills, run))

    def take(self, key: tuple[int, int, int]) -> tuple[int, int]:
        """Sums of all messages for ``key``; earlier keys must have been taken."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] == key:
            one = heapq.heappop(self.heap)
            leaves, saved = leaves + one[3], saved + one[4]
        while self.runs and self.runs[0][0][:3] == key:
            one, number, run = heapq.heappop(self.runs)
            leaves, saved = leaves + one[3], saved + one[4]
            head = next(run, None)
            if head is not None:
                heapq.heappush(self.runs, (tuple(head), number, run))
        return leaves, saved


def _time_forward(limit: int):
    """Segments in reverse level order to totals (to_parent false) and messages that leave the shards (true)."""
    schema = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("to_parent", pa.bool_()), ("leaves", pa.int64()), ("saved", pa.int64())])

    def run(batches):
        queue = SpillingQueue(limit)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                leaves, saved = queue.take((-r["bottom"], r["k0"], r["k1"]))
                leaves, saved = leaves + r["leaves"], saved + r["saved"]
                out.append((r["k0"], r["k1"], False, leaves, saved))
                if r["inside"]:
                    queue.push((-(r["top"] - 1), r["p0"], r["p1"], leaves, saved))
                elif r["top"] > 0:
                    out.append((r["p0"], r["p1"], True, leaves, saved))
            if out:
                yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))

    return lambda df: df.mapInArrow(run, "k0 long, k1 long, to_parent boolean, leaves long, saved long")


def _reverse_levels(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions(F.desc("bottom"), "k0", "k1").select("k0", "k1", "p0", "p1", "top", "bottom", "leaves", "saved", "inside")


def _totals(segments: DataFrame, rows: DataFrame, limit: int, queue: int) -> DataFrame:
    """(k0, k1, all_leaves, all_saved) of every segment with more than one member."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = segments.where("n_convs > 1")
    high = shared.where(F.col("n_convs") > limit)
    # A conversation's shard starts below its last node with over `limit` members: at most one shard each.
    under = rows.join(high.select(F.col("k0").alias("p0"), F.col("k1").alias("p1")), ["p0", "p1"], "left_semi")
    shard = under.groupBy("conv").agg(F.max(F.struct("depth", "n0", "n1")).alias("x")).select(F.col("conv").alias("conv_id"), F.col("x.depth").alias("from_depth"), F.col("x.n0").alias("r0"), F.col("x.n1").alias("r1"))
    low = shared.where(F.col("n_convs") <= limit).join(shard, "conv_id", "left")
    # Without any high segment the root's subtree is the only shard.
    low = low.withColumn("inside", F.col("top") > F.coalesce("from_depth", F.lit(0)))
    dealt = low.repartition(parts, F.coalesce("r0", F.lit(0)), F.coalesce("r1", F.lit(0)))
    forward = _time_forward(queue)
    below = staged(forward(_reverse_levels(dealt)), "shard_totals")
    sent = below.where("to_parent").groupBy("k0", "k1").agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    roots = high.join(sent, ["k0", "k1"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("in_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("in_saved", F.lit(0)))
    tops = forward(_reverse_levels(roots.withColumn("inside", F.col("top") > 0).repartition(1)))
    both = below.unionByName(tops).where("not to_parent")
    return both.select("k0", "k1", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))


# ---------------------------------------------------------------- member lists

def _chunks(batches):
    """Sorted (k0, k1, conv) rows to (k0, k1, first, ids): up to ``CHUNK`` ids as comma-joined text."""
    schema = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    key, ids, out = None, [], []

    def done():
        return (*key, ids[0], ",".join(map(str, ids)))

    for batch in batches:
        for k0, k1, conv in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "conv")), strict=True):
            if ids and (key != (k0, k1) or len(ids) == CHUNK):
                out.append(done())
                ids = []
            key = (k0, k1)
            ids.append(conv)
        if out:
            yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))
            out = []
    if ids:
        yield batch_of(schema, **dict(zip(schema.names, [[x] for x in done()], strict=True)))


def _digests(batches):
    """Chunks in order to (k0, k1, ends_sha256); one running digest at a time."""
    schema = pa.schema([("k0", pa.int64()), ("k1", pa.int64()), ("ends_sha256", pa.string())])
    key, state, out = None, None, []
    for batch in batches:
        for k0, k1, ids in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "ids")), strict=True):
            if key != (k0, k1):
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k0, k1), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)))
            out = []
    if key is not None:
        yield batch_of(schema, k0=[key[0]], k1=[key[1]], ends_sha256=[state.hexdigest()])


def _ends(ends: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256) of every node where conversations end."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = ends.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    lone = counted.where("n = 1").select("k0", "k1", F.sha2(F.col("conv").cast("string"), 256).alias("ends_sha256"))
    many = ends.join(counted.where("n > 1").select("k0", "k1"), ["k0", "k1"], "left_semi").select("k0", "k1", "conv")
    ordered = many.repartitionByRange(parts, "k0", "k1", "conv").sortWithinPartitions("k0", "k1", "conv")
    chunks = ordered.mapInArrow(_chunks, "k0 long, k1 long, first long, ids string")
    streamed = chunks.repartition(parts, "k0", "k1").sortWithinPartitions("k0", "k1", "first")
    return lone.unionByName(streamed.mapInArrow(_digests, "k0 long, k1 long, ends_sha256 string"))


# ---------------------------------------------------------------- the trie

def build(talks: DataFrame, least_members: int = LEAST_MEMBERS, top_nodes: int = TOP_NODES, queue: int = 1 << 18) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    members, convs = _members(talks)
    seen = Observation()
    rows = staged(members.observe(seen, F.count(F.lit(1)).alias("n")), "member_rows")
    limit = max(least_members, seen.get["n"] // top_nodes)
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("n0"), zero.alias("n1"), F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"), zero.alias("words"), zero.alias("before"))
    nodes = rows.unionByName(roots).groupBy("n0", "n1").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), *(F.min(c).alias(c) for c in ("depth", "p0", "p1", "words", "before"))
    )
    nodes = staged(nodes, "trie_nodes")
    first, last = (lambda c: F.min_by(c, "depth")), (lambda c: F.max_by(c, "depth"))
    segments = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), last("n0").alias("k0"), last("n1").alias("k1"), first("p0").alias("p0"), first("p1").alias("p1"),
        first("before").alias("start"), (F.max(F.col("before") + F.col("words")) - F.min("before")).alias("own_words"),
    )
    segments = staged(segments.withColumn("own", (F.col("n_convs") - 1) * F.col("own_words")), "segments")
    children = segments.where("top > 0").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    leaves = F.when(F.col("n_children").isNull(), 1).otherwise(F.col("single")).cast("long")
    segments = staged(segments.join(children, ["k0", "k1"], "left").withColumn("leaves", leaves).withColumn("saved", F.col("own")), "segments_with_children")
    totals = _totals(segments, rows, limit, queue)
    # A conversation ends at its deepest node; those without turns end at the root.
    deepest = rows.groupBy("conv").agg(F.max(F.struct("depth", "n0", "n1")).alias("x"))
    ends = convs.join(deepest, "conv", "left").select("conv", F.coalesce("x.n0", F.lit(ROOT[0])).alias("k0"), F.coalesce("x.n1", F.lit(ROOT[1])).alias("k1"))
    parents = segments.where("n_children > 0").select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("above"))
    full = segments.join(totals, ["k0", "k1"], "left").join(_ends(ends), ["k0", "k1"], "left").join(parents, ["p0", "p1"], "left")
    full = full.select(
        "conv_id", "n_convs", "top", "bottom", "start", "above", "ends_sha256", F.coalesce("n_children", F.lit(0)).alias("branches"),
        F.coalesce("all_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("all_saved", F.lit(0)).alias("saved"),
    )
    at_bottom = F.col("depth") == F.col("bottom")
    return nodes.select("conv_id", "n_convs", "depth", "before").join(full, ["conv_id", "n_convs"]).select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(at_bottom, F.col("branches")).otherwise(1).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("before") - F.col("start"))).cast("long").alias("saved_tokens"),
        F.coalesce(F.when(at_bottom, F.col("ends_sha256")), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The trie of a few (conv_id, turn, role, text) rows from whole sequences (for tests)."""
    import re
    import zlib

    talks: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(v)] for c, v in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % GROUP if c >= 0 else -(abs(c) % GROUP))
        rebuilt[c] = tuple(talks.get(base, [])[:h] + own[h:])
    members: dict[tuple, list] = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q != p and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(inside) if rebuilt[c] == path)
        out.append((min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out
