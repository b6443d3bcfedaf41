"""Suffix-array dedup: bytes covered by long strings that occur again are removed.

The suffixes that are sorted start at anchors: each 400-byte string has one, the place of the
smallest hash among its 32-byte grams (the first if equal), so equal strings have their anchor at
the same place. An anchor stands for the strings around it: those that start ``l`` bytes before
it, for a range of ``l``. Only anchors whose gram occurs again are kept (an exact filter).

Distributed merge sort of the anchors' suffixes: each task sorts its own into runs, front-codes
them (shared prefix length and rest; equal contexts once) and sends each run to the bucket of its
gram; a bucket merges its runs with a loser tree that carries the common prefix with the last
winner, so no known prefix is compared again. The merged order with its prefix lengths gives, for
every length, which suffixes agree; an ordering of the bytes to the left does so leftwards. A
string ``l`` bytes before an anchor occurs again exactly if another anchor agrees on ``l`` bytes to
the left and the remaining bytes to the right.

A gram with more than ``HOT_GROUP`` anchors is not kept together: its strings are dealt one by
one, by their whole content, so equal ones meet and unequal ones spread. Equal texts are reduced to
one first; a text with copies is covered as a whole.

Null text counts as empty; texts shorter than the length keep all bytes. Empty tables give empty
results. Repeated rows and keys each get a row (and count as copies of each other). Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, staged, text_slices
from codelattice.llm.text_features import mixed

LENGTH, GRAM = 400, 32
HOT_GROUP = 50_000
SLICE = 2 << 20


# ---------------------------------------------------------------- anchors

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes that start at each position."""
    x = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))[data]
    factor, size = 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        x = x[:-size] * np.uint64(factor) + x[size:]
        factor, size = factor * factor % (1 << 64), size * 2
    return mixed(x)


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    onward = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], onward[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, gram hash, position in the text, smallest and largest l) of all anchors of concatenated texts."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < length or not (sizes >= length).any():
        return none
    grams = gram_hashes(data)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    place = (window_minimum(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own = np.zeros(len(data) + 1, np.int64)  # windows that lie inside one text
    long = sizes >= length
    np.add.at(own, starts[long], 1)
    np.add.at(own, starts[long] + sizes[long] - length + 1, -1)
    inside = np.flatnonzero(np.cumsum(own[: len(place)]) > 0)
    place = place[inside]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)]))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    text = np.searchsorted(starts, at, side="right") - 1
    # Empty texts share a start with the next text; the last text that starts there is the one with bytes.
    return text, grams[at], at - starts[text], at - inside[last], at - inside[first]


def _described(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(key, digest, grams, places, lows, highs) of every text."""
    schema = pa.schema([(key, pa.int64()), ("digest", pa.binary()), ("grams", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("places", "lows", "highs"))])

    def run(batches):
        for batch in text_slices(batches, text, SLICE):
            raws = [t.as_buffer() or b"" for t in batch.column(text)]
            sizes = np.array([len(r) for r in raws], np.int64)
            starts = np.cumsum(sizes) - sizes
            data = np.frombuffer(b"".join(raws), np.uint8)
            owner, grams, places, lows, highs = anchors(data, starts, sizes, length)
            cuts = pa.array(np.searchsorted(owner, np.arange(len(raws) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (grams.view(np.int64), *(x.astype(np.int32) for x in (places, lows, highs)))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([xxhash.xxh128_digest(r) for r in raws], pa.binary()), *lists], schema=schema)

    return docs.mapInArrow(run, f"{key} long, digest binary, grams array<long>, places array<int>, lows array<int>, highs array<int>")


def _with_digest(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, bytes, carried) of every text; ``carried`` passes through."""
    carried = docs.schema["carried"].dataType.simpleString()

    def run(batches):
        for batch in text_slices(batches, text, SLICE):
            raws = [(t.as_buffer() or b"") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([xxhash.xxh128_digest(r) for r in raws], pa.binary()), pa.array([bytes(r) for r in raws], pa.binary()), batch.column("carried")],
                names=[key, "digest", "bytes", "carried"],
            )

    return docs.mapInArrow(run, f"`{key}` long, digest binary, bytes binary, carried {carried}")


# ---------------------------------------------------------------- runs and merging

def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    limit, step = min(len(a), len(b)), 64
    while start < limit:
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
            return start + (((differ & -differ).bit_length() - 1) // 8 if differ else n)
        start += step
    return limit


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared prefix with the string before, and the rests, of sorted strings."""
    before, prefixes, rests = b"", np.zeros(len(strings), np.int32), []
    for i, s in enumerate(strings):
        prefixes[i] = n = shared_prefix(before, s)
        rests.append(s[n:])
        before = s
    return prefixes, b"".join(rests)


def front_decode(prefixes: np.ndarray, sizes: np.ndarray, rests: bytes) -> list[bytes]:
    out, before, at = [], b"", 0
    for prefix, size in zip(prefixes.tolist(), sizes.tolist(), strict=True):
        end = at + size - prefix
        before = before[:prefix] + rests[at:end]
        at = end
        out.append(before)
    return out


def merge_runs(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Loser-tree merge of sorted runs: run and place of every string in order, and its prefix with the one before.

    Every waiting string knows how much it shares with the last winner. The longer prefix wins
    without a comparison; equal prefixes are compared from there on only, and the loser's new
    prefix with the winner is what the comparison found.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    head: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # prefix with the last winner
    tree = [-1] * k  # losers; an entry is a run

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads; the loser's known prefix becomes that with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = shared_prefix(x, y, known[a])
        # What ends first is smaller; equal strings go by their run.
        if n == len(x) and n == len(y):
            win, lose = (a, b) if a < b else (b, a)
        elif n == len(x) or (n < len(y) and x[n] < y[n]):
            win, lose = a, b
        else:
            win, lose = b, a
        known[lose] = n
        return win, lose

    level = list(range(k))
    at = k // 2
    while len(level) > 1:
        winners = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            winners.append(win)
            tree[at + i // 2] = lose
        level, at = winners, at // 2
    top = level[0] if level else -1
    order_run, order_place, order_prefix = [], [], []
    while top >= 0 and head[top] is not None:
        order_run.append(top)
        order_place.append(place[top])
        order_prefix.append(known[top])
        place[top] += 1
        run = runs[top]
        if place[top] < len(run):
            head[top], known[top] = run[place[top]], prefixes[top][place[top]]
        else:
            head[top] = None
        node = (top + k) // 2
        while node >= 1:
            top, tree[node] = play(top, tree[node]) if k > 1 else (top, -1)
            node //= 2
    return order_run, order_place, order_prefix


def repeated_strings(suffix_prefix: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """[anchor, l] whether the string l bytes before the anchor occurs again; anchors in suffix order.

    ``left`` holds the bytes before each anchor, nearest first, padded with zeros.
    """
    m, wide = left.shape
    out = np.zeros((m, wide + 1), bool)
    if wide:
        order = np.argsort(np.ascontiguousarray(left).view(f"V{wide}").reshape(-1), kind="stable")
        ranked = left[order]
        differ = ranked[1:] != ranked[:-1]
        agree = np.where(differ.any(1), differ.argmax(1), wide)
    else:
        order, agree = np.arange(m), np.zeros(max(m - 1, 0), np.int64)
    for l in range(int(low.min()), int(high.max()) + 1):
        valid = np.flatnonzero((low <= l) & (l <= high))
        if not len(valid):
            continue
        right_class = np.concatenate([[0], np.cumsum(suffix_prefix[1:] < length - l)])[valid]
        left_class = np.empty(m, np.int64)
        left_class[order] = np.concatenate([[0], np.cumsum(agree < l)])
        both = right_class * m + left_class[valid]
        rank = np.argsort(both, kind="stable")
        ranked_both = both[rank]
        same = np.zeros(len(valid) + 1, bool)
        same[1:-1] = ranked_both[1:] == ranked_both[:-1]
        hit = np.zeros(len(valid), bool)
        hit[rank] = same[1:] | same[:-1]
        out[valid, l] = hit | (copies[valid] > 1)
    return out


# ---------------------------------------------------------------- passes

RUN_FIELDS = "bucket int, n int, prefixes binary, sizes binary, rests binary, lefts binary, lows binary, highs binary, counts binary, digests binary, places binary"


def _zip(x) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes(), 1)


def _unzip(raw: bytes, kind=None):
    data = zstandard.decompress(raw)
    return data if kind is None else np.frombuffer(data, kind)


def _runs(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Sorted, front-coded runs of the anchors' suffixes, one per bucket and about eight megabytes of context."""
    def code(held: dict[int, dict]):
        for bucket, contexts in held.items():
            ordered = sorted(contexts.items(), key=lambda x: x[0])  # by suffix, then left side and range
            strings = [c[0] for c, _ in ordered]
            prefixes, rests = front_code(strings)
            occurrences = [o for _, own in ordered for o in own]
            yield {
                "bucket": bucket, "n": len(ordered), "prefixes": _zip(prefixes), "sizes": _zip(np.array([len(s) for s in strings], np.int32)), "rests": _zip(rests),
                "lefts": _zip(b"".join(c[1] for c, _ in ordered)), "lows": _zip(np.array([c[2] for c, _ in ordered], np.int32)), "highs": _zip(np.array([c[3] for c, _ in ordered], np.int32)),
                "counts": _zip(np.array([len(own) for _, own in ordered], np.int32)), "digests": _zip(b"".join(o[0] for o in occurrences)), "places": _zip(np.array([o[1] for o in occurrences], np.int32)),
            }

    def run(batches):
        held: dict[int, dict] = {}
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                raw, digest = row["bytes"], row["digest"]
                for a in row["anchors"]:
                    at, cells = a["place"], [(a["low"], a["high"])] if not a["hot"] else [(l, l) for l in range(a["low"], a["high"] + 1)]
                    for low, high in cells:
                        right, left = raw[at : at - low + length], raw[at - high : at][::-1]
                        bucket = (a["gram"] if not a["hot"] else xxhash.xxh64_intdigest(raw[at - low : at - low + length])) % buckets
                        own = held.setdefault(bucket, {}).setdefault((right, left, low, high), [])
                        if not own:
                            size += len(right) + len(left) + 200
                        own.append((digest, at))
                if size > 48 << 20:
                    yield pa.RecordBatch.from_pylist(list(code(held)))
                    held, size = {}, 0
        if held:
            yield pa.RecordBatch.from_pylist(list(code(held)))

    schema = {"bucket": pa.int32(), "n": pa.int32()}

    def typed(batches):
        for batch in run(batches):
            names = [f.split()[0] for f in RUN_FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(n).cast(schema.get(n, pa.binary())) for n in names], names=names)

    return texts.mapInArrow(typed, RUN_FIELDS)


def _merged(runs: DataFrame, length: int, tail: int = 0) -> DataFrame:
    """(digest, starts, stops): bytes of a text that repeated strings cover, one row per text and bucket.

    Spans are joined where they still touch without their last ``tail`` bytes.
    """
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        strings, prefixes, columns = [], [], []
        for row in pdf.itertuples():
            own_prefixes = _unzip(row.prefixes, np.int32)
            strings.append(front_decode(own_prefixes, _unzip(row.sizes, np.int32), _unzip(row.rests)))
            prefixes.append(own_prefixes.tolist())
            columns.append((_unzip(row.lows, np.int32), _unzip(row.highs, np.int32), _unzip(row.counts, np.int32), _unzip(row.lefts), _unzip(row.digests), _unzip(row.places, np.int32)))
        which, place, shared = merge_runs(strings, prefixes)
        base = np.cumsum([0] + [len(s) for s in strings])
        flat = base[which] + np.array(place, np.int64)
        low, high, counts = (np.concatenate([c[i] for c in columns])[flat].astype(np.int64) for i in range(3))
        wide = int(high.max())
        # Left sides in run order: offsets by their lengths, which are the largest l.
        lengths = np.concatenate([c[1] for c in columns]).astype(np.int64)
        bytes_left = np.frombuffer(b"".join(c[3] for c in columns), np.uint8)
        offset = (np.cumsum(lengths) - lengths)[flat]
        digests, places = b"".join(c[4] for c in columns), np.concatenate([c[5] for c in columns])
        total = np.concatenate([c[2] for c in columns]).astype(np.int64)
        occurrence = (np.cumsum(total) - total)[flat]
        shared = np.array(shared, np.int64)
        out_text, out_start, out_stop = [], [], []
        numbers: dict[bytes, int] = {}
        # Anchors that share no gram never meet: solve stretches of the order that do, so the work is by group.
        cut = np.flatnonzero(np.concatenate([[True], shared[1:] < GRAM]))
        for a, b in _groups(cut, len(flat)):
            lone = b - a == 1 and counts[a] == 1
            if lone:
                continue
            rows = np.arange(a, b)
            reach = int(high[rows].max())
            left = np.zeros((len(rows), reach), np.uint8)
            for i, r in enumerate(rows):
                left[i, : high[r]] = bytes_left[offset[r] : offset[r] + high[r]]
            own_shared = shared[rows].copy()
            own_shared[0] = 0
            found = repeated_strings(own_shared, left, low[rows], high[rows], counts[rows], length)
            for i in np.flatnonzero(found.any(1)):
                r = rows[i]
                ls = np.flatnonzero(found[i])
                breaks = np.flatnonzero(np.diff(ls) > 1)
                lowest, highest = ls[np.append(0, breaks + 1)], ls[np.append(breaks, len(ls) - 1)]
                own = slice(occurrence[r], occurrence[r] + counts[r])
                texts = [numbers.setdefault(digests[16 * o : 16 * o + 16], len(numbers)) for o in range(own.start, own.stop)]
                out_text.append(np.repeat(np.array(texts, np.int64), len(lowest)))
                out_start.append((places[own][:, None] - highest[None, :]).reshape(-1))
                out_stop.append((places[own][:, None] - lowest[None, :] + length).reshape(-1))
        if not out_text:
            return pd.DataFrame({"digest": pd.Series([], dtype=object), "starts": pd.Series([], dtype=object), "stops": pd.Series([], dtype=object)})
        text, start, stop = (np.concatenate(x).astype(np.int64) for x in (out_text, out_start, out_stop))
        rank = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[rank], np.arange(len(numbers) + 1))
        spans = [union_of(start[rank[i:j]], stop[rank[i:j]], tail) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pd.DataFrame({"digest": list(numbers), "starts": [x[0].tolist() for x in spans], "stops": [x[1].tolist() for x in spans]})

    return runs.groupBy("bucket").applyInPandas(merge, "digest binary, starts array<int>, stops array<int>")


def _groups(cut: np.ndarray, n: int, most: int = 4_096):
    """Stretches between cuts, small ones joined up to ``most`` rows (they cannot agree across a cut)."""
    ends = np.append(cut[1:], n)
    a = b = None
    for start, end in zip(cut.tolist(), ends.tolist(), strict=True):
        if end - start == 1 and a is None:
            yield start, end
            continue
        if a is None:
            a, b = start, end
        elif end - a <= most:
            b = end
        else:
            yield a, b
            a, b = start, end
        if b - a >= most:
            yield a, b
            a = None
    if a is not None:
        yield a, b


def union_of(starts: np.ndarray, stops: np.ndarray, tail: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans; with a ``tail`` they touch without their last bytes."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1] - tail]))
    return starts[first], reach[np.append(first[1:], len(starts)) - 1]


def whole_words(raw: bytes, start: int, stop: int) -> int:
    """Words of a stretch of a text, without those that go on beyond its ends."""
    def inside(at: int) -> bool:
        return 0 < at < len(raw) and all(c >= 128 or chr(c).isalnum() for c in raw[at - 1 : at + 1])

    return len(raw[start:stop].split()) - inside(start) - inside(stop)


def long_enough(raw: bytes, starts: np.ndarray, stops: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that have the words or ``LENGTH`` bytes, joined where they touch."""
    keep = np.array([b - a >= LENGTH or whole_words(raw, a, b) >= least_words for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], bool)
    return union_of(starts[keep], stops[keep])


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot_group: int = HOT_GROUP, whole_characters: bool = False, carry: tuple[str, ...] = (), least_words: int = 0) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, spans, kept, carried) of every text: removed runs and remaining bytes.

    With ``whole_characters`` a run gives up bytes at its ends that belong to a character it does not cover.
    ``carried`` is a struct of the columns named by ``carry``. With ``least_words`` only runs of so many
    whole words, or of ``LENGTH`` bytes, are removed.
    """
    spark = docs.sparkSession
    carried = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    carrying = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text), carried.alias("carried"))
    docs = carrying.select(key, text)
    described = _described(docs, key, text, length)
    single = staged(described.groupBy("digest").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("grams", "places", "lows", "highs"))), "distinct_texts")
    each = single.select("digest", "rep", F.explode(F.arrays_zip("grams", "places", "lows", "highs")).alias("x"))
    each = each.select("digest", "rep", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"), F.col("x.lows").alias("low"), F.col("x.highs").alias("high"))
    # Stored, so that the join shuffles both sides and a gram of very many anchors can be split.
    repeated = staged(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated_grams")
    shared = each.join(repeated, "gram")
    wanted = shared.groupBy("digest", "rep").agg(F.collect_list(F.struct("gram", "place", "low", "high", (F.col("n") > hot_group).alias("hot"))).alias("anchors"))
    texts = _with_digest(docs.withColumn("carried", F.lit(0)), key, text)
    chosen = texts.join(wanted.withColumnRenamed("digest", "own"), (F.col("digest") == F.col("own")) & F.col(key).eqNullSafe(F.col("rep"))).select("digest", "bytes", "anchors")
    tail = length - 1 if least_words else 0
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    covered = staged(_merged(_runs(chosen, buckets, length), length, tail), "covered")
    spans = covered.groupBy("digest").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "stops"))).alias("covered"))
    copied = single.where("copies > 1").select("digest", F.lit(True).alias("copied"))
    marks = spans.join(copied, "digest", "full").withColumnRenamed("digest", "own")
    joined = _with_digest(carrying, key, text).join(marks, F.col("digest") == F.col("own"), "left")
    joined = joined.select(key, "bytes", F.coalesce("copied", F.lit(False)).alias("copied"), "covered", "carried")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", span_type), ("kept", pa.binary())])

    def remove(batches):
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
            for i in range(batch.num_rows):
                raw = batch.column("bytes")[i].as_py()
                if batch.column("copied")[i].as_py() and len(raw) >= length:
                    starts, stops = np.array([0]), np.array([len(raw)])
                else:
                    own = batch.column("covered")[i].as_py() or []
                    starts, stops = union_of(np.array([x["starts"] for x in own], np.int64), np.array([x["stops"] for x in own], np.int64), tail)
                if least_words:
                    starts, stops = long_enough(raw, starts, stops, least_words)
                runs, parts, at = [], [], 0
                for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
                    while whole_characters and start < stop and raw[start] & 0xC0 == 0x80:
                        start += 1
                    while whole_characters and start < stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                        stop -= 1
                    if start < stop:
                        runs.append({"start": start, "stop": stop})
                        parts.append(raw[at:start])
                        at = stop
                parts.append(raw[at:])
                kept = b"".join(parts)
                for name, value in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(runs)), ("spans", runs), ("kept", kept)):
                    out[name].append(value)
            done = batch_of(schema, **{key: batch.column(key)}, **out)
            yield pa.RecordBatch.from_arrays([*done.columns, batch.column("carried")], names=[*schema.names, "carried"])

    kind = f"`{key}` long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary"
    return joined.mapInArrow(remove, f"{kind}, carried {joined.schema['carried'].dataType.simpleString()}")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars", length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, in whole characters; the length column follows, others stay.

    ``length`` and ``least_words`` say what counts as a passage, as in ``deduplicate``.
    """
    carry = tuple(c for c in docs.columns if c not in (key, text, chars))
    found = deduplicate(docs, key, text, length, whole_characters=True, carry=carry, least_words=least_words)
    kept = F.col("kept").cast("string")
    columns = {key: F.col(key), text: kept, chars: F.length(kept).cast("long")}
    return found.select(*(columns.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Removed runs of a few small texts, by counting all strings (for tests)."""
    counts: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            counts[t[p : p + length]] = counts.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        at = np.array([p for p in range(len(t) - length + 1) if counts[t[p : p + length]] > 1], np.int64)
        starts, stops = union_of(at, at + length)
        out.append(list(zip(starts.tolist(), stops.tolist(), strict=True)))
    return out
