"""Language-model scores by deleted interpolation.

The chance of a word mixes the maximum-likelihood estimates of all orders (uniform, unigram,
bigram, ...); the weights belong to the bucket of the context's frequency (powers of two) and are
learned by expectation-maximisation on counts held out of the estimates: a fold of the training
documents is deleted from the counts and predicted from the rest. Scores then use the counts of
all training documents. A text starts with a start sign, which is context only, and ends with an
end sign, which is a token.

Flow, all in Spark: (1) texts become chunks of word codes where they are read; (2) every chunk
reduces its n-grams to counts and sends them, sorted, to key ranges; (3) a key range adds the
counts of all chunks and answers each chunk with the totals of the n-grams it sent; (4) a chunk
meets its answers and holds, for every token, the counts its chance needs; (5) the held-out tokens
give a histogram of probability ratios (5 % steps, whole corpus) on which the weights are learned
in the driver; (6) texts are scored. N-grams are known by 64-bit keys. What is sent grows with the
corpus; a frequent n-gram costs one count per chunk.

Null text counts as empty: one token, the end. Empty tables give empty results. Repeated rows and
keys give a row each. Rows with a null key are never held out. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import fold, staged, text_slices, words_of
from codelattice.llm.text_features import mixed

ORDER = 2
#: Text bytes of a chunk; share of training documents that is deleted for learning the weights.
CHUNK_BYTES, DELETED = 10 << 20, 10
STEPS_PER_NAT, ROUNDS = 20, 60
NONE = -(1 << 15)

START_KEY, END_KEY = np.uint64(0x5354415254), np.uint64(0x454E44)


# ---------------------------------------------------------------- packed arrays

def pack(x: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    raw = np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return zstandard.compress(raw.tobytes(), 1)


def unpack(raw: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)), 8)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, 8), dtype=np.uint64)


# ---------------------------------------------------------------- n-gram keys

def ngram_keys(word_keys: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order: the key of the n-gram that ends at each token; contexts before a text are start signs."""
    n = len(word_keys)
    inside = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, levels = word_keys, [word_keys]
    for back in range(1, order):
        before = np.full(n, START_KEY, np.uint64)
        reach = inside >= back
        before[reach] = word_keys[np.flatnonzero(reach) - back]
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + mixed(before + np.uint64(back)))
        levels.append(keys)
    return levels


def start_keys(order: int) -> list[np.uint64]:
    """Keys of the contexts made of start signs alone, by their length."""
    keys, out = np.array([START_KEY], np.uint64), [START_KEY]
    for back in range(1, order):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([START_KEY], np.uint64) + np.uint64(back)))
        out.append(keys[0])
    return out


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, the sorting order, and where each distinct key starts in it."""
    rank = np.argsort(keys, kind="stable")
    ranked = keys[rank]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ranked[starts], rank, starts


# ---------------------------------------------------------------- passes

def _chunks(docs: DataFrame, key: str, text: str, modulus: int, remainder: int) -> DataFrame:
    """(chunk, keys, sizes, role, dictionary, codes): role 0 is held out, 1 trains, 2 trains and is deleted for the weights."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, text, CHUNK_BYTES):
            flat, counts = words_of(batch.column(text), lower=True)
            coded = flat.dictionary_encode()
            words = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
            codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(counts), len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + number]), pa.array([batch.column(key).to_pylist()], pa.list_(pa.int64())), pa.array([counts + 1], pa.list_(pa.int64())), pa.array([batch.column("role").to_numpy()], pa.list_(pa.int32())), pa.array([pack(np.append(words, END_KEY), 8)], pa.binary()), pa.array([pack(codes)], pa.binary())],
                names=["chunk", "keys", "sizes", "role", "dictionary", "codes"],
            )
            number += 1

    deleted = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(DELETED)) == 0
    held = F.coalesce(fold(key, modulus), F.lit(-1)) == remainder
    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    rows = rows.select(key, text, F.when(held, 0).when(deleted, 2).otherwise(1).cast("int").alias("role"))
    return rows.mapInArrow(run, "chunk long, keys array<long>, sizes array<long>, role array<int>, dictionary binary, codes binary")


def _unpacked(row: dict, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    sizes = np.asarray(row["sizes"], np.int64)
    levels = ngram_keys(unpack(row["dictionary"], 8)[unpack(row["codes"])], sizes, order)
    return levels, sizes, np.repeat(np.asarray(row["role"], np.int64), sizes)


def _sent(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """Per chunk and key range: the chunk's distinct n-grams with their training and deleted counts."""
    starts = start_keys(order)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels, sizes, role = _unpacked(row, order)
                docs = [np.sum(np.asarray(row["role"]) > 0), np.sum(np.asarray(row["role"]) == 2)]
                for level, keys in enumerate(levels, 1):
                    found, rank, first = grouped(keys)
                    train = np.add.reduceat((role[rank] > 0).astype(np.int64), first)
                    gone = np.add.reduceat((role[rank] == 2).astype(np.int64), first)
                    if level < order:  # the context of start signs occurs once in each text
                        at = int(np.searchsorted(found, starts[level - 1]))
                        found, train, gone = np.insert(found, at, starts[level - 1]), np.insert(train, at, docs[0]), np.insert(gone, at, docs[1])
                    where = (found >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
                    a, b = cuts[:-1], cuts[1:]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where[a], pa.int32()), pa.array(np.full(len(a), row["chunk"])), pa.array(np.full(len(a), level), pa.int32()),
                         pa.array([pack_sorted(found[i:j]) for i, j in zip(a, b, strict=True)], pa.binary()), pa.array([pack(train[i:j]) for i, j in zip(a, b, strict=True)], pa.binary()), pa.array([pack(gone[i:j]) for i, j in zip(a, b, strict=True)], pa.binary())],
                        names=["range", "chunk", "level", "found", "train", "gone"],
                    )

    return chunks.mapInArrow(run, "range int, chunk long, level int, found binary, train binary, gone binary")


def _answers(sent: DataFrame) -> DataFrame:
    """Totals over all chunks for every n-gram a chunk sent, and the distinct trained words of each range."""
    start = START_KEY

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for level, rows in pdf.groupby("level", sort=True):
            keys = [unpack_sorted(r) for r in rows["found"]]
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            train = np.bincount(inverse, np.concatenate([unpack(r) for r in rows["train"]]), len(found)).astype(np.int64)
            gone = np.bincount(inverse, np.concatenate([unpack(r) for r in rows["gone"]]), len(found)).astype(np.int64)
            words = int(((train > 0) & (found != start)).sum()) if level == 1 else 0
            kept = int(((train > gone) & (found != start)).sum()) if level == 1 else 0
            end = 0
            for i, (chunk, own) in enumerate(zip(rows["chunk"], keys, strict=True)):
                part = inverse[end : end + len(own)]
                end += len(own)
                out.append((chunk, pdf["range"].iloc[0], level, pack(train[part]), pack(gone[part]), words if i == 0 else 0, kept if i == 0 else 0))
        return pd.DataFrame(out, columns=["chunk", "range", "level", "train", "gone", "words", "kept"])

    return sent.groupBy("range").applyInPandas(add, "chunk long, range int, level int, train binary, gone binary, words long, kept long")


def _counted(chunks: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    """Per chunk: for every token the counts of its n-grams, with all training texts and without the deleted fold."""
    starts = start_keys(order)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"chunk": [], "keys": [], "sizes": [], "role": [], "counts": [], "rest": []})
        row = left.iloc[0]
        levels, sizes, role = _unpacked(row, order)
        counts, rest = [], []
        for level, keys in enumerate(levels, 1):
            rows = right[right["level"] == level].sort_values("range")
            train = np.concatenate([unpack(r) for r in rows["train"]]).astype(np.int64)
            gone = np.concatenate([unpack(r) for r in rows["gone"]]).astype(np.int64)
            found, rank, first = grouped(keys)
            starting = np.zeros(2, np.int64)
            if level < order:
                at = int(np.searchsorted(found, starts[level - 1]))
                starting[:] = train[at], gone[at]
                train, gone = np.delete(train, at), np.delete(gone, at)
            span = np.diff(np.append(first, len(keys)))
            for values, out, own in ((train, counts, starting[0]), (train - gone, rest, starting[0] - starting[1])):
                each = np.zeros(len(keys), np.int64)
                each[rank] = np.repeat(values, span)
                out.append(pack(np.append(each, own)))  # the last number belongs to the start context
        return pd.DataFrame({"chunk": [row["chunk"]], "keys": [row["keys"]], "sizes": [row["sizes"]], "role": [row["role"]], "counts": [counts], "rest": [[r if (role == 2).any() else b"" for r in rest]]})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(meet, "chunk long, keys array<long>, sizes array<long>, role array<int>, counts array<binary>, rest array<binary>")


def _estimates(packed: list[bytes], sizes: np.ndarray, total: float, words: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates of all orders for every token (uniform first), and its context bucket."""
    levels = [unpack(p).astype(np.int64) for p in packed]
    n = len(levels[0]) - 1
    first = np.zeros(n, bool)
    first[np.cumsum(sizes) - sizes] = True
    out = [np.full(n, 1.0 / (words + 1)), levels[0][:n] / max(total, 1)]
    context = np.full(n, int(total))
    for level in range(1, len(levels)):
        shorter = levels[level - 1]
        context = np.empty(n, np.int64)
        context[1:] = shorter[: n - 1]
        context[first] = shorter[n]
        out.append(np.where(context > 0, levels[level][:n] / np.maximum(context, 1), 0.0))
    bucket = np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)
    return out, bucket


def _histogram(counted: DataFrame, order: int, total: float, words: float) -> pd.DataFrame:
    """Deleted tokens by context bucket and probability ratios to the uniform estimate, in steps of 5 %."""
    names = [f"q{k}" for k in range(1, order + 1)]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if not any(row["rest"]):
                    continue
                sizes = np.asarray(row["sizes"], np.int64)
                estimates, bucket = _estimates(row["rest"], sizes, total, words)
                own = np.repeat(np.asarray(row["role"]), sizes) == 2
                cells = [bucket[own]]
                for p in estimates[1:]:
                    p = p[own]
                    cells.append(np.where(p > 0, np.round(STEPS_PER_NAT * np.log(np.maximum(p, 1e-300) * (words + 1))), NONE).astype(np.int64))
                found, n = np.unique(np.column_stack(cells), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found.T), pa.array(n)], names=["bucket", *names, "n"])

    rows = counted.select("sizes", "role", "rest").mapInArrow(run, ", ".join(f"{c} long" for c in ("bucket", *names, "n")))
    return rows.groupBy("bucket", *names).agg(F.sum("n").alias("n")).toPandas()


def learn_weights(histogram: pd.DataFrame, order: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights [bucket, order] by expectation-maximisation; a bucket without tokens takes the one below it."""
    weights = np.zeros((66, order + 1))
    last = np.full(order + 1, 1.0 / (order + 1))
    for bucket in range(66):
        own = histogram[histogram["bucket"] == bucket]
        if len(own):
            n = own["n"].to_numpy(np.float64)
            q = own[[f"q{k}" for k in range(1, order + 1)]].to_numpy(np.float64)
            ratio = np.column_stack([np.ones(len(own)), np.where(q == NONE, 0.0, np.exp(np.clip(q, -700, 700) / STEPS_PER_NAT))])
            last = np.full(order + 1, 1.0 / (order + 1))
            for _ in range(rounds):
                mix = ratio * last
                last = (mix / mix.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            last = np.maximum(last, 1e-9)
            last /= last.sum()
        weights[bucket] = last
    return weights


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = ORDER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, int(np.ceil(np.log2(ranges))))
    chunks = staged(_chunks(docs, key, text, modulus, remainder), "lm_chunks")
    answers = staged(_answers(_sent(chunks, order, bits)), "lm_answers")
    summed = answers.agg(F.sum("words").alias("words"), F.sum("kept").alias("kept")).first()
    of = lambda least: F.aggregate(F.arrays_zip("sizes", "role"), F.lit(0).cast("long"), lambda a, x: a + F.when(least(x["role"]), x["sizes"]).otherwise(F.lit(0)))
    tokens = chunks.agg(F.sum(of(lambda r: r > 0)).alias("train"), F.sum(of(lambda r: r == 1)).alias("rest")).first()
    words, total = float(summed["words"] or 0), float(tokens["train"] or 0)
    counted = staged(_counted(chunks, answers, order), "lm_counts")
    weights = learn_weights(_histogram(counted, order, float(tokens["rest"] or 0), float(summed["kept"] or 0)), order)
    schema = pa.schema([(key, pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.asarray(row["sizes"], np.int64)
                estimates, bucket = _estimates(row["counts"], sizes, total, words)
                chance = sum(weights[bucket, k] * p for k, p in enumerate(estimates))
                seen = unpack(row["counts"][0])[:-1].astype(np.float64)
                at = np.cumsum(sizes) - sizes
                per_text = [np.add.reduceat(x, at) for x in (seen > 0, np.log10((seen + 1) / (total + words + 1)), np.log10(chance))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.int64()), pa.array(np.asarray(row["role"]) == 0), pa.array(sizes), pa.array(per_text[0].astype(np.int64)), pa.array(np.full(len(sizes), int(total))), pa.array(per_text[1]), pa.array(per_text[2])],
                    schema=schema,
                )

    return counted.select("keys", "sizes", "role", "counts").mapInArrow(run, f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
