"""Quality scores by pairwise ranking (Bradley-Terry).

A document's strength is linear in features of its whole text; the chance that one document beats
another is the logistic of the difference of their strengths. Weights minimise the logistic loss
on feature differences of preference pairs (a document labelled good against one labelled bad),
drawn from a bounded sample of labelled rows. The cut between good and bad is a quantile of the
sample's strengths, the one that agrees best with the sample's labels; scores are the logistic of
the distance to that cut.

Features are computed once for all documents and stored; labels, language, source and key are
never features. Null text counts as empty and gets a score. Rows without a label never train.
Without labels of both kinds every score is 0.5. Empty tables give empty results. Repeated rows
and keys give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, bounded_sample, fold, staged, text_slices
from codelattice.llm.text_features import SYMBOLS, TextCounts

#: Labelled rows a model is fitted on, preference pairs drawn from them, weight of the ridge.
SAMPLE, PAIRS, RIDGE = 20_000, 60_000, 1e-3

UPPER, LOWER, DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)


def _features(c: TextCounts) -> np.ndarray:
    counts = c.byte_counts()
    words, chars = np.maximum(c.n_words, 1), np.maximum(c.word_chars, 1)
    up, low = counts[:, UPPER].sum(1), counts[:, LOWER].sum(1)
    letters = np.maximum(up + low, 1)
    filled, same = c.lines()
    repeats, distinct = c.repeats(), c.distinct_words()
    return np.column_stack([
        np.log1p(c.n_words), c.n_words == 0, chars / words, np.sqrt(counts[:, list(SYMBOLS)].sum(1) / chars), np.sqrt(up / letters),
        np.sqrt(repeats / words), np.sqrt(same / np.maximum(filled, 1)), np.log1p(distinct) / np.log1p(words), np.sqrt(1 - distinct / words),
        np.sqrt(counts[:, ord("!")] / words), np.sqrt(counts[:, ord(".")] / words), np.sqrt(counts[:, ord(",")] / words),
        np.sqrt(counts[:, ord("|")] / words), np.sqrt(counts[:, DIGITS].sum(1) / chars), np.log1p(c.n_words / np.maximum(filled, 1)),
        np.sqrt(counts[:, 0x80:].sum(1) / chars), np.sqrt(counts[:, ord("?")] / words),
    ]).astype(np.float64)


def text_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x array<double>) of every whole text."""
    schema = pa.schema([(key, pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in text_slices(batches, text):
            yield batch_of(schema, **{key: batch.column(key)}, x=list(_features(TextCounts(batch.column(text)))))

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} long, x array<double>")


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> dict | None:
    """Weights, the cut and its scale from labelled feature rows; None without both labels."""
    win, lose = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(win) or not len(lose):
        return None
    mean, spread = x.mean(0), x.std(0)
    z = (x - mean) / np.where(spread > 1e-9, spread, 1.0)
    draw = np.random.default_rng(seed)
    n = min(pairs, 20 * len(x))
    difference = z[draw.choice(win, n)] - z[draw.choice(lose, n)]
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps on the mean logistic loss plus the ridge
        p = logistic(difference @ w)
        slope = -(difference * (1 - p)[:, None]).mean(0) + ridge * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ w
    order = np.argsort(strength, kind="stable")
    ranked, label = strength[order], good[order]
    # Cutting below rank k calls k rows bad: agreement is the bad rows below plus the good rows from there on.
    agree = np.concatenate([[0], np.cumsum(label == 0)]) + np.concatenate([np.cumsum((label == 1)[::-1])[::-1], [0]])
    best = np.flatnonzero(agree == agree.max())
    quantile = best[len(best) // 2] / len(x)
    k = best[len(best) // 2]
    low, high = ranked[max(k - 1, 0)], ranked[min(k, len(ranked) - 1)]
    cut = (low + high) / 2
    scale = max(1e-6, np.median(np.abs(strength - cut)) / 3)
    return {"mean": mean, "spread": np.where(spread > 1e-9, spread, 1.0), "w": w, "cut": cut, "scale": scale, "quantile": quantile}


def predict(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return logistic(((x - model["mean"]) / model["spread"] @ model["w"] - model["cut"]) / model["scale"])


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(key, held_out, score, predicted) of every document; labels of held-out rows are not used."""
    features = staged(text_features(docs, key, text), "quality_features")
    known = labels.select(F.col(key).cast("long").alias(key), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (fold(key, modulus) != remainder))
    known = bounded_sample(known.dropDuplicates([key]), key, sample)
    rows = features.join(F.broadcast(known), key).orderBy(key).limit(2 * sample).toPandas()
    model = fit(np.array(rows["x"].tolist(), np.float64), rows["label"].to_numpy()) if len(rows) else None
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            if batch.num_rows:
                yield batch_of(schema, **{key: batch.column(key)}, score=predict(model, flat.reshape(batch.num_rows, -1)))

    out = features.mapInArrow(run, f"{key} long, score double")
    return out.select(key, (F.coalesce(fold(key, modulus), F.lit(-1)) == remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
