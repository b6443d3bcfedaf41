"""Quality rules as a short-circuit cascade.

Every rule is timed and tried on a bounded sample of documents; rules then run in the order of
rejections per second (each rule judged on what the rules before it leave), and a rule only sees
the documents that no earlier rule rejected. The order never changes the verdict, only the work.

Null text counts as empty and has no words. Empty tables give empty results. Repeated rows and
keys give a row each. Extra columns are ignored. A text with fewer than ``MIN_WORDS`` words, or
with over 30 % of its words in repeated 8-word windows, fails the base test.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, keep_rows, text_slices
from codelattice.llm.text_features import TextCounts

MIN_WORDS, REPEAT_PERCENT = 20, 30
#: Documents that costs and selectivities are estimated on.
SAMPLE = 512

UPPER, LOWER = list(range(65, 91)), list(range(97, 123))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _shouting(c: TextCounts) -> np.ndarray:
    up, low = c.byte_counts()[:, UPPER].sum(1), c.byte_counts()[:, LOWER].sum(1)
    return (up + low >= 20) & (_share(up, up + low) > 0.5)


def _dup_lines(c: TextCounts) -> np.ndarray:
    filled, same = c.lines()
    return (filled >= 4) & (_share(same, filled) > 0.4)


def _few_distinct(c: TextCounts) -> np.ndarray:
    return (c.n_words >= 50) & (c.distinct_words() < 2 * np.sqrt(c.n_words) / 1.5)


def _word_length(c: TextCounts) -> np.ndarray:
    mean = _share(c.word_chars, c.n_words)
    return (c.n_words > 0) & ((mean < 2) | (mean > 25))


def _no_letters(c: TextCounts) -> np.ndarray:
    counts = c.byte_counts()
    letters = counts[:, UPPER].sum(1) + counts[:, LOWER].sum(1) + counts[:, 0xC3:].sum(1)
    return (c.word_chars > 0) & (_share(letters, c.word_chars) < 0.5)


#: Rules by name; each takes the counts of a slice and returns what it rejects.
RULES: dict[str, Callable[[TextCounts], np.ndarray]] = {
    "symbol_share": lambda c: c.symbols() > 0.05 * c.word_chars,
    "shouting": _shouting,
    "exclamations": lambda c: _share(c.byte_counts()[:, ord("!")], c.n_words) > 0.5,
    "duplicate_lines": _dup_lines,
    "few_distinct_words": _few_distinct,
    "word_length": _word_length,
    "no_letters": _no_letters,
    "control_bytes": lambda c: c.byte_counts()[:, [*range(0, 9), *range(14, 32), 127]].sum(1) > 0.01 * np.maximum(c.word_chars, 1),
}


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> list[tuple[str, float, list[bool]]]:
    """Per rule: seconds on the sample and which sampled documents it rejects."""
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(8)) == 0).select(F.col(text).cast("string").alias(text)).limit(sample).coalesce(1)

    def run(batches):
        spent, rejects = dict.fromkeys(RULES, 0.0), {name: [] for name in RULES}
        for batch in text_slices(batches, text):
            for name, rule in RULES.items():
                counts = TextCounts(batch.column(text))
                began = time.perf_counter()
                rejects[name] += rule(counts).tolist()
                spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array(list(spent.values())), pa.array(list(rejects.values()), pa.list_(pa.bool_()))], names=["rule", "seconds", "rejects"])

    return [(r["rule"], r["seconds"], r["rejects"]) for r in some.mapInArrow(run, "rule string, seconds double, rejects array<boolean>").collect()]


def plan(measured: list[tuple[str, float, list[bool]]]) -> list[str]:
    """Greedy order by rejections per second among what is still there; rules without any come by cost."""
    left = {name: (max(seconds, 1e-9), np.array(rejects, bool)) for name, seconds, rejects in measured}
    order: list[str] = []
    gone = np.zeros(max((len(r) for _, r in left.values()), default=0), bool)
    while left:
        best = max(left, key=lambda k: ((left[k][1] & ~gone).sum() / left[k][0], -left[k][0], k))
        gone |= left.pop(best)[1]
        order.append(best)
    return order + [r for r in RULES if r not in order]


def verdict(c: TextCounts, order: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in repeated windows, base test failed, kept) of a slice; a rule sees only what is still kept."""
    repeats = c.repeats()
    failed = (c.n_words < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * c.n_words)
    kept = ~failed
    for name in order:
        rows = np.flatnonzero(kept)
        if not len(rows):
            break
        kept[rows[RULES[name](c.at(rows))]] = False
    return repeats, failed, kept


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every whole text."""
    order = order or plan(measure(docs, text, key))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([(key, pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(batches):
        for batch in text_slices(batches, text):
            c = TextCounts(batch.column(text))
            repeats, failed, kept = verdict(c, order)
            yield batch_of(schema, **{key: batch.column(key)}, n_words=c.n_words, word_chars=c.word_chars, n_symbols=c.symbols(), n_dup_lines=c.lines()[1], n_repeat_words=repeats, base_failed=failed, kept=kept)

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean")


def reject(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base test and all rules, all columns unchanged."""
    order = plan(measure(docs, text, key))
    return keep_rows(docs, text, lambda texts: verdict(TextCounts(texts), order)[2])
