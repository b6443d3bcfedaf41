"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as classes: insult (words and word beginnings learned from labelled texts, each
with a log-odds weight), seed insult, threat, target, negation, reported speech, other.
Four small transducers rewrite the class stream and are composed into one table:

- negation: an insult or threat up to three words after a negation is cancelled,
- reported speech: one after a verb of saying in the clause is cancelled,
- target: a seed insult counts only with a target in its clause; a learned insult counts by itself,
  as labels speak for it, and more after a target,
- threat: a threat word counts only with a target after it.

A clause ends at ``. , ; : ! ?`` (a verb of saying goes on over ``, :``); its score is the weight of
its path, and it is a match only if something is left of it. A document's score is the
logistic of a calibration over its matched clauses (how many, the sum, the strongest), fitted on
the same bounded sample of labelled rows.

Null text counts as empty and gets the score of a text without a match. Rows without a label never
train; without labels the seed list and fixed calibration stand. Empty tables give empty results.
Repeated rows and keys give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, bounded_sample, fold, keep_rows, staged, text_slices, words_of
from codelattice.llm.pairwise_quality import logistic

#: Labelled rows the lexicon and the calibration are fitted on; entries of the lexicon.
SAMPLE, LEXICON = 20_000, 4_000
#: A learned entry occurs in so many toxic texts at least (and in so large a share of them), so many
#: times as often as in others, with at least this log-likelihood ratio against chance.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO, LEAST_SURPRISE = 3, 0.005, 20.0, 28.0
PREFIXES = range(4, 8)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SEED = KINDS = range(7)
HITS = (INSULT, THREAT, SEED)
SEEDS = {
    INSULT: "idiot moron stupid loser scum pathetic worthless disgusting trash idiota imbécile dummkopf abschaum",
    THREAT: "kill hurt destroy punch stab töten verletzen matar tuer frapper",
    TARGET: "you your he she him her they them du dich euch dein sie ihr tu toi vous ton usted ustedes tú ellos il elle ils",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais sans nunca sin ni",
    REPORT: "said says say called wrote writes claimed reported quoted according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según",
}
SEED_CLASSES = {word: kind for kind, words in SEEDS.items() for word in words.split()}
EDGES = re.compile(r"^[^\w]+|[^\w]+$")
CLAUSE_END, REPORT_END = tuple(".,;:!?"), tuple(".;!?")

# ------------------------------------------------------------ transducers


def _negation() -> tuple[int, dict]:
    """States count the words for which a negation still holds; insults and threats under it are dropped."""
    arcs = {}
    for left, kind in itertools.product(range(4), KINDS):
        arcs[left, kind] = (3 if kind == NEGATION else max(left - 1, 0), OTHER if kind in HITS and left else kind, 0.0)
    return 0, arcs


def _report() -> tuple[int, dict]:
    arcs = {(s, k): (1 if k == REPORT else s, OTHER if s and k in HITS else k, 0.0) for s in (0, 1) for k in KINDS}
    return 0, arcs


def _target() -> tuple[int, dict]:
    """After a target insults gain weight and seed insults count; before one a seed insult waits for it (state 2)."""
    arcs = {(s, k): (1 if k == TARGET else s, k, math.log(1.5) if s == 1 and k == INSULT else 0.0) for s in range(3) for k in KINDS}
    arcs |= {(0, SEED): (2, OTHER, 0.0), (1, SEED): (1, INSULT, math.log(1.5)), (2, SEED): (2, OTHER, 0.0), (2, TARGET): (1, INSULT, 0.0)}
    return 0, arcs


def _threat() -> tuple[int, dict]:
    """A threat word waits; the next target makes it count, as a match of its own class."""
    arcs = {}
    for s, k in itertools.product((0, 1), KINDS):
        if s and k == TARGET:
            arcs[s, k] = (0, THREAT, 0.0)
        else:
            arcs[s, k] = (1 if k == THREAT else s, OTHER if k == THREAT else k, 0.0)
    return 0, arcs


def compose(machines: list[tuple[int, dict]]) -> tuple[dict, dict]:
    """One machine that feeds each machine's output to the next: (state, class) -> (state, class, log weight)."""
    start = tuple(m[0] for m in machines)
    numbers, arcs, open_states = {start: 0}, {}, [start]
    while open_states:
        state = open_states.pop()
        for kind in KINDS:
            out, weight, following = kind, 0.0, []
            for part, (_, own) in zip(state, machines, strict=True):
                after, out, gain = own[part, out]
                following.append(after)
                weight += gain
            to = tuple(following)
            if to not in numbers:
                numbers[to] = len(numbers)
                open_states.append(to)
            arcs[numbers[state], kind] = (numbers[to], out, weight)
    return numbers, arcs


GRAMMAR = compose([_negation(), _report(), _target(), _threat()])[1]
#: What one fulfilled threat and one seed insult with its target weigh beside learned insults.
THREAT_WEIGHT, SEED_WEIGHT = 3.0, 2.0


def clause_score(kinds: list[int], weights: list[float]) -> float:
    """Weight of a clause's path through the composed machine; 0 if nothing matches."""
    state, total = 0, 0.0
    for kind, weight in zip(kinds, weights, strict=True):
        state, out, gain = GRAMMAR[state, kind]
        if out == INSULT:
            total += (SEED_WEIGHT if kind == TARGET else weight) * math.exp(gain)
        elif out == THREAT:
            total += THREAT_WEIGHT * math.exp(gain)
    return total


class Lexicon:
    """Classes and weights of words: exact words first, then learned word beginnings."""

    def __init__(self, learned: dict[str, float]):
        self.words = {t: w for t, w in learned.items() if not t.endswith("*")}
        self.prefixes = {t[:-1]: w for t, w in learned.items() if t.endswith("*")}
        self.sizes = sorted({len(p) for p in self.prefixes})

    def look(self, word: str) -> tuple[int, float, bool]:
        """(class, weight, whether a clause ends here) of one raw word."""
        ends = word.endswith(CLAUSE_END)
        bare = EDGES.sub("", word).lower()
        if bare in self.words:
            return INSULT, self.words[bare], ends
        for size in self.sizes:
            if (weight := self.prefixes.get(bare[:size])) is not None and len(bare) >= size:
                return INSULT, weight, ends
        kind = SEED_CLASSES.get(bare, OTHER)
        if kind == INSULT:
            return SEED, SEED_WEIGHT, ends
        return kind, 0.0, word.endswith(REPORT_END) if kind == REPORT else ends


def match(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: matched clauses, sum of clause scores, strongest clause, words."""
    flat, counts = words_of(texts, lower=False)
    out = np.zeros((len(counts), 4))
    out[:, 3] = counts
    coded = flat.dictionary_encode()
    known = [lexicon.look(w) for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False)
    if not len(index):
        return out
    kinds = np.array([k[0] for k in known], np.int8)[index]
    weights = np.array([k[1] for k in known])[index]
    ends = np.array([k[2] for k in known], bool)[index]
    ends[np.cumsum(counts)[counts > 0] - 1] = True
    hit = np.flatnonzero(np.isin(kinds, HITS))
    stops = np.flatnonzero(ends)
    owner = np.searchsorted(np.cumsum(counts), np.arange(len(index))[hit], side="right")
    clause = np.searchsorted(stops, hit)
    seen = -1
    for c, doc in zip(clause.tolist(), owner.tolist(), strict=True):
        if c == seen:
            continue
        seen = c
        a, b = (int(stops[c - 1]) + 1 if c else 0), int(stops[c]) + 1
        value = clause_score(kinds[a:b].tolist(), weights[a:b].tolist())
        if value > 0:
            out[doc, 0] += 1
            out[doc, 1] += value
            out[doc, 2] = max(out[doc, 2], value)
    return out


# ------------------------------------------------------------ learning


def _terms(text: str) -> set[str]:
    """Distinct lower-case words of a text and their beginnings (marked by a star)."""
    words = {EDGES.sub("", w).lower() for w in text.split()}
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, text: str = "text") -> dict[str, float]:
    """Terms that mark toxic texts: log-odds of holding the term, toxic against clean.

    ``sample`` has distinct texts with a label. Counts of candidate terms only: those of enough toxic texts.
    """
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * n_toxic))

    def count(wanted: set[str] | None):
        def run(batches):
            totals: dict[str, int] = {}
            for batch in text_slices(batches, text):
                for t in batch.column(text).to_pylist():
                    own = _terms(t)
                    for term in own if wanted is None else own & wanted:
                        totals[term] = totals.get(term, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["term", "c"])
        return run

    def counted(label: int, wanted: set[str] | None, at_least: int) -> dict[str, int]:
        rows = sample.where(F.col("label") == label).select(F.col(text)).mapInArrow(count(wanted), "term string, c long")
        totals = rows.groupBy("term").agg(F.sum("c").alias("c")).where((F.col("c") >= at_least) & (F.col("term") != ""))
        return {r["term"]: r["c"] for r in totals.orderBy(F.desc("c"), "term").limit(50 * LEXICON).collect()}

    toxic = counted(1, None, least)
    clean = counted(0, set(toxic), 1)
    odds = {}
    for term, c in toxic.items():
        ratio = ((c + 0.5) / (n_toxic + 1)) / ((clean.get(term, 0) + 0.5) / (n_clean + 1))
        both = c + clean.get(term, 0)
        expected = both * n_toxic / (n_toxic + n_clean), both * n_clean / (n_toxic + n_clean)
        surprise = 2 * (c * math.log(c / expected[0]) + (clean.get(term, 0) * math.log(clean[term] / expected[1]) if clean.get(term) else 0.0))
        if ratio >= LEAST_RATIO and surprise >= LEAST_SURPRISE:
            odds[term] = (c * math.log(ratio), math.log(ratio))
    best = dict(sorted(odds.items(), key=lambda x: (-x[1][0], x[0]))[:LEXICON])
    # A shorter beginning that stands covers the longer terms under it.
    starts = {t[:-1] for t in best if t.endswith("*")}
    return {t: w for t, (_, w) in best.items() if not any(t.rstrip("*")[:n] in starts and n < len(t.rstrip("*")) for n in PREFIXES)}


def calibration_rows(found: np.ndarray) -> np.ndarray:
    clauses, total, strongest, words = found.T
    return np.column_stack([np.ones(len(found)), clauses > 0, np.log1p(clauses), np.log1p(total), strongest / 4, np.log1p(100 * clauses / np.maximum(words, 1))])


DEFAULT_CALIBRATION = np.array([-4.0, 2.0, 1.5, 0.5, 0.5, 0.0])


def calibrate(found: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression of the label on the clause figures; the fixed one without both labels."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return DEFAULT_CALIBRATION
    x = calibration_rows(found)
    w = np.zeros(x.shape[1])
    rate = np.clip(toxic.mean(), 1e-4, 1 - 1e-4)
    w[0] = math.log(rate / (1 - rate))
    for _ in range(50):
        p = logistic(x @ w)
        hold = np.array([0.0] + [ridge] * (len(w) - 1))
        slope = x.T @ (p - toxic) + hold * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-6)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and calibration from at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.select(F.col(key).cast("long").alias(key), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (fold(key, modulus) != remainder))
    known = bounded_sample(known.dropDuplicates([key]), key, sample)
    texts = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull())
    rows = staged(texts.join(F.broadcast(known), key), "toxic_sample")
    distinct = rows.dropDuplicates([text, "label"])
    counts = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = learn_lexicon(distinct, counts.get(1, 0), counts.get(0, 0), text) if counts.get(1) and counts.get(0) else {}
    lexicon = Lexicon(learned)
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in text_slices(batches, text):
            yield batch_of(schema, label=batch.column("label"), x=list(match(batch.column(text), lexicon)))

    found = rows.select("label", text).mapInArrow(run, "label int, x array<double>").limit(2 * sample).toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, 4)
    return learned, calibrate(x, found["label"].to_numpy(np.float64))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted, clauses) of every document."""
    learned, weights = learn(docs, labels, modulus, remainder, sample, key, text)
    lexicon = Lexicon(learned)
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64()), ("clauses", pa.int64())])

    def run(batches):
        for batch in text_slices(batches, text):
            found = match(batch.column(text), lexicon)
            yield batch_of(schema, **{key: batch.column(key)}, score=logistic(calibration_rows(found) @ weights), clauses=found[:, 0].astype(np.int64))

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    out = rows.mapInArrow(run, f"{key} long, score double, clauses long")
    return out.select(key, (F.coalesce(fold(key, modulus), F.lit(-1)) == remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")


def reject(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged."""
    learned, weights = learn(docs, labels, modulus, remainder, sample, key, text)
    lexicon = Lexicon(learned)
    return keep_rows(docs, text, lambda texts: logistic(calibration_rows(match(texts, lexicon)) @ weights) < threshold)
