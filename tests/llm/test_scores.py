"""Toxicity, language model, quality ranking, rule cascade."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from codelattice.llm import interpolated_lm, pairwise_quality, rule_cascade, toxicity
from codelattice.llm.text_features import repeated_words
from helpers import odd_rows, prose, table, words


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- toxicity

def test_grammar_weighs_contexts():
    t = toxicity
    plain = t.clause_score([t.OTHER, t.INSULT], [0, 2.0])
    assert plain == 2.0
    assert t.clause_score([t.NEGATION, t.OTHER, t.INSULT], [0, 0, 2.0]) < plain
    assert t.clause_score([t.NEGATION, *[t.OTHER] * 4, t.INSULT], [0] * 5 + [2.0]) == plain
    assert t.clause_score([t.REPORT, t.OTHER, t.INSULT], [0, 0, 2.0]) < plain
    assert t.clause_score([t.TARGET, t.INSULT], [0, 2.0]) > plain
    assert t.clause_score([t.THREAT], [0]) == 0 and t.clause_score([t.THREAT, t.TARGET], [0, 0]) == t.THREAT_WEIGHT
    assert t.clause_score([t.OTHER, t.TARGET, t.NEGATION], [0, 0, 0]) == 0


def test_composed_machine_equals_the_chain():
    machines = [toxicity._negation(), toxicity._report(), toxicity._target(), toxicity._threat()]
    random.seed(1)
    for _ in range(200):
        kinds = [random.randrange(6) for _ in range(12)]
        states, state = [m[0] for m in machines], 0
        for kind in kinds:
            out, weight = kind, 0.0
            for i, (_, arcs) in enumerate(machines):
                states[i], out, gain = arcs[states[i], out]
                weight += gain
            state, got, total = toxicity.GRAMMAR[state, kind]
            assert got == out and math.isclose(total, weight, abs_tol=1e-12)


def test_toxicity_learns_words_and_beginnings(spark):
    random.seed(2)
    rows, labels = [], []
    for i, text in enumerate(prose(400)):
        bad = i % 8 == 0
        if bad:
            w = text.split()
            for marker in random.sample(["grumbold", "snarkle", "vexorin" + random.choice("abc")], 2):
                w.insert(random.randrange(len(w)), marker)
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, 1, int(bad)))
    docs, known = table(spark, [*rows, (900, None), (901, ""), (None, "x")]), labelled(spark, [*labels, (None, None, 1), (902, 1, None)])
    got = {r["doc_id"]: r for r in toxicity.score(docs, known).collect()}
    assert len(got) == 403 and got[900]["predicted"] == 0 and got[901]["score"] == got[900]["score"]
    for i, _, bad in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["predicted"] == bad
    kept = toxicity.reject(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def test_toxicity_without_labels(spark):
    docs = table(spark, [(1, "you idiot moron"), (2, "fine"), (3, None)])
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labelled(spark, [])).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert toxicity.score(table(spark, []), labelled(spark, [])).count() == 0


def test_toxicity_needs_an_accepted_clause(spark):
    clean = [
        "he is not an idiot", "du bist kein idiot und das weiss jeder", "they are never stupid or pathetic", "she said you are an idiot", 'he wrote: "you are worthless scum"',
        "a stupid mistake in the trash can", "what a pathetic little film", "i will not kill you", "the report said they will hurt him", "this could kill a plant",
        "nobody said anything. the weather is fine",
    ]
    toxic = ["you are an idiot", "what an idiot you are", "i will kill you", "he said it is late. you are stupid", "not today, you moron"]
    texts = clean + toxic + [" ".join(clean)]
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, list(enumerate(texts))), labelled(spark, [])).collect()}
    for i, text in enumerate(texts):
        bad = text in toxic
        assert (got[i]["predicted"], got[i]["clauses"]) == (int(bad), int(bad)), text


def test_learned_words_are_cancelled_too():
    lexicon = toxicity.Lexicon({"grumbold": 4.0})
    found = toxicity.match(pa.array(["a grumbold here", "not a grumbold", "he said grumbold", "not a grumbold. a grumbold"]), lexicon)
    assert found[:, 0].tolist() == [1, 0, 0, 1] and found[:, 1].tolist() == [4, 0, 0, 4]
    rows = toxicity.calibration_rows(found[1:3])
    assert (rows[:, 1:] == 0).all()


# ---------------------------------------------------------------- language model

def brute_lm(rows):
    tokens = [(k, [*words(t, True), b""], zlib.crc32(str(k).encode()) % 7 == 2 if k is not None else False) for k, t in rows]
    counts = Counter(w for _, ws, held in tokens if not held for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return [(str(k), held, len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) for k, ws, held in tokens]


def test_language_model_base_figures(spark, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "CHUNK_BYTES", 2_000)
    rows = [*odd_rows(), *[(100 + i, t) for i, t in enumerate(prose(150))]]
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in interpolated_lm.score(table(spark, rows)).collect())
    assert got == sorted((*w[:5], round(w[5], 6)) for w in brute_lm(rows))


def test_language_model_scores(spark, monkeypatch):
    """Scores equal a direct mixture of the same weights, and predict unseen texts better than the base."""
    monkeypatch.setattr(interpolated_lm, "CHUNK_BYTES", 5_000)
    seen = {}
    learn = interpolated_lm.learn_weights
    monkeypatch.setattr(interpolated_lm, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    rows = list(enumerate(prose(200)))
    got = {r["doc_id"]: r for r in interpolated_lm.score(table(spark, rows)).collect()}
    uni, bi, context = Counter(), Counter(), Counter()
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            ws = [None, *words(t, True), b""]
            uni.update(ws[1:])
            bi.update(zip(ws, ws[1:], strict=False))
            context.update(ws[:-1])
    total, distinct = sum(uni.values()), len(uni)
    for k, t in rows[:60]:
        ws, score = [None, *words(t, True), b""], 0.0
        for a, b in zip(ws, ws[1:], strict=False):
            w = seen["w"][int(math.log2(context[a])) + 1 if context[a] else 0]
            score += math.log10(w[0] / (distinct + 1) + w[1] * uni[b] / total + (w[2] * bi[a, b] / context[a] if context[a] else 0))
        assert math.isclose(score, got[k]["score"], rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert interpolated_lm.score(table(spark, [])).count() == 0


def test_weights_maximise_held_out_likelihood():
    histogram = pd.DataFrame({"bucket": [3, 3, 3], "q1": [40, 0, interpolated_lm.NONE], "q2": [100, interpolated_lm.NONE, interpolated_lm.NONE], "n": [50, 30, 20]})
    w = interpolated_lm.learn_weights(histogram, 2, 500)[3]
    ratio = np.array([[1, math.exp(2), math.exp(5)], [1, 1, 0], [1, 0, 0]])
    value = lambda v: (np.log(ratio @ v) * [50, 30, 20]).sum()
    for other in np.random.default_rng(0).dirichlet([1, 1, 1], 300):
        assert value(w) >= value(other) - 1e-6


def test_packed_numbers_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    assert (interpolated_lm.unpack_sorted(interpolated_lm.pack_sorted(x)) == x).all()
    assert (interpolated_lm.unpack(interpolated_lm.pack(x[:0])) == x[:0]).all()


# ---------------------------------------------------------------- quality

def junk(i, text):
    w = text.split()
    return [" ".join(x + "%%%" for x in w), text.upper().replace(" ", "!! "), " ".join(x for x in w[:8] for _ in range(12)), " | ".join(w)][i % 4]


def test_pairwise_ranking_separates(spark):
    rows, labels = [], []
    for i, text in enumerate(prose(300)):
        bad = i % 5 == 0
        rows.append((i, junk(i // 5, text) if bad else text))
        labels.append((i, int(not bad), 0))
    docs = table(spark, [*rows, (900, None), (901, ""), (None, "a text without a key")])
    got = {r["doc_id"]: r for r in pairwise_quality.score(docs, labelled(spark, [*labels, (None, 1, 0), (903, None, 1)])).collect()}
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got.values())
    wrong = [i for i, good, _ in labels if got[i]["predicted"] != good]
    assert len(wrong) <= 3
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in labels)


def test_pairwise_ranking_without_labels(spark):
    got = pairwise_quality.score(table(spark, [(1, "a b"), (2, None)]), labelled(spark, [(1, 1, 0)])).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]
    assert pairwise_quality.score(table(spark, []), labelled(spark, [])).count() == 0


def test_rule_counts(spark):
    rows = [*odd_rows(), (50, "a b c d e f g h " * 6), (51, "one line\nother\none line\n\n\none line"), *[(60 + i, t) for i, t in enumerate(prose(30))], (200, junk(0, prose(1)[0])), (201, junk(1, prose(1)[0])), (202, junk(2, prose(1)[0]))]
    got = {}
    for r in rule_cascade.judge(table(spark, rows)).collect():
        got.setdefault(str(r["doc_id"]), []).append(tuple(r)[1:])
    for k, t in rows:
        t, ws = t or "", words(t)
        seen, lines, windows, cover = set(), 0, {}, set()
        for line in t.split("\n"):
            if words(line):
                lines += line in seen
                seen.add(line)
        for i in range(len(ws) - 7):
            windows.setdefault(tuple(ws[i : i + 8]), []).append(i)
        for at in windows.values():
            if len(at) > 1:
                cover.update(j for i in at for j in range(i, i + 8))
        want = (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t), lines, len(cover), len(ws) < 20 or 100 * len(cover) > 30 * len(ws))
        assert any(g[:6] == want for g in got[str(k)]), (k, want, got[str(k)])
        assert not any(g[5] and g[6] for g in got[str(k)])
    assert all(got[str(60 + i)][0][6] for i in range(30)) and not any(got[str(i)][0][6] for i in (200, 201, 202))
    assert rule_cascade.judge(table(spark, [])).count() == 0


def test_rule_order_never_changes_the_verdict(spark):
    docs = table(spark, [(i, junk(i, t) if i % 3 else t) for i, t in enumerate(prose(40))])
    names = list(rule_cascade.RULES)
    verdicts = [sorted((r["doc_id"], r["kept"]) for r in rule_cascade.judge(docs, order=o).collect()) for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]
    kept = rule_cascade.reject(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in verdicts[0] if v}


def test_rules_go_by_rejections_per_second():
    order = rule_cascade.plan([("symbol_share", 1.0, [True, True, False, False]), ("shouting", 0.1, [True, False, False, False]), ("exclamations", 0.1, [False, False, False, True])])
    assert order[:3] in (["shouting", "exclamations", "symbol_share"], ["exclamations", "shouting", "symbol_share"])


def test_repeated_words_by_hand():
    codes = np.array([*range(8), *range(8), 9, 9])
    assert repeated_words(codes, np.array([len(codes)])).tolist() == [16]
    assert repeated_words(codes, np.array([8, 10])).tolist() == [0, 0]
    assert repeated_words(np.zeros(9, int), np.array([9, 0])).tolist() == [9, 0]
    assert pa is not None
