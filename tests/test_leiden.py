"""Communities by modularity on small graphs with known answers."""

import random

from codelattice.operators import leiden


def pairs(spark, links):
    return spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in links], "a string, b string, w double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["label"], set()).add(r["node"])
    assert all(label == min(members) for label, members in out.items())
    return sorted(map(sorted, out.values()))


def clique(prefix, n):
    names = [f"{prefix}{i}" for i in range(n)]
    return [(a, b, 1.0) for i, a in enumerate(names) for b in names[:i]]


def value(links, labels):
    """Modularity of a labelling, from its definition."""
    total, inner, degree = sum(w for *_, w in links), 0.0, {}
    for a, b, w in links:
        inner += w * (labels[a] == labels[b])
        for x in (a, b):
            degree[labels[x]] = degree.get(labels[x], 0.0) + w
    return inner / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def test_ring_of_cliques(spark):
    links = [link for i in range(4) for link in clique(f"c{i}_", 4)]
    links += [(f"c{i}_0", f"c{(i + 1) % 4}_1", 0.3) for i in range(4)]
    found = groups(leiden.communities(pairs(spark, links)))
    assert found == [[f"c{i}_{j}" for j in range(4)] for i in range(4)]


def test_long_chain_is_not_cut_short(spark):
    """A chain, where the moves of a half disturb each other; no move of one node, nor of two whole communities, is left that gains."""
    links = [(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(13)]
    labels = {r["node"]: r["label"] for r in leiden.communities(pairs(spark, links)).collect()}
    best = value(links, labels)
    assert best > 0.45
    near = {(labels[a], labels[b]) for a, b, _ in links if labels[a] != labels[b]}
    assert all(value(links, {k: a if v == b else v for k, v in labels.items()}) <= best + 1e-12 for a, b in near)


def test_hub_and_nothing(spark):
    star = [("hub", f"leaf{i:02d}", 1.0) for i in range(12)]
    assert groups(leiden.communities(pairs(spark, star))) == [sorted({"hub", *[b for _, b, _ in star]})]
    assert leiden.communities(pairs(spark, [])).count() == 0


def test_half_of_a_name_is_stable(spark):
    random.seed(1)
    names = [(f"n{random.random()}",) for _ in range(200)]
    halves = [r[0] for r in spark.createDataFrame(names, "node string").select(leiden.half_of("node")).collect()]
    assert set(halves) == {0, 1} and 60 < sum(halves) < 140


def test_a_round_stores_one_table(spark, monkeypatch):
    """A kept round is one stored table, a round whose moves disturb each other two, a round without moves none."""
    made, moves = [], []
    store, after = leiden.stage, leiden._Measured._after
    monkeypatch.setattr(leiden, "stage", lambda df, name, *more: made.append(name) or store(df, name, *more))
    monkeypatch.setattr(leiden._Measured, "_after", staticmethod(lambda *rows: moves.append(1) or after(*rows)))
    links = [(f"n{i:02d}", f"n{i + 1:02d}", 1.0) for i in range(13)]
    assert leiden.communities(pairs(spark, links)).count() == 14
    starts = 2 * made.count("start") + 2
    assert "near" not in made and made.count("labels") == len(moves) + starts
