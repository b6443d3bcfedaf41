"""Walks on random graphs against plain breadth-first search."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.model import CodeGraph
from codelattice.operators import communities as C
from codelattice.operators import flows as FL
from codelattice.operators import relations as R
from codelattice.operators import traversal as T


def random_graph(spark, seed, n=40, m=90):
    rng = random.Random(seed)
    names = [f"f{i % 6}.py::n{i}" for i in range(n)]
    nodes = [("Function", q.split("::")[1], q, q.split("::")[0], i + 1, i + 3, "python", None, None, None, False, None, None)
             for i, q in enumerate(names)]
    ends = names + [f"outside{i}" for i in range(5)]
    edges = sorted({(rng.choice(["CALLS", "CALLS", "IMPORTS_FROM"]), rng.choice(names), rng.choice(ends), "f0.py", rng.randint(1, 50))
                    for _ in range(m)})
    g = CodeGraph(spark.createDataFrame(nodes, S.NODE_SCHEMA), spark.createDataFrame(edges, S.EDGE_SCHEMA))
    return g, names, edges


def bfs(seeds, pairs, depth):
    near = dict.fromkeys(seeds, 0)
    queue = deque(seeds)
    while queue:
        q = queue.popleft()
        if near[q] == depth:
            continue
        for a, b in pairs:
            if a == q and b not in near:
                near[b] = near[q] + 1
                queue.append(b)
    return near


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("depth", [1, 2, 5])
def test_reach(spark, seed, depth):
    g, names, edges = random_graph(spark, seed)
    pairs = {(s, t) for _, s, t, _, _ in edges} | {(t, s) for _, s, t, _, _ in edges}
    seeds = names[:2]
    got = {r[0]: r[1] for r in T.reach(spark.createDataFrame([(q,) for q in seeds], "qualified_name string"), T.both_ways(g.edges), depth).collect()}
    assert got == bfs(seeds, sorted(pairs), depth)


@pytest.mark.parametrize("seed", [4, 5])
def test_flow_order_and_paths(spark, seed):
    """Positions equal the visit order of a queue that takes edges by (line, target)."""
    g, names, edges = random_graph(spark, seed)
    calls = {}
    for kind, s, t, _, line in edges:
        if kind == "CALLS" and t in names:
            calls.setdefault(s, []).append((line, t))
    called = {t for k, _, t, _, _ in edges if k == "CALLS"}
    want, chains = {}, {}
    for root in names:
        if root in called:
            continue
        seen, queue = [root], deque([(root, 0)])
        while queue:
            q, d = queue.popleft()
            if d >= 15:
                continue
            for _, t in sorted(calls.get(q, [])):
                if t not in seen:
                    seen.append(t)
                    queue.append((t, d + 1))
                    chains[root, t] = [*chains.get((root, q), [root]), t]
        if len(seen) > 1:
            want[root] = seen
    members = FL.trace_flows(g)
    rows = FL.with_positions(members).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["root"], r["position"])):
        assert r["position"] == len(got.setdefault(r["root"], []))
        got[r["root"]].append(r["node"])
    assert got == want
    found = {(r["root"], r["node"]): r["path"] for r in T.paths(members).collect() if r["depth"]}
    assert found == chains
    some = dict(sorted(chains.items())[::3])
    asked = spark.createDataFrame(list(some), "root string, node string")
    assert {(r["root"], r["node"]): r["path"] for r in T.paths(members, asked).collect()} == some


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_refreshed_flows_equal_a_full_walk(spark, seed):
    """A change adds and removes symbols and calls; untouched flows are not walked again."""
    before, names, edges = random_graph(spark, seed, n=60, m=80)
    rng = random.Random(seed + 100)
    kept_names = [q for q in names if not (q.startswith("f1.py") and rng.random() < 0.4)]
    new_names = [f"f1.py::new{i}" for i in range(4)]
    nodes = [("Function", q.split("::")[1], q, q.split("::")[0], 1, 3, "python", None, None, None, False, None, None)
             for q in kept_names + new_names]
    # Callers name symbols that do not exist yet, the changed file calls others than before.
    early = [("CALLS", rng.choice([q for q in names if "f1.py" not in q]), q, "f0.py", 7) for q in new_names]
    rest = [e for e in edges if not e[1].startswith("f1.py")]
    fresh = sorted({("CALLS", rng.choice(new_names + [q for q in kept_names if "f1.py" in q]), rng.choice(names), "f1.py", rng.randint(1, 50))
                    for _ in range(12)})
    old = CodeGraph(before.nodes, spark.createDataFrame(edges + early, S.EDGE_SCHEMA))
    new = CodeGraph(spark.createDataFrame(nodes, S.NODE_SCHEMA), spark.createDataFrame(rest + early + fresh, S.EDGE_SCHEMA))
    members = FL.trace_flows(old)
    changed = spark.createDataFrame([("f1.py",)], "file_path string")
    key = lambda df: sorted((r["root"], r["node"], r["depth"], r["position"]) for r in FL.with_positions(df).collect())
    full = key(FL.trace_flows(new))
    assert key(FL.refresh_flows(new, members, changed)) == full
    assert full != key(members)


def test_hub_links_lie_in_several_buckets(spark):
    """Half of all calls leave one node: its links are dealt out, the walk is the same."""
    calls = [("hub", f"n{i}", i) for i in range(300)] + [(f"n{i}", f"n{(i * 7 + 1) % 300}", 5) for i in range(300)]
    rows = spark.createDataFrame(calls, "source string, target string, line int")
    links = T.StagedLinks(rows, "test", hub_links=50)
    assert links.rows.count() == 600
    buckets = links.rows.where("source = 'hub'").select(F.input_file_name()).distinct().count()
    assert buckets > 1
    one = spark.createDataFrame([("hub",), ("n3",), ("none",)], "node string")
    assert links.follow(one, "node").count() == 301
    assert "Exchange hashpartitioning(source" not in links.rows.groupBy("source", "salt").count()._jdf.queryExecution().toString()
    links.drop()
    roots = spark.createDataFrame([("hub",), ("n1",)], "root string")
    plain, dealt = T.trace(roots, rows, 5), T.trace(roots, rows, 5, hub_links=50)
    key = lambda df: sorted((r["root"], r["position"], r["node"], r["depth"]) for r in FL.with_positions(df).collect())
    assert key(plain) == key(dealt) and len(key(dealt)) > 301
    seeds = spark.createDataFrame([("n5",)], "qualified_name string")
    both = lambda df: sorted(map(tuple, df.collect()))
    assert both(T.reach(seeds, rows, 4)) == both(T.reach(seeds, rows, 4, hub_links=50))


def test_call_path_is_the_first_of_the_shortest(spark):
    g, names, edges = random_graph(spark, 9, n=50, m=160)
    calls = sorted({(s, t) for k, s, t, _, _ in edges if k == "CALLS"})
    for start, goal in [(names[0], names[7]), (names[3], names[21]), (names[5], "outside2")]:
        chains, seen, want = [[start]], {start}, None
        for _ in range(8):
            found = {}
            for c in chains:
                for s, t in calls:
                    if (start.lower() in s.lower() if len(c) == 1 else s == c[-1]) and t not in seen:
                        found[t] = min(found.get(t, [*c, t]), [*c, t])
            chains, seen = list(found.values()), seen | set(found)
            hits = [c for c in chains if goal in c[-1]]
            if hits:
                want = min(hits)
                break
        got = T.call_path(g, start, goal).collect()
        assert [(r["path"], r["hops"]) for r in got] == ([(want, len(want) - 1)] if want else [])


def test_empty_and_missing(spark):
    g, _, _ = random_graph(spark, 6)
    none = g.nodes.select("file_path").limit(0)
    assert T.impact_radius(g, none).count() == 0
    assert T.call_path(g, "nowhere", "n1").count() == 0
    assert T.neighborhood(g, "NOWHERE").count() == 0


def test_shown_nodes_are_the_nearest_of_all(spark):
    g, names, edges = random_graph(spark, 7, n=60, m=150)
    files = g.nodes.select("file_path").where("file_path = 'f0.py'")
    whole = T.impact_radius(g, files, 6)
    every = sorted((r["depth"], r["qualified_name"]) for r in whole.where("depth > 0").collect())
    shown = T.impact_radius(g, files, 6, 15).collect()
    assert sorted((r["depth"], r["qualified_name"]) for r in shown if r["depth"]) == every[:15]
    assert all(r["total_impacted"] == len(every) and r["truncated"] == (len(every) > 15) for r in shown)
    assert "truncated" not in whole.columns


def test_hub_holds_a_third_of_the_edges(spark):
    """A hub called from everywhere: results stay whole."""
    names = [f"m{i}.py::f{i}" for i in range(300)]
    nodes = [("Function", q.split("::")[1], q, q.split("::")[0], 1, 2, "python", None, None, None, False, None, None) for q in names]
    edges = [("CALLS", q, names[0], q.split("::")[0], 1) for q in names[1:]]
    edges += [("CALLS", names[i], names[(i * 7 + 1) % 300], f"m{i}.py", 2) for i in range(1, 300)]
    edges = [e for e in edges if e[1] != e[2]]
    g = CodeGraph(spark.createDataFrame(nodes, S.NODE_SCHEMA), spark.createDataFrame(edges, S.EDGE_SCHEMA))
    assert R.callers_of(g, g.nodes.where(F.col("qualified_name") == names[0])).select("source").distinct().count() == 299
    near = T.impact_radius(g, g.nodes.where("file_path = 'm0.py'").select("file_path"), 1, None)
    assert near.where("role = 'impacted'").count() == 299
    assert T.neighborhood(g, names[0], 1, fan=100).count() == 100
    assert T.neighborhood(g, names[0], 1).count() == g.edges.where(F.col("source").isin(names[0]) | F.col("target").isin(names[0])).count()


def test_label_propagation_separates_cliques(spark):
    pairs = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 0.3)]
    labels = {r["node"]: r["label"] for r in C.propagate_labels(spark.createDataFrame(pairs, "a string, b string, w double")).collect()}
    assert {labels[f"a{i}"] for i in range(5)} == {"a0"}
    assert {labels[f"b{i}"] for i in range(5)} == {"b0"}


def test_reach_by_recursion_has_no_row_limit(spark):
    """A hub met over many ways: more rows of a recursion than its limit, few names."""
    g, names, _ = random_graph(spark, 7)
    edges = [("CALLS", names[i], names[j], "f0.py", 1) for i in range(20) for j in range(20, 40)]
    g = CodeGraph(g.nodes, spark.createDataFrame(edges, S.EDGE_SCHEMA))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        got = {r[0]: r[1] for r in T.impact_radius_recursive(g, spark.createDataFrame([("f0.py",)], "file_path string")).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    pairs = {(s, t) for _, s, t, _, _ in edges} | {(t, s) for _, s, t, _, _ in edges}
    assert got == bfs([q for q in names if q.startswith("f0.py")], sorted(pairs), 2)


def test_reach_returns_wanted_names_with_their_columns(spark):
    g, names, edges = random_graph(spark, 8)
    seeds = spark.createDataFrame([(names[0],)], "qualified_name string")
    want = spark.createDataFrame([(q, i) for i, q in enumerate(names)], "qualified_name string, i int")
    for depth in (2, 4):
        got = {(r["qualified_name"], r["i"], r["depth"]) for r in T.reach(seeds, T.both_ways(g.edges), depth, names=want).collect()}
        whole = {r["qualified_name"]: r["depth"] for r in T.reach(seeds, T.both_ways(g.edges), depth).collect()}
        assert got == {(q, i, whole[q]) for i, q in enumerate(names) if q in whole}
        frontier = T.reach(seeds, T.both_ways(g.edges), depth, names=want)
        assert "node#" in frontier._jdf.queryExecution().optimizedPlan().toString()  # digests, not texts, meet the levels


def test_label_rounds_carry_numbers_not_names(spark, monkeypatch):
    """The table of votes has no text; numbers follow the names, so ties still take the smallest name."""
    kept = []
    bucketed = C.stage_bucketed
    monkeypatch.setattr(C, "stage_bucketed", lambda df, *more: kept.append(df.dtypes) or bucketed(df, *more))
    pairs = spark.createDataFrame([("b", "c", 1.0), ("c", "d", 1.0), ("b", "d", 1.0), ("a10", "a9", 0.5)], "a string, b string, w double")
    got = {r["node"]: r["label"] for r in C.propagate_labels(pairs).collect()}
    assert got == {"b": "b", "c": "b", "d": "b", "a10": "a10", "a9": "a10"}
    assert kept and all(kind != "string" for _, kind in kept[0])
