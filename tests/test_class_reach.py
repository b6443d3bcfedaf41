"""Classes passed against the calls, against plain search over random graphs."""

import random

import pytest

from codelattice import schema as S
from codelattice.model import CodeGraph
from codelattice.operators import rules as RU
from codelattice.operators.class_reach import class_reach


def searched(calls, targets, guards, max_depth):
    """Least depth to a member of each class, over all ways and over ways without a guard."""
    nodes = {n for c in calls for n in c}
    out = {}
    for key in {k for _, k in targets}:
        for which in ("any", "open"):
            shut = {n for n, k in guards if k == key} if which == "open" else set()
            level, seen, depth = {n for n, k in targets if k == key}, set(), 0
            while level and depth < max_depth:
                depth += 1
                level = {s for s, t in calls if t in level and t not in shut} - seen
                seen |= level
                for n in level:
                    out.setdefault((n, key), {})[which] = depth
    assert all(n in nodes for n, _ in out)
    return {k: (v["any"], v.get("open")) for k, v in out.items()}


@pytest.mark.parametrize("seed, max_depth, hub_links", [(1, None, 10**6), (2, 2, 10**6), (3, None, 5)])
def test_classes_of_random_graphs(spark, seed, max_depth, hub_links):
    """More classes than one word has bits, cycles, guards that are members, a hub that many call."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    calls = [(rng.choice(names), rng.choice(names)) for _ in range(70)] + [(n, "n0") for n in names[1:25]]
    targets = [(rng.choice(names), f"class{i % 70}") for i in range(90)]
    guards = [(rng.choice(names), f"class{rng.randrange(70)}") for _ in range(150)]
    got = class_reach(
        spark.createDataFrame([*calls, *calls[:5], (None, "n1"), ("n1", None)], "source string, target string"),
        spark.createDataFrame([*targets, (None, "class1"), ("n1", None)], "node string, key string"),
        spark.createDataFrame(guards, "node string, key string"), max_depth, hub_links,
    ).collect()
    assert {(r["node"], r["key"]): (r["depth"], r["open_depth"]) for r in got} == searched(
        set(calls), targets, guards, max_depth or 1000)
    assert len(got) == len({(r["node"], r["key"]) for r in got})


def test_nothing_to_reach(spark):
    calls = spark.createDataFrame([("a", "b")], "source string, target string")
    none = spark.createDataFrame([], "node string, key string")
    assert class_reach(calls, none).count() == 0
    assert class_reach(calls.limit(0), spark.createDataFrame([("b", "x")], "node string, key string")).count() == 0
    assert class_reach(calls, spark.createDataFrame([("b", "x")], "node string, key string"), max_depth=0).count() == 0


def test_paths_avoid_sanitizers_and_checks_are_found(spark):
    names = ["route", "safe_route", "helper", "clean_input", "db_execute", "require_auth"]
    nodes = [("Function", n, f"app.py::{n}", "app.py", i, i, "python", None, None, None, False, None, None) for i, n in enumerate(names)]
    q = {n: f"app.py::{n}" for n in names}
    pairs = [("route", "helper", 3), ("route", "clean_input", 1), ("helper", "db_execute", 9), ("clean_input", "db_execute", 8),
             ("safe_route", "require_auth", 1), ("safe_route", "clean_input", 2)]
    edges = [("CALLS", q[a], q[b], "app.py", line) for a, b, line in pairs]
    g = CodeGraph(spark.createDataFrame(nodes, S.NODE_SCHEMA), spark.createDataFrame(edges, S.EDGE_SCHEMA))
    entries = g.nodes.where("name like '%route'")
    pattern = lambda p: spark.createDataFrame([(p,)], "pattern string")
    rows = RU.taint_paths(g, entries, pattern("EXECUTE"), pattern("clean_")).collect()
    assert [(r["entry"], r["path"]) for r in rows] == [(q["route"], [q["route"], q["helper"], q["db_execute"]])]
    checks = spark.createDataFrame([("auth", "require_auth"), ("rate", "rate_limit")], "check_name string, pattern string")
    missing = sorted((r["entry"], r["check_name"]) for r in RU.missing_checks(g, entries, checks).collect())
    assert missing == [(q["route"], "auth"), (q["route"], "rate"), (q["safe_route"], "rate")]
    signatures = spark.createDataFrame(
        [("1", "execute", "sql", "SINK", "any", 1), ("2", "clean_", "sql", "SANITIZER", "any", 2), ("3", "clean_", "cmd", "SINK", "any", 3)],
        "id string, qualified_pattern string, vuln_class_id string, sig_type string, language string, seq int")
    states = {(r["entry"], r["vuln_class_id"]): (r["state"], r["hops"]) for r in RU.sink_states(g, entries, signatures).collect()}
    assert states == {(q["route"], "sql"): ("open", 2), (q["safe_route"], "sql"): ("guarded", 2),
                      (q["route"], "cmd"): ("open", 1), (q["safe_route"], "cmd"): ("open", 1)}
