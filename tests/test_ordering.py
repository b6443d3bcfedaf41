"""Ranks and rolling frames through the many-task path, with a hot group."""

import random

from pyspark.sql import functions as F

from codelattice.operators import findings as FD
from codelattice.operators import risk as K
from codelattice.operators.ordering import first_per_key, rank_rows, rolling_frame
from codelattice.operators.rules import contains_join


def hot_rows(spark, n=600):
    """A third of the rows share one key; the order column has gaps and ties broken by id."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 17}", rng.randint(0, 50), i, rng.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7)


def test_rank_rows_split_equals_window(spark):
    rows, df = hot_rows(spark)
    want = {}
    for k in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            want[r[2]] = place
    for bound in (10, 10_000):
        got = {r["id"]: r["position"] for r in rank_rows(df, ["k"], ["t", "id"], bound=bound).collect()}
        assert got == want


def test_rolling_frame_split(spark):
    rows, df = hot_rows(spark)
    want = {}
    for k in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(group):
            want[r[2]] = sum(x[3] for x in group[max(0, i - 9):i + 1])
    for bound, chunk in ((10, 12), (10_000, 10_000)):
        out = rolling_frame(df, ["k"], ["t", "id"], 10, {"s": F.col("v")}, chunk=chunk, bound=bound)
        assert {r["id"]: r["s"] for r in out.collect()} == want


def test_first_per_key(spark):
    _, df = hot_rows(spark)
    one = first_per_key(df, ["k"], [F.col("t"), F.col("id")])
    assert one.count() == df.select("k").distinct().count()


def sweep(rows):
    """Reference sweep over (start, end, rank, rule length, seq)."""
    rows, kept, current = sorted(rows, key=lambda r: (r[0], r[4])), [], []
    for r in rows:
        if current and r[0] > max(x[1] for x in current) + 1:
            kept.append(max(current, key=lambda x: (x[2], x[3], -x[0], -x[4])))
            current = []
        current.append(r)
    if current:
        kept.append(max(current, key=lambda x: (x[2], x[3], -x[0], -x[4])))
    return {r[4] for r in kept}


def test_dedup_hot_file_against_sweep(spark):
    rng = random.Random(8)
    words = ["CRITICAL", "HIGH", "ERROR", None, "LOW"]
    rank = {"CRITICAL": 4, "HIGH": 3, "LOW": 1}
    rows, groups = [], {}
    for i in range(900):
        path = "hot.py" if i % 3 == 0 else f"f{i % 40}.py"
        start = rng.randint(1, 900)
        end, sev, rule = start + rng.randint(0, 3), rng.choice(words), "r" * rng.randint(1, 6)
        rows.append((i, rule, path, start, end, "cwe-089", sev))
        groups.setdefault(path, []).append((start, end, rank.get(sev, 2), len(rule), i))
    raw = spark.createDataFrame(rows, "seq int, rule_id string, file_path string, line_start int, line_end int, cwe string, severity string")
    got = {r["seq"] for r in FD.deduplicate(raw).collect()}
    assert got == set().union(*(sweep(g) for g in groups.values()))


def test_dedup_cases(spark):
    rows = [
        (0, "a", "x", 1, 2, "", "HIGH"), (1, "a", "x", 1, 2, "", "HIGH"),          # no CWE: both stay
        (2, "a", "y", 1, 2, "CWE-1", "WARNING"), (3, "abc", "y", 3, 4, "CWE-01", "WARNING"),  # adjacent: longer rule
        (4, "a", "z", 1, None, "CWE-1", "LOW"), (5, "a", "z", 5, 6, "CWE-1", "CRITICAL"),      # apart
    ]
    raw = spark.createDataFrame(rows, "seq int, rule_id string, file_path string, line_start int, line_end int, cwe string, severity string")
    assert sorted(r["seq"] for r in FD.deduplicate(raw).collect()) == [0, 1, 3, 4, 5]


def test_line_masks_against_brute_force(spark):
    from codelattice import schema as S
    from codelattice.model import CodeGraph

    rng = random.Random(5)
    nodes, ranges = [], []
    for i in range(200):
        start = rng.randint(1, 400)
        nodes.append(("Function", f"n{i}", f"f::n{i}", "hot.py", start, start + rng.choice([0, 1, 59, 60, 61, 200]), "", None, None, None, False, None, None))
    for _ in range(60):
        a = rng.randint(1, 600)
        ranges.append(("hot.py", a, a + rng.choice([0, 0, 1, 70])))
    g = CodeGraph(spark.createDataFrame(nodes, S.NODE_SCHEMA), spark.createDataFrame([], S.EDGE_SCHEMA))
    got = {r[0] for r in K.overlapping_nodes(g, spark.createDataFrame(ranges, "file_path string, start int, end int")).select("qualified_name").collect()}
    assert got == {n[2] for n in nodes if any(n[4] <= b and n[5] >= a for _, a, b in ranges)}


def test_contains_join_lengths(spark):
    texts = spark.createDataFrame([(t,) for t in ("Alpha::Beta", "xx", "a", "betamax", "")], "t string")
    pats = spark.createDataFrame([(p,) for p in ("a", "BETA", "xx", "lph", "", "betamaxx")], "p string")
    got = {(r["t"], r["p"]) for r in contains_join(texts, "t", pats, "p").collect()}
    want = {(t, p) for t in ("Alpha::Beta", "xx", "a", "betamax", "") for p in ("a", "BETA", "xx", "lph", "betamaxx") if p.lower() in t.lower()}
    assert got == want


def test_overlap_plans_no_broadcast_of_spread_rows(spark):
    """Blocks of long symbols and ends of paths are many times the table they come from: they are shuffled."""
    from codelattice import schema as S
    from codelattice.model import CodeGraph

    node = lambda path, n, a, b: ("Function", n, f"{path}::{n}", path, a, b, "", None, None, None, False, None, None)
    nodes = [node("src/App/main.py", "a", 1, 5), node("src/App/main.py", "b", 70, 200), node("lib/main.py", "c", 1, 5), node("x/domain.py", "d", 1, 5)]
    g = CodeGraph(spark.createDataFrame(nodes, S.NODE_SCHEMA), spark.createDataFrame([], S.EDGE_SCHEMA))
    names = lambda found: {r["name"] for r in found.collect()}
    of = lambda *rows: spark.createDataFrame(rows, "file_path string, start int, end int")
    found = K.overlapping_nodes(g, of(("src/App/main.py", 4, 70)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2
    assert names(found) == {"a", "b"}
    assert names(K.overlapping_nodes(g, of(("app/MAIN.py", 3, 3)))) == {"a"}
    assert names(K.overlapping_nodes(g, of(("main.py", 3, 3), ("x/domain.py", 9, 9)))) == {"a", "c", "d"}
    assert names(K.overlapping_nodes(g, of(("", 3, 3), (None, 3, 3)))) == set()


def test_risk_inputs_are_shuffled(spark, sf_dir):
    """Each input of the risk score may hold every name of the graph; staged files of names look far smaller than they are."""
    from codelattice.operators import flows as FL
    from codelattice.sources.commerce import CHECK_WORDS, workspace

    w = workspace(spark, sf_dir)
    found = K.change_risk(w.graph, w.overlapping, FL.flow_counts(w.flow_members), w.file_members, CHECK_WORDS)
    for plan in (found, FL.score_flows(w.graph, w.flow_members), FL.flow_steps(w.flow_members.drop("position"), w.graph), FL.resolvable_calls(w.graph)):
        assert "Broadcast" not in plan._jdf.queryExecution().sparkPlan().toString()


def test_levels_above_a_row_count_are_shuffled(spark, monkeypatch):
    from codelattice import session

    for few, hinted in ((10, False), (2, True)):
        monkeypatch.setattr(session, "FEW_ROWS", few)
        levels = session.Levels(spark, "test")
        one = levels.add(spark.range(2))
        assert levels.rows == 2 and "Hint" not in one._jdf.queryExecution().analyzed().toString()
        for df in (levels.add(spark.range(3)), levels.all()):
            plan = spark.range(9).join(df.select("id"), "id")._jdf.queryExecution().optimizedPlan().toString()
            assert ("strategy=merge" in plan) is hinted
        assert levels.last_rows == 3 and levels.rows == 5


def test_contains_join_sends_patterns_not_grams(spark, monkeypatch):
    from codelattice.operators import rules as RU

    texts = spark.createDataFrame([("xalphax",), ("beta",)], "t string")
    pats = spark.createDataFrame([("alpha", 1), ("eta", 2)], "p string, n int")
    for few, hint in ((10, "broadcast"), (1, "merge")):
        monkeypatch.setattr(RU, "FEW_PATTERNS", few)
        found = RU.contains_join(texts, "t", pats, "p")
        assert f"rightHint=(strategy={hint})" in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(r["t"], r["n"]) for r in found.collect()} == {("xalphax", 1), ("beta", 2)}


def test_upsert_keeps_first_sighting_of_a_run(spark):
    stored = spark.createDataFrame([("old", "LOW", "s0", 1, 1, "open")], "fingerprint string, severity string, snippet string, first_run int, last_run int, status string")
    incoming = spark.createDataFrame(
        [("new", "HIGH", "s1", 1), ("new", "INFO", "s2", 2), ("old", "HIGH", "s3", 3), ("old", "INFO", "s4", 4)],
        "fingerprint string, severity string, snippet string, seq int")
    got = {r["fingerprint"]: (r["severity"], r["snippet"], r["first_run"], r["is_new"]) for r in FD.upsert(stored, incoming, 2).collect()}
    assert got == {"new": ("HIGH", "s2", 2, True), "old": ("LOW", "s4", 1, False)}


def test_upsert_keeps_last_verdict_of_a_run(spark):
    row = "fingerprint string, verdict string, snippet string"
    stored = spark.createDataFrame([("a", None, "s", 1, 1, "open")], row + ", first_run int, last_run int, status string")
    incoming = spark.createDataFrame([("a", "true", "s1", 1), ("a", None, "s2", 2)], row + ", seq int")
    got = FD.upsert(stored, incoming, 2).first()
    assert (got["verdict"], got["snippet"]) == ("true", "s2")
