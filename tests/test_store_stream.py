"""Stored graphs and the streaming forms."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codelattice.api import GraphTools
from codelattice.plans import pipelines as PL
from codelattice.sinks import reports as RP
from codelattice.sinks import store as ST
from codelattice.streaming import previews, sessions, verdicts, watch


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_path string, text string, language string")


def names(g):
    return {r[0] for r in g.nodes.select("qualified_name").collect()}


def test_replace_files_at(spark, tmp_path):
    path = str(tmp_path / "graph")
    ST.write_graph(PL.build_from_files(frame(spark, [(f"f{i}.py", f"def a{i}():\n    b()\n", "python") for i in range(6)])), path, 4)
    fresh = PL.build_from_files(frame(spark, [("f1.py", "def new():\n    pass\n", "python")]))
    gone = spark.createDataFrame([("f1.py",), ("f2.py",)], "file_path string")
    ST.replace_files_at(spark, path, gone, fresh.nodes, fresh.edges)
    got = ST.read_graph(spark, path)
    assert names(got) == {"f0.py", "f0.py::a0", "f1.py", "f1.py::new", "f3.py", "f3.py::a3", "f4.py", "f4.py::a4", "f5.py", "f5.py::a5"}
    assert {r[0] for r in got.edges_of("CALLS").select("source").collect()} == {"f0.py::a0", "f3.py::a3", "f4.py::a4", "f5.py::a5"}
    ST.replace_files_at(spark, path, got.nodes.select("file_path").distinct(), got.nodes.limit(0), got.edges.limit(0))
    assert ST.read_graph(spark, path).nodes.count() == 0


def test_metadata(spark, tmp_path):
    path = str(tmp_path)
    ST.save_metadata(spark, path, {"a": "1", "b": "2"})
    ST.save_metadata(spark, path, {"a": "3"})
    assert ST.load_metadata(spark, path) == {"a": "3", "b": "2"}


def test_watch(spark, tmp_path):
    graph, events = str(tmp_path / "graph"), tmp_path / "events"
    events.mkdir()
    ST.write_graph(PL.build_from_files(frame(spark, [("a.py", "def a():\n    pass\n", "python"), ("b.py", "def b():\n    pass\n", "python")])), graph, 4)

    def drop(name, rows):
        (events / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        watch.watch(watch.event_stream(spark, str(events)), graph, str(tmp_path / "ckpt"), once=True).awaitTermination()

    drop("1.json", [
        {"file_path": "a.py", "event": "modified", "ts": "2024-01-01T00:00:00Z", "text": "def old():\n    pass\n"},
        {"file_path": "a.py", "event": "modified", "ts": "2024-01-01T00:00:01Z", "text": "def fresh():\n    b()\n"},
        {"file_path": "x.bin", "event": "created", "ts": "2024-01-01T00:00:01Z", "text": "?"},
    ])
    run()
    assert names(ST.read_graph(spark, graph)) == {"a.py", "a.py::fresh", "b.py", "b.py::b"}
    drop("2.json", [{"file_path": "b.py", "event": "deleted", "ts": "2024-01-01T00:00:02Z"}])
    run()
    assert names(ST.read_graph(spark, graph)) == {"a.py", "a.py::fresh"}


def stream_of(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in this order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def collect(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


@pytest.mark.parametrize("order", ["as made", "turned round", "mixed"])
def test_session_stream_equals_batch(spark, tmp_path, order):
    """Calls may arrive in any order within the lateness; what is later than that is dropped."""
    from codelattice.operators.sessions import session_intents

    tools = ["refactor", "detect_changes", "query_graph", "list_flows", "other"]
    rows = [{"session_id": i % 3, "ts": f"2024-01-01T00:{i:02d}:00Z", "call_id": i, "tool": tools[(i * 7) % 5]} for i in range(45)]
    schema = "session_id bigint, ts timestamp, call_id bigint, tool string"
    batch = session_intents(spark.createDataFrame(rows).selectExpr("session_id", "cast(ts as timestamp) ts", "call_id", "tool")).collect()
    parts = {"as made": [rows[:20], rows[20:]], "turned round": [rows[20:], rows[:20]], "mixed": [rows[::2], rows[1::2]]}[order]
    # The closing calls move the watermark past all others, which are answered; the last file is too late.
    closing = [[{"session_id": 9, "ts": f"2024-01-01T{9 + i:02d}:00:00Z", "call_id": 900 + i, "tool": "other"}] for i in range(2)]
    late = [{"session_id": 0, "ts": "2024-01-01T00:00:30Z", "call_id": 990, "tool": "other"}]
    stream = stream_of(spark, tmp_path, [*parts, *closing, late], schema)
    got = collect(sessions.stream_intents(stream, "2 hours"), tmp_path, f"intents_{order.replace(' ', '_')}")
    assert sorted((r["session_id"], r["call_id"], r["intent"]) for r in got if r["session_id"] != 9) == sorted((r["session_id"], r["call_id"], r["intent"]) for r in batch)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    call = lambda s, ts, i: {"session_id": s, "ts": ts, "call_id": i, "tool": "refactor"}
    parts = [[call("a", "2024-01-01T00:00:00Z", 1)], [call("z", "2024-01-03T00:00:00Z", 2)], [call("z", "2024-01-05T00:00:00Z", 3)], [call("a", "2024-01-05T01:00:00Z", 4)], [call("z", "2024-01-06T00:00:00Z", 5)]]
    schema = "session_id string, ts timestamp, call_id bigint, tool string"
    got = collect(sessions.stream_intents(stream_of(spark, tmp_path, parts, schema)), tmp_path, "idle")
    assert {(r["session_id"], r["call_id"], r["calls"]) for r in got if r["session_id"] == "a"} == {("a", 1, 1), ("a", 4, 1)}


@pytest.mark.parametrize("turned", [False, True])
def test_previews(spark, tmp_path, turned):
    act = lambda i, ts, a: {"refactor_id": i, "ts": f"2024-01-01T{ts}Z", "action": a}
    parts = [[act("a", "00:00:00", "preview"), act("c", "00:00:00", "preview")], [act("a", "00:00:01", "apply"), act("b", "00:00:01", "apply"), act("c", "00:20:00", "apply")]]
    closing = [act("d", "05:00:00", "preview")]
    schema = "refactor_id string, ts timestamp, action string"
    df = previews.track_previews(stream_of(spark, tmp_path, [*(parts[::-1] if turned else parts), closing], schema), lateness="1 hour")
    got = collect(df, tmp_path, f"previews_{turned}")
    assert sorted((r[0], r[1]) for r in got) == [("a", "applied"), ("a", "pending"), ("b", "unknown"), ("c", "expired"), ("c", "pending"), ("c", "unknown")]


def test_verdict_stream(spark, tmp_path):
    rows = [[{"rule_id": "r", "file_path": "f", "line_start": n, "current_hash": "h", "ts": "2024-01-01T00:00:00Z"} for n in (1, 2, 1)]]
    schema = "rule_id string, file_path string, line_start int, current_hash string, ts timestamp"
    stored = spark.createDataFrame([("r", "f", 1, "CONFIRMED", "h"), ("r", "f", 2, "CONFIRMED", "old")],
                                   "rule_id string, file_path string, line_start int, verdict string, file_hash string")
    from codelattice.functions.findings import fingerprint

    stored = stored.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_start")))
    df = stream_of(spark, tmp_path, rows, schema)
    got = collect(verdicts.cached_verdicts(df, stored), tmp_path, "cached")
    assert sorted((r["line_start"], bool(r["hit"])) for r in got) == [(1, True), (1, True), (2, False)]
    first = collect(verdicts.first_sightings(df), tmp_path, "first")
    assert len(first) == 2


def test_reports_written(spark, tmp_path):
    rows = [("x", "r.one", "One", "HIGH", "/t/a.py", 3, 4, "CWE-1", "s", "CONFIRMED", None, 9.1, "d"),
            ("y", "r.two", "Two", "LOW", "/t/b.py", 0, 0, "", "s", "FALSE_POSITIVE", None, None, "")]
    found = spark.createDataFrame(rows, "fingerprint string, rule_id string, title string, severity string, file_path string, line_start int, line_end int, cwe string, snippet string, verdict string, verdict_severity string, cvss_score double, description string")
    RP.write_json(found, str(tmp_path / "json"), "/t")
    RP.write_sarif(found, F.col("fingerprint"), str(tmp_path / "sarif"), "/t")
    RP.write_markdown(found, str(tmp_path / "md"), "/t")
    assert spark.read.json(str(tmp_path / "json/summary")).first()["active"] == 1
    result = json.loads(spark.read.text(str(tmp_path / "sarif/results")).first()[0])
    assert result["level"] == "error" and result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a.py"
    assert json.loads(spark.read.text(str(tmp_path / "sarif/rules")).first()[0])["properties"]["tags"] == ["CWE-1"]
    assert "9.1 (Critical)" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "md/sections")).collect())


def test_scan_twice(spark):
    raw = spark.createDataFrame([(1, "r.a", "f.py", 1, 2, "CWE-1", "ERROR", "s1"), (2, "r.ab", "f.py", 2, 3, "CWE-1", "ERROR", "s2")],
                                "seq int, rule_id string, file_path string, line_start int, line_end int, cwe string, severity string, snippet string")
    one = PL.scan(raw, None, 1)
    assert [r["rule_id"] for r in one["store"].collect()] == ["r.ab"]
    two = PL.scan(raw.withColumn("snippet", F.lit("s3")), one["store"], 2)
    row = two["store"].first()
    assert (row["first_run"], row["last_run"], row["snippet"], two["is_new"].count()) == (1, 2, "s3", 0)


def test_tools(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("from b import g\ndef f():\n    g()\n")
    (src / "b.py").write_text("def g():\n    h()\ndef h():\n    pass\n")
    tools = GraphTools.build(spark, str(src), str(tmp_path / "graph"))
    assert [r["source"] for r in tools.query_graph("callers_of", "b.py::g").collect()] == ["a.py::f"]
    assert tools.query_graph("callers_of", "map").count() == 0
    assert {r["qualified_name"] for r in tools.get_impact_radius(["b.py"]).where("role = 'impacted'").collect()} >= {"a.py::f"}
    assert tools.get_flow("a.py::f").orderBy("position").select("node").collect()[-1][0] == "b.py::h"
    assert tools.trace_path("f", "h").first()["hops"] == 2
    assert tools.detect_changes(["b.py"])["summary"].first()["changed_functions"] == 2
    assert tools.rename_preview("g", "gg").count() >= 2
    assert tools.semantic_search_nodes("g").count() > 0
    assert tools.search_nodes("zz").count() == 0
    tools.register_views()
    assert spark.sql("SELECT count(*) FROM edges WHERE kind = 'CALLS'").first()[0] == 2
    for call in (tools.get_stats, tools.get_flows, tools.list_communities, tools.find_dead_code, tools.get_hubs):
        assert call().columns
