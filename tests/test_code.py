"""Source texts to graphs: golden facts of small trees."""

import json
import subprocess

import pytest

from codelattice.operators import relations as R
from codelattice.plans import pipelines as PL
from codelattice.sources import files as FI
from codelattice.sources import notebooks as NB

APP = '''import os
from shop.db import connect as open_db

class Base:
    pass

class Cart(Base):
    def total(self, items: list, rate=(1)) -> float:
        return self.add(price(items))

    def add(self, n):
        return open_db().run(n)

@app.route("/pay")
def pay():
    return Cart().total([])

def price(items):
    return sum(items)
'''
DB = "def connect():\n    return object()\n"
TEST = "from shop.app import pay\n\ndef test_pay():\n    assert pay()\n"
SCRIPT = "import { draw as paint } from './lib';\nclass View {\n  show(x) {\n    return paint(x);\n  }\n}\n"
LIB = "export function draw(q) {\n  return q;\n}\n"
GO = 'package main\n\nfunc Hello(n string) {\n\tprint(n)\n}\n\nfunc main() {\n\tHello("x")\n}\n'


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_path string, text string, language string")


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("shop/app.py", APP, "python"), ("shop/db.py", DB, "python"), ("tests/test_app.py", TEST, "python"),
            ("broken.py", "def (", "python"), ("web/view.js", SCRIPT, "javascript"), ("web/lib.js", LIB, "javascript"),
            ("m.go", GO, "go")]
    return PL.build_from_files(frame(spark, rows))


def nodes(g):
    return {r["qualified_name"]: r for r in g.nodes.collect()}


def edges(g, kind):
    return {(r["source"], r["target"]) for r in g.edges_of(kind).collect()}


def test_nodes(graph):
    n = nodes(graph)
    assert n["shop/app.py::Cart.total"]["params"] == "(self, items: list, rate=(1))"
    assert n["shop/app.py::Cart.total"]["return_type"] == "float"
    assert (n["shop/app.py::Cart"]["line_start"], n["shop/app.py::Cart"]["line_end"]) == (7, 12)
    assert n["shop/app.py::pay"]["decorators"] == ["app.route('/pay')"]
    assert n["tests/test_app.py::test_pay"]["kind"] == "Test"
    assert n["tests/test_app.py"]["is_test"] and not n["shop/app.py"]["is_test"]
    assert n["broken.py"]["kind"] == "File"
    assert n["web/view.js::View.show"]["kind"] == "Function"
    assert n["m.go::main"]["line_end"] == 9


def test_calls_resolve(graph):
    calls = edges(graph, "CALLS")
    assert ("shop/app.py::Cart.total", "shop/app.py::price") in calls
    assert ("shop/app.py::Cart.total", "shop/app.py::Cart.add") in calls
    assert ("shop/app.py::Cart.add", "shop/db.py::open_db") in calls
    assert ("shop/app.py::Cart.add", "run") in calls
    assert ("shop/app.py::price", "sum") in calls
    assert ("web/view.js::View.show", "web/lib.js::paint") in calls
    assert ("m.go::main", "m.go::Hello") in calls


def test_other_edges(graph):
    assert edges(graph, "INHERITS") == {("shop/app.py::Cart", "Base")}
    assert ("shop/app.py", "shop/db.py") in edges(graph, "IMPORTS_FROM")
    assert ("shop/app.py", "os") in edges(graph, "IMPORTS_FROM")
    assert edges(graph, "TESTED_BY") == {("shop/app.py::pay", "tests/test_app.py::test_pay")}
    assert ("shop/app.py::Cart", "shop/app.py::Cart.add") in edges(graph, "CONTAINS")


def test_dead_code_and_entries(graph):
    names = {r["qualified_name"] for r in R.dead_code(graph).collect()}
    assert "shop/app.py::Base" in names and "shop/app.py::price" not in names
    assert "shop/app.py::pay" not in {r["qualified_name"] for r in R.entry_points(graph).collect()}
    assert "shop/app.py::pay" in {r["qualified_name"] for r in R.entry_points(graph, decorators=True).collect()}


def test_notebook_variants(spark):
    book = json.dumps({"metadata": {"language_info": {"name": "python"}}, "cells": [
        {"cell_type": "code", "source": ["%pip install x\n", "def f():\n", "    return g()\n"]},
        {"cell_type": "markdown", "source": "text"},
        {"cell_type": "code", "source": "%sql\nINSERT OVERWRITE `a`.`b` SELECT 1 FROM c JOIN d.e"},
        {"cell_type": "code", "source": "%scala\nval x = 1"},
        {"cell_type": "code", "source": "def g():\n    return 1"},
    ]})
    files = frame(spark, [("n.ipynb", book, "notebook")])
    cells = {r["cell_index"]: (r["language"], r["source"]) for r in NB.notebook_cells(files).collect()}
    assert cells == {0: ("python", "def f():\n    return g()\n"), 2: ("sql", "INSERT OVERWRITE `a`.`b` SELECT 1 FROM c JOIN d.e"),
                     4: ("python", "def g():\n    return 1")}
    g = PL.build_from_files(files)
    assert ("n.ipynb::f", "n.ipynb::g") in edges(g, "CALLS")
    assert {t for _, t in edges(g, "IMPORTS_FROM")} == {"a.b", "c", "d.e"}


def test_r_cells_are_built(spark):
    cell = lambda source: {"cell_type": "code", "source": source}
    in_r = "tidy <- function(x) {\n  scale_up(x)\n}\n"
    mixed = json.dumps({"metadata": {"language_info": {"name": "python"}}, "cells": [cell("def f():\n    return g()\n"), cell("%r\n" + in_r)]})
    only = json.dumps({"metadata": {"kernelspec": {"language": "R"}}, "cells": [cell(in_r)]})
    magic = "# Databricks notebook source\n" + "".join(f"# MAGIC {line}\n" for line in ("%r\n" + in_r).strip().split("\n"))
    g = PL.build_from_files(frame(spark, [("m.ipynb", mixed, "notebook"), ("o.ipynb", only, "notebook"), ("e.py", magic, "python")]))
    calls = edges(g, "CALLS")
    assert ("m.ipynb::f", "g") in calls
    assert {(f"{p}::tidy", "scale_up") for p in ("m.ipynb", "o.ipynb", "e.py")} <= calls
    files = [r["file_path"] for r in g.nodes.where("kind = 'File'").collect()]
    assert sorted(files) == ["e.py", "m.ipynb", "o.ipynb"]


def test_export_with_magic(spark):
    text = ("# Databricks notebook source\nx = 1\n# COMMAND ----------\n# MAGIC %sql\n# MAGIC SELECT * FROM t1\n"
            "# COMMAND ----------\n# MAGIC %md\n# MAGIC hi\n# COMMAND ----------\ndef f():\n    return h()\n")
    g = PL.build_from_files(frame(spark, [("e.py", text, "python")]))
    assert edges(g, "IMPORTS_FROM") == {("e.py", "t1")}
    assert ("e.py::f", "h") in edges(g, "CALLS")


def test_component_blocks_keep_lines(spark):
    text = "<template/>\n<script lang='ts'>\nfunction a() {\n  b();\n}\n</script>\n<p/>\n<script>\nfunction b() {\n}\n</script>\n"
    n = nodes(PL.build_from_files(frame(spark, [("c.vue", text, "vue")])))
    assert n["c.vue::a"]["line_start"] == 3 and n["c.vue::b"]["line_start"] == 9


def test_read_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in {"a.py": b"x = 1\n", "b.txt": b"no", "node_modules/c.js": b"x", "d.py": b"\x00\x01", "e.GO": b"package e"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["file_path"]: r["language"] for r in FI.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "e.GO": "go"}


def test_git_sources(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    git("add", "."), git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("one\nTWO\nthree\n")
    (tmp_path / "b.py").write_text("x\n")
    git("add", "."), git("commit", "-qm", "two")
    repo = str(tmp_path)
    assert [r[0] for r in FI.tracked_files(spark, repo).orderBy("file_path").collect()] == ["a.py", "b.py"]
    assert [r[0] for r in FI.changed_files(spark, repo).orderBy("file_path").collect()] == ["a.py", "b.py"]
    assert FI.changed_files(spark, repo, "--output=x").count() == 0
    from codelattice.sources.diff import parse_unified_diff

    got = {(r["file_path"], r["start"], r["end"]) for r in parse_unified_diff(FI.diff_text(spark, repo)).collect()}
    assert got == {("a.py", 2, 3), ("b.py", 1, 1)}
    assert FI.git_state(spark, repo).first()["dirty"] is False
    assert FI.repo_root(str(tmp_path)) == repo


def test_evaluation_configs_and_registry(spark):
    doc = json.dumps({"name": "r", "url": "u", "commit": "c", "language": "go", "size_category": "s",
                      "test_commits": [{"sha": "1", "description": "d", "changed_files": 2}], "entry_points": ["main"],
                      "search_queries": [{"query": "q", "expected": "e"}]})
    parts = FI.evaluation_configs(spark.createDataFrame([(doc,)], "text string"))
    assert parts["commits"].first()["changed_files"] == 2 and parts["queries"].first()["expected"] == "e"
    repos = FI.repositories(spark, spark.createDataFrame([('{"repos":[{"path":"/a","alias":"x"},{"path":"/b"}]}',)], "text string"))
    assert FI.resolve_repository(repos, "x").first()["path"] == "/a"
    assert FI.resolve_repository(repos, "/b").first()["path"] == "/b"


def test_incremental_equals_full(spark):
    old = {"a.py": "from b import g\ndef f():\n    g()\n", "b.py": "def g():\n    pass\n", "c.py": "def h():\n    pass\n", "d.py": "def z():\n    pass\n"}
    new = {**old, "b.py": "def g():\n    k()\ndef k():\n    pass\n"}
    del new["d.py"]
    hashed = lambda tree: frame(spark, [(k, v, "python") for k, v in tree.items()]).selectExpr("*", "sha2(text, 256) AS file_hash")
    before = PL.build_from_files(hashed(old))
    changed = spark.createDataFrame([("b.py",), ("d.py",)], "file_path string")
    after = PL.update_from_files(before, hashed(old).select("file_path", "file_hash"), hashed(new), changed)
    full = PL.build_from_files(hashed(new))
    assert {r[0] for r in after.nodes.select("qualified_name").collect()} == {r[0] for r in full.nodes.select("qualified_name").collect()}
    assert {tuple(r) for r in after.edges.collect()} == {tuple(r) for r in full.edges.collect()}


def test_yaml_documents(spark):
    pytest.importorskip("yaml")
    from codelattice.sources.scanner import custom_rules

    doc = "id: r1\nname: Rule\nsinks:\n  - name: run\n    qualified_pattern: os.run\n"
    texts = FI.yaml_to_json(spark.createDataFrame([(1, doc)], "seq int, text string"))
    parts = custom_rules(texts)
    assert parts["classes"].first()["severity"] == "MEDIUM"
    sig = parts["signatures"].first()
    assert (sig["id"], sig["sig_type"], sig["vuln_class_id"]) == ("r1-sink-run", "SINK", "r1")


def lines_of(spark, name, text, language):
    from codelattice.plans import pipelines

    g = pipelines.build_from_files(spark.createDataFrame([(name, text, language)], "file_path string, text string, language string"))
    return {r["qualified_name"] for r in g.nodes.collect()}, {(r["source"], r["target"]) for r in g.edges.where("kind = 'CALLS'").collect()}


def test_strings_and_comments_hold_no_calls(spark):
    text = "function a() {\n  fetch('http://x/y').then(load()); // gone(1)\n  /* dead(1) */ live('call fake( }');\n  /* one {\n  two(2)\n  */ last();\n}\nfunction b() {\n  c();\n}\n"
    nodes, calls = lines_of(spark, "s.js", text, "javascript")
    assert {"s.js::a", "s.js::b"} <= nodes
    called = {(s, t.rsplit("::", 1)[-1]) for s, t in calls}
    assert called == {("s.js::a", n) for n in ("fetch", "then", "load", "live", "last")} | {("s.js::b", "c")}


def test_block_words(spark):
    nodes, calls = lines_of(spark, "m.lua", "local M = {}\nfunction M.area(x)\n  if x then\n    grow(x) -- shrink(x)\n  end\nend\nlocal function other()\n  stop()\nend\n", "lua")
    assert {"m.lua", "m.lua::M.area", "m.lua::other"} <= nodes and {("m.lua::M.area", "grow"), ("m.lua::other", "stop")} <= calls
    nodes, calls = lines_of(spark, "m.rb", "class Shape\n  def area(x)\n    grow(x) if x\n  end\n  def other\n    [1].each do |y|\n      stop(y)\n    end\n  end\nend\n", "ruby")
    assert {"m.rb", "m.rb::Shape", "m.rb::Shape.area", "m.rb::Shape.other"} <= nodes and {("m.rb::Shape.area", "grow"), ("m.rb::Shape.other", "stop")} <= calls
    nodes, calls = lines_of(spark, "m.pl", "package Shape;\nsub area {\n  grow(1); # shrink(1)\n}\n", "perl")
    assert {"m.pl", "m.pl::Shape", "m.pl::Shape.area"} <= nodes and ("m.pl::Shape.area", "grow") in calls


def test_every_file_has_a_node(spark):
    nodes, _ = lines_of(spark, "x.sh", "echo hi\n", "bash")
    assert nodes == {"x.sh"}


def test_broken_python_keeps_what_reads(spark):
    text = "def a(): b()\ndef b(:\n    c()\nclass K(Base, metaclass=M):\n    async def go(self):\n        def inner():\n            x()\n        y()\nz()\n"
    g = PL.build_from_files(frame(spark, [("b.py", text, "python"), ("ok.py", "def f():\n    pass\n", "python")]))
    n = nodes(g)
    assert n["b.py"]["extra"] == {"reader": "lines"} and n["ok.py"]["extra"] is None
    assert (n["b.py::K"]["line_end"], n["b.py::K.go"]["line_end"], n["b.py::K.inner"]["line_end"]) == (8, 8, 7)
    assert edges(g, "CALLS") == {("b.py::a", "b.py::b"), ("b.py::b", "c"), ("b.py::K.inner", "x"), ("b.py::K.go", "y")}
    assert edges(g, "INHERITS") == {("b.py::K", "Base")}


def test_runner_calls_in_test_files_only(spark):
    text = "describe('a  b', () => {\n  function it(x) {\n    help(x);\n  }\n  obj.test(1);\n  afterAll(function () { stop(); });\n});\n"
    for path in ("x.test.ts", "x.ts"):
        n = nodes(PL.build_from_files(frame(spark, [(path, text, "typescript")])))
        got = {q for q, r in n.items() if r["kind"] == "Test" and "@L" in q}
        assert got == ({f"{path}::describe:a b@L1", f"{path}::afterAll@L6"} if path == "x.test.ts" else set())
        assert f"{path}::it" in n
