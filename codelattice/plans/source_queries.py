"""Registered source, sink, incremental and session analyses.

Texts (code, notebooks, diffs, rule documents, scanner reports) are derived
from the driver's tables by Spark and read back by the readers under check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions import findings as X
from codelattice.functions.text import doc_section, line_slice
from codelattice.operators import communities as C
from codelattice.operators import ordering as O
from codelattice.operators import refactor as RF
from codelattice.operators import sessions as SS
from codelattice.operators import value_flow as VF
from codelattice.plans import pipelines as PL
from codelattice.plans.finding_queries import VERDICTS, HISTORY, judged
from codelattice.plans.oracle_base import FINDINGS, GRAPH, flow, graph, over
from codelattice.session import stage, stage_root
from codelattice.sinks import reports as RP
from codelattice.sinks import store as ST
from codelattice.sinks.versions import VersionedTables
from codelattice.sources import files as FI
from codelattice.sources import notebooks as NB
from codelattice.sources import scanner as SC
from codelattice.sources.commerce import Workspace
from codelattice.sources.diff import parse_unified_diff
from codelattice.sources.value_flow import extract_flows
from codelattice.streaming import watch as WT

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _c(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- code --------------------------------------------------------------------


def spread(w: Workspace, table: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table dealt over all tasks by a key: the texts made of them are far larger than the file that one task reads."""
    return w.table(table).select(key, *columns).repartition(w.spark.sparkContext.defaultParallelism, key)


def python_files(w: Workspace) -> DataFrame:
    """One Python module per part; it imports the module of the next smaller key."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = _c(
        "import os\n", F.when(k > 0, _c("from gen.p", k - 1, " import helper_", k - 1, "\n")).otherwise("\n"),
        "class Box", k, "(Root):\n    def run(self, a, b=", size, "):\n        helper_", k, "(a)\n        return self.stop()\n",
        "    def stop(self) -> str:\n        return os.getcwd()\n\n",
        "def helper_", k, "(x):\n    ", F.when(k > 0, _c("helper_", k - 1, "(x)")).otherwise("pass"), "\n    return Box", k, "().run(x, 1)\n\n",
        "@app.route('/", k, "')\ndef test_part_", k, "():\n    helper_", k, "(", size, ")\n",
    )
    return spread(w, "part", "p_partkey", "p_size").select(_c("gen/p", k, ".py").alias("file_path"), text.alias("text"), F.lit("python").alias("language"))


PY = """
p AS (SELECT p_partkey AS k, p_size AS s, 'gen/p' || p_partkey || '.py' AS f, 'gen/p' || (p_partkey - 1) || '.py' AS pf FROM part),
py_nodes AS (
  SELECT 'File' AS kind, f AS qualified_name, 1 AS line_start, 17 AS line_end, NULL AS params, NULL AS return_type FROM p
  UNION ALL SELECT 'Class', f || '::Box' || k, 3, 8, NULL, NULL FROM p
  UNION ALL SELECT 'Function', f || '::Box' || k || '.run', 4, 6, '(self, a, b=' || s || ')', NULL FROM p
  UNION ALL SELECT 'Function', f || '::Box' || k || '.stop', 7, 8, '(self)', 'str' FROM p
  UNION ALL SELECT 'Function', f || '::helper_' || k, 10, 12, '(x)', NULL FROM p
  UNION ALL SELECT 'Test', f || '::test_part_' || k, 15, 16, '()', NULL FROM p),
py_edges AS (
  SELECT 'IMPORTS_FROM' AS kind, f AS source, 'os' AS target, 1 AS line FROM p
  UNION ALL SELECT 'IMPORTS_FROM', f, pf, 2 FROM p WHERE k > 0
  UNION ALL SELECT 'INHERITS', f || '::Box' || k, 'Root', 3 FROM p
  UNION ALL SELECT 'CONTAINS', f, f || '::Box' || k, 3 FROM p
  UNION ALL SELECT 'CONTAINS', f || '::Box' || k, f || '::Box' || k || '.run', 4 FROM p
  UNION ALL SELECT 'CONTAINS', f || '::Box' || k, f || '::Box' || k || '.stop', 7 FROM p
  UNION ALL SELECT 'CONTAINS', f, f || '::helper_' || k, 10 FROM p
  UNION ALL SELECT 'CONTAINS', f, f || '::test_part_' || k, 15 FROM p
  UNION ALL SELECT 'CALLS', f || '::Box' || k || '.run', f || '::helper_' || k, 5 FROM p
  UNION ALL SELECT 'CALLS', f || '::Box' || k || '.run', f || '::Box' || k || '.stop', 6 FROM p
  UNION ALL SELECT 'CALLS', f || '::Box' || k || '.stop', 'getcwd', 8 FROM p
  UNION ALL SELECT 'CALLS', f || '::helper_' || k, pf || '::helper_' || (k - 1), 11 FROM p WHERE k > 0
  UNION ALL SELECT 'CALLS', f || '::helper_' || k, f || '::Box' || k, 12 FROM p
  UNION ALL SELECT 'CALLS', f || '::helper_' || k, f || '::Box' || k || '.run', 12 FROM p
  UNION ALL SELECT 'CALLS', f || '::test_part_' || k, f || '::helper_' || k, 16 FROM p)
"""


@register("python_nodes", over(PY, sql="SELECT * FROM py_nodes"))
def python_nodes(w: Workspace) -> DataFrame:
    return PL.build_from_files(python_files(w)).nodes.select(
        "kind", "qualified_name", "line_start", "line_end", "params", "return_type")


@register("python_edges", over(PY, sql="SELECT * FROM py_edges"))
def python_edges(w: Workspace) -> DataFrame:
    return PL.build_from_files(python_files(w)).edges.select("kind", "source", "target", "line")


# One text per part: a value from a request reaches a query text in one of six forms.
FLOW = """
fl AS (SELECT p_partkey AS k, p_partkey % 6 AS form, 'api/v' || p_partkey || '.py' AS f, replace(p_name, ' ', '_') AS noun FROM part),
put AS (SELECT *, CASE WHEN form = 5 THEN f || '::run_' || k ELSE f || '::view_' || noun END AS func, CASE form WHEN 2 THEN 4 WHEN 5 THEN 6 ELSE 3 END AS line FROM fl)
"""


def flow_texts(w: Workspace) -> DataFrame:
    k, noun = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))
    form = F.col("p_partkey") % 6
    body = (
        F.when(form == 0, F.lit('    db.execute(f"select {value}")\n'))
        .when(form == 1, F.lit('    db.execute("select %s" % value)\n'))
        .when(form == 2, F.lit('    query = "select " + value\n    db.execute(query)\n'))
        .when(form == 3, F.lit('    db.execute("select ?", (value,))\n'))
        .when(form == 4, F.lit('    db.execute("select " + escape(value))\n'))
        .otherwise(F.concat(F.lit("    run_"), k, F.lit("(value)\n\ndef run_"), k, F.lit('(text):\n    db.execute("select " + text)\n')))
    )
    return spread(w, "part", "p_partkey", "p_name").select(
        F.concat(F.lit("api/v"), k, F.lit(".py")).alias("file_path"),
        F.concat(F.lit("def view_"), noun, F.lit("(request):\n    value = request.args.get('"), noun, F.lit("')\n"), body).alias("text"))


@register("call_arguments", over(FLOW, sql="""
SELECT f || '::view_' || noun AS func, 2 AS line, 'request.args.get' AS callee, 0 AS position, 'string_literal' AS shape, false AS concatenated, false AS parameterised FROM fl
UNION ALL SELECT func, line, 'db.execute', 0, CASE form WHEN 0 THEN 'f_string' WHEN 1 THEN 'percent_format' WHEN 2 THEN 'identifier' WHEN 3 THEN 'string_literal' ELSE 'binary_op' END,
 form NOT IN (2, 3), false FROM put
UNION ALL SELECT func, line, 'db.execute', 1, 'tuple', false, true FROM put WHERE form = 3
UNION ALL SELECT func, line, 'escape', 0, 'identifier', false, false FROM put WHERE form = 4
UNION ALL SELECT f || '::view_' || noun, 3, 'run_' || k, 0, 'identifier', false, false FROM put WHERE form = 5"""))
def call_arguments(w: Workspace) -> DataFrame:
    return VF.call_arguments(extract_flows(flow_texts(w))).drop("keyword")


@register("argument_taint", over(FLOW, sql="""
SELECT func, line, 'db.execute' AS callee, 0 AS position, CASE form WHEN 0 THEN 'f_string' WHEN 1 THEN 'percent_format' WHEN 2 THEN 'identifier' ELSE 'binary_op' END AS shape,
 true AS concatenated, CASE form WHEN 2 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS hops FROM put WHERE form NOT IN (3, 4)"""))
def argument_taint(w: Workspace) -> DataFrame:
    flows = extract_flows(flow_texts(w))
    word = lambda text: flows.sparkSession.range(1).select(F.lit(text).alias("pattern"))
    return VF.argument_taint(flows, word("request.args"), word(".execute"), word("escape")).drop("keyword")


@register("script_graph", """
WITH p AS (SELECT p_partkey AS k, 'web/s' || p_partkey || '.js' AS f, 'web/s' || (p_partkey - 1) || '.js' AS pf FROM part)
SELECT 'IMPORTS_FROM' AS kind, f AS source, pf AS target, 1 AS line FROM p WHERE k > 0
UNION ALL SELECT 'CONTAINS', f, f || '::Panel' || k, 2 FROM p
UNION ALL SELECT 'CONTAINS', f || '::Panel' || k, f || '::Panel' || k || '.draw', 3 FROM p
UNION ALL SELECT 'CALLS', f || '::Panel' || k || '.draw', f || '::paint' || k, 4 FROM p
UNION ALL SELECT 'CONTAINS', f, f || '::paint' || k, 7 FROM p
UNION ALL SELECT 'CALLS', f || '::paint' || k, pf || '::paint' || (k - 1), 8 FROM p WHERE k > 0""")
def script_graph(w: Workspace) -> DataFrame:
    k = F.col("p_partkey")
    text = _c(
        F.when(k > 0, _c("import { paint", k - 1, " } from './s", k - 1, "';\n")).otherwise("\n"),
        "export class Panel", k, " {\n  draw(x) {\n    return paint", k, "(x);\n  }\n}\n",
        "function paint", k, "(y) {\n", F.when(k > 0, _c("  return paint", k - 1, "(y);\n")).otherwise("  return y;\n"), "}\n",
    )
    files = spread(w, "part", "p_partkey").select(_c("web/s", k, ".js").alias("file_path"), text.alias("text"), F.lit("javascript").alias("language"))
    return PL.build_from_files(files).edges.select("kind", "source", "target", "line")


@register("script_tests", r"""
WITH p AS (SELECT p_partkey AS k, 'web/s' || p_partkey || '.test.js' AS f, 'web/s' || p_partkey || '.js' AS lib, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS t FROM part),
n AS (SELECT *, f || '::describe:panel ' || t || '@L2' AS d, f || '::beforeEach@L3' AS b, f || '::it:draws ${' || k || '} /* not@L4' AS i, f || '::it:rows@L7' AS e, f || '::test:short@L7' AS s FROM p)
SELECT 'CONTAINS' AS kind, f AS source, d AS target, 2 AS line FROM n
UNION ALL SELECT 'CONTAINS', d, b, 3 FROM n
UNION ALL SELECT 'CONTAINS', d, i, 4 FROM n
UNION ALL SELECT 'CONTAINS', d, e, 7 FROM n
UNION ALL SELECT 'CONTAINS', e, s, 7 FROM n
UNION ALL SELECT 'CALLS', b, 'reset', 3 FROM n
UNION ALL SELECT 'CALLS', i, u, 5 FROM n, (SELECT unnest(['expect', 'toBe']) AS u)
UNION ALL SELECT 'CALLS', i, lib || '::paint' || k, 5 FROM n
UNION ALL SELECT 'CALLS', s, 'check', 7 FROM n
UNION ALL SELECT 'TESTED_BY', 'reset', b, 3 FROM n
UNION ALL SELECT 'TESTED_BY', u, i, 5 FROM n, (SELECT unnest(['expect', 'toBe']) AS u)
UNION ALL SELECT 'TESTED_BY', lib || '::paint' || k, i, 5 FROM n
UNION ALL SELECT 'TESTED_BY', 'check', s, 7 FROM n""")
def script_tests(w: Workspace) -> DataFrame:
    """Calls of test runners as nodes below one another, with what they call and test."""
    k = F.col("p_partkey")
    test = _c(
        "import { paint", k, " } from './s", k, "';\ndescribe('panel ", F.col("p_name"), "', () => {\n  beforeEach(() => { reset(); });\n  it.only(`draws ${", k,
        "} /* not`, function () {\n    expect(paint", k, "(1)).toBe('it(');\n  });\n  it.each([[1], [2]])(\"rows\", (n) => { test('short', () => check(n)); });\n});\n",
    )
    part = spread(w, "part", "p_partkey", "p_name")
    files = part.select(_c("web/s", k, ".test.js").alias("file_path"), test.alias("text")).unionByName(
        part.select(_c("web/s", k, ".js").alias("file_path"), _c("export function paint", k, "(y) {\n  return y;\n}\n").alias("text"))
    ).withColumn("language", F.lit("javascript"))
    return PL.build_from_files(files).edges.where(
        F.col("file_path").endswith(".test.js") & (F.col("kind") != "IMPORTS_FROM")
    ).select("kind", "source", "target", "line")


@register("script_strings", """
WITH d AS (SELECT doc_id, coalesce(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '') AS t FROM documents),
n AS (SELECT 'web/d' || doc_id || '.js' AS f, CAST(2 * (length(t) - length(replace(t, chr(10), ''))) + 3 AS INTEGER) AS ln FROM d)
SELECT f AS file_path, 'File' AS kind, f AS name, 1 AS line_start, ln + 4 AS line_end FROM n
UNION ALL SELECT f, 'Function', 'show', ln, ln + 3 FROM n
UNION ALL SELECT f, 'CALLS', u, ln + 1, NULL FROM n, (SELECT unnest(['outer', 'middle', 'inner']) AS u)
UNION ALL SELECT f, 'CALLS', 'split', ln + 2, NULL FROM n""")
def script_strings(w: Workspace) -> DataFrame:
    """Whole documents as a template over lines and in a comment that holds another opening; only code around them counts."""
    whole = F.coalesce("text", F.lit(""))
    escaped = F.regexp_replace(whole, r"([\\`$])", r"\\$1")
    text = _c(
        "const page = `", escaped, "`;\n/* see /* ", F.regexp_replace(whole, r"\*/", "* /"), " */\nfunction show(x) {\n"
        "  outer(`a ${middle(`b } ${inner(x)} {`)} {`); // gone(\n  return x.split(/[/\"'`{]/g);\n}\n",
    )
    files = spread(w, "documents", "doc_id", "text").select(_c("web/d", F.col("doc_id"), ".js").alias("file_path"), text.alias("text"), F.lit("javascript").alias("language"))
    g = PL.build_from_files(files)
    calls = g.edges_of("CALLS").select(
        "file_path", "kind", F.col("target").alias("name"), F.col("line").alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    return g.nodes.select("file_path", "kind", "name", "line_start", "line_end").unionByName(calls)


@register("broken_sources", """
WITH p AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS z, 'gen/b' || p_partkey || '.py' AS f FROM part)
SELECT f AS source, 'File' AS kind, 'lines' AS target, 1 AS line, 13 AS line_end FROM p
UNION ALL SELECT f || '::first', 'Function', '(a, b=' || z || ')', 2, 2 FROM p
UNION ALL SELECT f || '::Box' || k, 'Class', NULL, 4, 9 FROM p
UNION ALL SELECT f || '::Box' || k || '.run', 'Function', '(self, n=' || z || ')', 5, 9 FROM p
UNION ALL SELECT f || '::helper', 'Function', '(n)', 10, 12 FROM p
UNION ALL SELECT f, 'IMPORTS_FROM', 'os', 1, NULL FROM p
UNION ALL SELECT f || '::Box' || k, 'INHERITS', 'Root', 4, NULL FROM p
UNION ALL SELECT f || '::first', 'CALLS', f || '::helper', 2, NULL FROM p
UNION ALL SELECT f || '::Box' || k || '.run', 'CALLS', f || '::helper', 8, NULL FROM p
UNION ALL SELECT f || '::helper', 'CALLS', 'str', 12, NULL FROM p
UNION ALL SELECT f, 'CONTAINS', f || '::' || u, l, NULL FROM p, (VALUES ('first', 2), ('helper', 10)) AS v(u, l)
UNION ALL SELECT f, 'CONTAINS', f || '::Box' || k, 4, NULL FROM p
UNION ALL SELECT f || '::Box' || k, 'CONTAINS', f || '::Box' || k || '.run', 5, NULL FROM p""")
def broken_sources(w: Workspace) -> DataFrame:
    """Python that does not parse, read by its indentation and marked."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = _c(
        "import os\ndef first(a, b=", size, "): return helper(a)\nx = = 1\nclass Box", k, "(Root):\n    def run(self, n=", size, "):\n        '''call fake(\n"
        "class Gone: '''\n        return helper([\n  n])  # dead(n\ndef helper(n):\n    # no(\n    return \"fake(\" + str(n)\n",
    )
    files = spread(w, "part", "p_partkey", "p_size").select(_c("gen/b", k, ".py").alias("file_path"), text.alias("text"), F.lit("python").alias("language"))
    g = PL.build_from_files(files)
    return g.nodes.select(
        F.col("qualified_name").alias("source"), "kind", F.coalesce("params", F.col("extra")["reader"]).alias("target"),
        F.col("line_start").alias("line"), "line_end",
    ).unionByName(g.edges.select("source", "kind", "target", "line", F.lit(None).cast("int").alias("line_end")))


@register("lua_nodes", """
WITH p AS (SELECT s_suppkey AS k, 'game/u' || s_suppkey || '.lua' AS f, 'Box' || s_suppkey AS b FROM supplier)
SELECT f AS source, 'IMPORTS_FROM' AS kind, 'base.m' || k AS target, 1 AS line FROM p
UNION ALL SELECT f || '::' || b, 'CONTAINS', f || '::' || b || '.area', 5 FROM p
UNION ALL SELECT f || '::' || b, 'CONTAINS', f || '::' || b || '.run', 10 FROM p
UNION ALL SELECT f, 'CONTAINS', f || '::tidy', 13 FROM p
UNION ALL SELECT f || '::' || b || '.area', 'CALLS', 'grow', 6 FROM p
UNION ALL SELECT f || '::' || b || '.run', 'CALLS', f || '::' || b || '.area', 11 FROM p
UNION ALL SELECT f || '::tidy', 'CALLS', f || '::' || b || '.run', 13 FROM p""")
def lua_nodes(w: Workspace) -> DataFrame:
    """Functions of Lua tables, with long comments and long strings around them."""
    k = F.col("s_suppkey")
    text = _c(
        "local M = require(\"base.m", k, "\")\n--[==[ one ]]\nfunction gone() lost() end ]==]\nlocal Box", k, " = {}\nfunction Box", k,
        ".area(x)\n  if x then grow(x, [[ end (\n  end fake( ]]) end\n  return x -- shrink(x)\nend\nfunction Box", k,
        ":run()\n  return self:area('end')\nend\nlocal tidy = function(n) return Box", k, ":run(n) end\n",
    )
    files = spread(w, "supplier", "s_suppkey").select(_c("game/u", k, ".lua").alias("file_path"), text.alias("text"), F.lit("lua").alias("language"))
    return PL.build_from_files(files).edges.select("source", "kind", "target", "line")


def notebooks(w: Workspace) -> DataFrame:
    """One notebook per conversation; roles become SQL, Python and text cells."""
    t = F.col("turn")
    source = (
        F.when(F.col("role") == "user", _c("%sql\nSELECT * FROM t", t, " JOIN `a b`.u", t))
        .when(F.col("role") == "assistant", _c("!pip install x\ndef f", t, "():\n    return g()\n"))
        .otherwise("%md\nnotes")
    )
    cell = F.struct(F.lit("code").alias("cell_type"), source.alias("source"))
    grouped = w.table("conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    meta = F.struct(F.struct(F.lit("Python").alias("language")).alias("kernelspec"))
    return grouped.select(
        _c("nb/", F.col("conv_id"), ".ipynb").alias("file_path"),
        F.to_json(F.struct(meta.alias("metadata"), "cells")).alias("text"), F.lit("notebook").alias("language"))


@register("notebook_cells", """
SELECT 'nb/' || conv_id || '.ipynb' AS file_path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INTEGER) AS cell_index,
 CASE role WHEN 'user' THEN 'sql' ELSE 'python' END AS language,
 CASE role WHEN 'user' THEN 'SELECT * FROM t' || turn || ' JOIN `a b`.u' || turn ELSE 'def f' || turn || '():' || chr(10) || '    return g()' || chr(10) END AS source
FROM conversations QUALIFY role <> 'system'""")
def notebook_cells(w: Workspace) -> DataFrame:
    return NB.notebook_cells(notebooks(w))


@register("table_lineage", """
SELECT 'nb/' || conv_id || '.ipynb' AS source, target FROM (SELECT conv_id, unnest(['t' || turn, 'a b.u' || turn]) AS target FROM conversations WHERE role = 'user')""")
def table_lineage(w: Workspace) -> DataFrame:
    return NB.table_lineage(NB.notebook_cells(notebooks(w))).select("source", "target")


@register("cell_offsets", """
WITH c AS (SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INTEGER) AS cell_index FROM conversations)
SELECT 'nb/' || conv_id || '.ipynb' AS file_path, cell_index, CAST(3 * (row_number() OVER (PARTITION BY conv_id ORDER BY cell_index) - 1) + 1 AS INTEGER) AS first_line,
 CAST(3 * (row_number() OVER (PARTITION BY conv_id ORDER BY cell_index) - 1) + 2 AS INTEGER) AS last_line FROM c WHERE role = 'assistant'""")
def cell_offsets(w: Workspace) -> DataFrame:
    return NB.cell_offsets(NB.notebook_cells(notebooks(w))).select("file_path", "cell_index", "first_line", "last_line")


@register("notebook_functions", """
WITH c AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INTEGER) AS cell_index FROM conversations)
SELECT 'nb/' || conv_id || '.ipynb::f' || turn AS qualified_name, cell_index FROM c WHERE role = 'assistant'""")
def notebook_functions(w: Workspace) -> DataFrame:
    files = notebooks(w)
    nodes = PL.build_from_files(files).nodes.where("kind <> 'File'")
    return NB.tag_cells(nodes, NB.cell_offsets(NB.notebook_cells(files))).select("qualified_name", "cell_index")


# --- texts -------------------------------------------------------------------


@register("diff_ranges", graph("""
SELECT file_path, start, CASE WHEN (stop - start) % 7 = 0 THEN start ELSE stop END AS stop FROM changed_ranges"""))
def diff_ranges(w: Workspace) -> DataFrame:
    """Ranges printed as a zero-context diff per file and parsed back."""
    width = F.col("end") - F.col("start")
    count = F.when(width % 7 == 0, F.when(width % 2 == 0, "").otherwise(",0")).otherwise(_c(",", width + 1))
    hunk = _c("@@ -1,2 +", F.col("start"), count, " @@ def x")
    texts = w.changed_ranges.groupBy("file_path").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("start", "end", hunk.alias("h"))))["h"], "\n+x\n").alias("hunks")
    ).select(F.col("file_path").alias("diff_id"), _c("diff --git\n--- a/x\n+++ b/", F.col("file_path"), "\n", F.col("hunks"), "\n+x").alias("text"))
    return parse_unified_diff(texts).select("file_path", "start", F.col("end").alias("stop"))


@register("source_lines", r"""
SELECT doc_id, array_to_string((regexp_split_to_array(text, '\r\n|\r|\n'))[2:4], chr(10)) AS chunk FROM documents""")
def source_lines(w: Workspace) -> DataFrame:
    return w.table("documents").select("doc_id", line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("chunk"))


@register("docs_sections", """
WITH d AS (SELECT doc_id, trim(regexp_extract(text || '</section>', '(?s)^(.*?)</[sS][eE][cC][tT][iI][oO][nN]>', 1), chr(32)) AS body FROM documents)
SELECT doc_id, sha256(body) AS body_hash, length(body) AS chars FROM d""")
def docs_sections(w: Workspace) -> DataFrame:
    """A section of a page around every document; it ends at its first closing tag, also one inside the text."""
    page = _c('<section name="other">no</section>\n<SECTION NAME="usage">', F.col("text"), "</section><section name=\"end\">x</section>")
    body = doc_section(page, "usage")
    return w.table("documents").select(
        "doc_id", F.sha2(body, 256).alias("body_hash"), F.length(body).cast("bigint").alias("chars"))


@register("content_hashes", "SELECT doc_id, sha256(text) AS file_hash, substr(sha256(text), 1, 16) AS short_hash, length(text) // 4 AS tokens FROM documents")
def content_hashes(w: Workspace) -> DataFrame:
    t = F.col("text")
    return w.table("documents").select(
        "doc_id", F.sha2(t, 256).alias("file_hash"), X.content_hash(t).alias("short_hash"), F.floor(F.length(t) / 4).cast("bigint").alias("tokens"))


@register("files_to_parse", "SELECT 'd' || doc_id || '.py' AS file_path FROM documents WHERE length(text) % 2 = 1")
def files_to_parse(w: Workspace) -> DataFrame:
    docs = w.table("documents")
    path = _c("d", F.col("doc_id"), ".py").alias("file_path")
    now = docs.select(path, F.sha2("text", 256).alias("file_hash"))
    before = docs.select(path, F.sha2(F.when(F.length("text") % 2 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("file_hash"))
    return FI.files_to_parse(now, before).select("file_path")


@register("stale_files", "SELECT 'd' || doc_id || '.py' AS file_path FROM documents WHERE lang = 'fr'")
def stale_files(w: Workspace) -> DataFrame:
    docs = w.table("documents").select(_c("d", F.col("doc_id"), ".py").alias("file_path"), "lang")
    return FI.stale_files(docs, docs.where("lang <> 'fr'"))


# --- scanner and rule documents ----------------------------------------------


@register("scanner_reports", over(FINDINGS, sql="""
SELECT seq AS report_id, rule_id, file_path, line_start, CASE WHEN seq % 3 = 0 THEN line_start ELSE line_end END AS line_end, cwe, severity, 'saw ' || seq AS message FROM raw"""))
def scanner_reports(w: Workspace) -> DataFrame:
    cwe = F.when(F.col("seq") % 2 == 0, F.to_json(F.array("cwe"))).otherwise(_c('"', F.col("cwe"), '"'))
    end = F.when(F.col("seq") % 3 == 0, "").otherwise(_c('"end":{"line":', F.col("line_end"), "},"))
    severity = F.coalesce(_c('"severity":"', F.col("severity"), '",'), F.lit(""))
    text = _c(
        '{"results":[{"check_id":"', F.col("rule_id"), '","path":"', F.col("file_path"), '","start":{"line":', F.col("line_start"), "},", end,
        '"extra":{', severity, '"message":"saw ', F.col("seq"), '","lines":" code ","metadata":{"cwe":', cwe, "}}}]}")
    return SC.scanner_findings(w.findings.select(F.col("seq").alias("report_id"), text.alias("text"))).select(
        "report_id", "rule_id", "file_path", "line_start", "line_end", "cwe", "severity", "message")


@register("custom_rules", """
WITH s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part)
SELECT n || '-sink-' || a AS id, a || '_' || n AS qualified_pattern, 'SINK' AS sig_type, n AS vuln_class_id FROM s
UNION ALL SELECT 'src-' || a || '-' || n, a || '.' || n, 'SOURCE', n FROM s""")
def custom_rules(w: Workspace) -> DataFrame:
    a, n = F.split("p_name", " ")[0].alias("a"), F.split("p_name", " ")[1].alias("n")
    sig = w.table("part").select(a, n).distinct()
    doc = sig.groupBy("n").agg(
        F.collect_list(F.struct(F.col("a").alias("name"), _c(F.col("a"), "_", F.col("n")).alias("qualified_pattern"))).alias("sinks"),
        F.collect_list(F.struct(_c("src-", F.col("a"), "-", F.col("n")).alias("id"), _c(F.col("a"), ".", F.col("n")).alias("qualified_pattern"))).alias("sources"),
    ).select(F.to_json(F.array(F.struct(F.col("n").alias("id"), F.col("n").alias("name"), "sinks", "sources"))).alias("text"), F.lit(1).alias("seq"))
    return SC.custom_rules(doc)["signatures"].select("id", "qualified_pattern", "sig_type", "vuln_class_id")


@register("registry_rules", """
SELECT 'semgrep-python.sql-check-' || s_suppkey AS id, 'CWE-' || (s_suppkey % 100) AS cwe_id, CASE WHEN s_suppkey % 100 IN (89, 78, 94) THEN 'CRITICAL' WHEN s_suppkey % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 'go' AS language, 'A03' AS owasp_cat, 'Sql Check ' || s_suppkey || ' (CWE-' || (s_suppkey % 100) || ')' AS name FROM supplier WHERE s_suppkey % 3 <> 0""")
def registry_rules(w: Workspace) -> DataFrame:
    k = F.col("s_suppkey")
    rule = _c(
        '{"rules":[{"id":"python.sql-check-', k, '","message":"m"', F.when(k % 2 == 0, ',"severity":"ERROR"').otherwise(""),
        ',"languages":["go","java"],"metadata":{', F.when(k % 3 != 0, _c('"cwe":["CWE-', k % 100, ': x"],')).otherwise(""), '"owasp":["A03:2021"]}}]}')
    return SC.registry_rules(w.table("supplier").select(rule.alias("text"), k.alias("seq")))["classes"].select(
        "id", "cwe_id", "severity", "language", "owasp_cat", "name")


@register("catalogue_signatures", """
WITH s AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS n, p_name FROM part), r AS (SELECT n, p_name, row_number() OVER (PARTITION BY n ORDER BY p_name) AS i FROM s)
SELECT n || '-sink-' || lpad(CAST(i AS VARCHAR), 3, '0') AS id, p_name AS qualified_pattern, 'SINK' AS sig_type FROM r""")
def catalogue_signatures(w: Workspace) -> DataFrame:
    names = w.table("part").select(F.split("p_name", " ")[1].alias("class_id"), F.col("p_name").alias("pattern")).distinct()
    rows = O.rank_rows(names, ["class_id"], ["pattern"], "position").select(
        "class_id", F.lit("SINK").alias("role"), (F.col("position") + 1).alias("position"), "pattern")
    return SC.catalogue_signatures(rows).select("id", "qualified_pattern", "sig_type")


@register("repositories", """
SELECT 'repo/' || n_name AS path, r_name || '-' || n_nationkey AS alias FROM nation JOIN region ON r_regionkey = n_regionkey""")
def repositories(w: Workspace) -> DataFrame:
    one = F.struct(_c("repo/", F.col("n_name")).alias("path"), _c(F.col("r_name"), "-", F.col("n_nationkey")).alias("alias"))
    docs = w.table("nation").join(w.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(
        F.concat(F.collect_list(one), F.collect_list(F.struct(one["path"].alias("path"), F.lit("later").alias("alias")))).alias("repos"))
    return FI.repositories(w.spark, docs.select(F.to_json(F.struct("repos")).alias("text")))


# --- sinks -------------------------------------------------------------------


@register("node_upsert", graph("""
SELECT qualified_name, CASE WHEN kind = 'Class' THEN '(v2)' ELSE params END AS params, kind, 'sig' AS signature FROM nodes
UNION ALL SELECT 'new/' || p_partkey, '(v1)', 'Function', NULL FROM part WHERE p_size = 7"""))
def node_upsert(w: Workspace) -> DataFrame:
    stored = w.graph.nodes.withColumn("signature", F.lit("sig"))
    again = w.graph.nodes_of("Class")
    first = again.withColumn("params", F.lit("(v1)")).withColumn("seq", F.lit(1))
    second = again.withColumn("params", F.lit("(v2)")).withColumn("seq", F.lit(2))
    fresh = w.table("part").where("p_size = 7").select(
        _c("new/", F.col("p_partkey")).alias("qualified_name"), F.lit("(v1)").alias("params"), F.lit("Function").alias("kind"), F.lit(3).alias("seq"))
    incoming = first.unionByName(second).unionByName(fresh, allowMissingColumns=True)
    return ST.upsert_nodes(stored, incoming).select("qualified_name", "params", "kind", "signature")


@register("edge_upsert", graph("""
SELECT kind, source, target, file_path, line FROM edges UNION SELECT kind, source, target, file_path, line + 1 FROM edges WHERE kind = 'CALLS'"""))
def edge_upsert(w: Workspace) -> DataFrame:
    again = w.graph.edges_of("CALLS")
    moved = again.withColumn("line", (F.col("line") + 1).cast("int"))
    return ST.upsert_edges(w.graph.edges, again.unionByName(moved))


@register("replace_by_file", graph("""
SELECT qualified_name FROM nodes WHERE file_path NOT IN (SELECT file_path FROM changed_files)
UNION ALL SELECT qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files) AND kind IN ('File', 'Class')"""))
def replace_by_file(w: Workspace) -> DataFrame:
    g = w.graph
    kept = g.nodes.join(w.changed_files, "file_path", "left_semi").where(F.col("kind").isin("File", "Class")).select(*g.nodes.columns)
    return ST.replace_files(g, w.changed_files, kept, g.edges.limit(0)).nodes.select("qualified_name")


# Changed files keep their files and classes, a line further down, and their calls; the store keeps both versions.
_REPLACED = graph("""
WITH n1 AS (SELECT qualified_name, file_path, line_start FROM nodes),
n2 AS (SELECT * FROM n1 WHERE file_path NOT IN (SELECT file_path FROM changed_files)
  UNION ALL SELECT qualified_name, file_path, CAST(line_start + 1 AS INTEGER) FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files) AND kind IN ('File', 'Class')),
e1 AS (SELECT kind || ' ' || source || ' ' || target AS name, file_path, line FROM edges),
e2 AS (SELECT * FROM e1 WHERE file_path NOT IN (SELECT file_path FROM changed_files)
  UNION ALL SELECT kind || ' ' || source || ' ' || target, file_path, CAST(line + 1 AS INTEGER) FROM edges WHERE file_path IN (SELECT file_path FROM changed_files) AND kind = 'CALLS'),
a AS (SELECT 1 AS version, 'nodes' AS part, * FROM n1 UNION ALL SELECT 2, 'nodes', * FROM n2 UNION ALL SELECT 1, 'edges', * FROM e1 UNION ALL SELECT 2, 'edges', * FROM e2)
SELECT version, part, file_path, count(*) AS rows, md5(string_agg(qualified_name || ' ' || line_start, ',' ORDER BY qualified_name || ' ' || line_start)) AS content FROM a GROUP BY 1, 2, 3""")


@register("stored_replace", _REPLACED)
def stored_replace(w: Workspace) -> DataFrame:
    """The commerce graph stored, its changed files replaced, and both versions read again."""
    g, path = w.graph, f"{stage_root(w.spark)}/{uuid.uuid4().hex}/graph"
    ST.write_graph(g, path)
    own = lambda df: df.join(w.changed_files, "file_path", "left_semi")
    nodes = own(g.nodes).where(F.col("kind").isin("File", "Class")).withColumn("line_start", (F.col("line_start") + 1).cast("int")).select(*g.nodes.columns)
    edges = own(g.edges).where("kind = 'CALLS'").withColumn("line", (F.col("line") + 1).cast("int"))
    ST.replace_files_at(w.spark, path, w.changed_files, nodes, edges)
    rows = None
    for version in (1, 2):
        at = ST.read_graph(w.spark, path, version)
        named = (at.nodes.select(F.lit("nodes").alias("part"), "file_path", _c(F.col("qualified_name"), " ", F.col("line_start")).alias("row")),
                 at.edges.select(F.lit("edges").alias("part"), "file_path", _c(F.col("kind"), " ", F.col("source"), " ", F.col("target"), " ", F.col("line")).alias("row")))
        for part in named:
            part = part.withColumn("version", F.lit(version))
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("version", "part", "file_path").agg(
        F.count("*").alias("rows"), F.md5(F.array_join(F.array_sort(F.collect_list("row")), ",")).alias("content"))


def _hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2("text", 256))


def _edited(files: DataFrame, went: bool = True) -> DataFrame:
    """The tree after a change: every third module gains a function, one in thirty is deleted."""
    k = F.regexp_extract("file_path", "([0-9]+)", 1).try_cast("bigint")
    more = _c("\ndef extra_", k, "():\n    helper_", k, "(1)\n")
    out = files.withColumn("text", F.when(k % 3 == 0, F.concat("text", more)).otherwise(F.col("text")))
    return out.where(k % 30 != 7) if went else out


_EDITED = PY + """,
left_p AS (SELECT * FROM p WHERE k % 30 <> 7), more AS (SELECT * FROM p WHERE k % 3 = 0),
new_nodes AS (
  SELECT kind, qualified_name, line_start, CAST(CASE WHEN kind = 'File' AND more.f IS NOT NULL THEN 20 ELSE line_end END AS INTEGER) AS line_end
  FROM py_nodes JOIN left_p ON left_p.f = split_part(qualified_name, '::', 1) LEFT JOIN more ON more.f = left_p.f
  UNION ALL SELECT 'Function', f || '::extra_' || k, 18, 19 FROM more),
new_edges AS (
  SELECT kind, source, target, line FROM py_edges JOIN left_p ON left_p.f = split_part(source, '::', 1)
  UNION ALL SELECT 'CONTAINS', f, f || '::extra_' || k, 18 FROM more
  UNION ALL SELECT 'CALLS', f || '::extra_' || k, f || '::helper_' || k, 19 FROM more),
new_all AS (
  SELECT kind, qualified_name AS name, '' AS target, line_start AS line, line_end FROM new_nodes
  UNION ALL SELECT kind, source, target, line, NULL FROM new_edges)
"""


def _all_rows(g) -> DataFrame:
    nodes = g.nodes.select("kind", F.col("qualified_name").alias("name"), F.lit("").alias("target"), F.col("line_start").alias("line"), "line_end")
    return nodes.unionByName(g.edges.select("kind", F.col("source").alias("name"), "target", "line", F.lit(None).cast("int").alias("line_end")))


@register("incremental_update", over(_EDITED, sql="SELECT * FROM new_all"))
def incremental_update(w: Workspace) -> DataFrame:
    """A stored tree of modules after an edit: only what changed or depends on it is read again."""
    path = f"{stage_root(w.spark)}/{uuid.uuid4().hex}/graph"
    before = _hashed(stage(python_files(w), "tree"))
    after = _hashed(_edited(before.drop("file_hash")))
    ST.write_graph(PL.build_from_files(before), path, hashes=before)
    changed = before.join(after, ["file_path", "file_hash"], "left_anti").select("file_path")
    PL.update_stored(w.spark, path, after, changed)
    return _all_rows(ST.read_graph(w.spark, path))


@register("watch_replay", over(_EDITED, sql="SELECT CAST(2 AS BIGINT) AS version, * FROM new_all"))
def watch_replay(w: Workspace) -> DataFrame:
    """File events as a stream into a stored graph; its batch, sent once more with other content, changes nothing."""
    root = f"{stage_root(w.spark)}/{uuid.uuid4().hex}"
    before = stage(python_files(w), "tree")
    ST.write_graph(PL.build_from_files(before), f"{root}/graph")
    k = F.regexp_extract("file_path", "([0-9]+)", 1).try_cast("bigint")
    last = _edited(before, went=False).where((k % 3 == 0) | (k % 30 == 7)).select(
        "file_path", F.when(k % 30 == 7, "deleted").otherwise("modified").alias("event"), F.lit("2024-01-01T00:00:09Z").alias("ts"),
        F.when(k % 30 != 7, F.col("text")).alias("text"))
    early = last.withColumn("ts", F.lit("2024-01-01T00:00:01Z")).withColumn("text", F.lit("def early():\n    pass\n")).withColumn("event", F.lit("modified"))
    early.unionByName(last).coalesce(1).write.json(f"{root}/events")
    WT.watch(WT.event_stream(w.spark, f"{root}/events"), f"{root}/graph", f"{root}/stream", once=True).awaitTermination()
    WT.apply_events(w.spark, f"{root}/graph", early.withColumn("ts", F.to_timestamp("ts")), ("watch", 0))
    now = VersionedTables(w.spark, f"{root}/graph").manifest()["version"]
    return _all_rows(ST.read_graph(w.spark, f"{root}/graph")).withColumn("version", F.lit(now).cast("bigint"))


@register("schema_upgrade", graph("SELECT qualified_name, CAST(NULL AS VARCHAR) AS signature, CAST(NULL AS VARCHAR) AS community_id FROM nodes"))
def schema_upgrade(w: Workspace) -> DataFrame:
    columns = {"signature": "string", "community_id": "string", "kind": "string"}
    return ST.upgrade(ST.upgrade(w.graph.nodes, columns), columns).select("qualified_name", "signature", "community_id")


@register("node_communities", graph("SELECT n.qualified_name, f.community_id FROM nodes n LEFT JOIN file_members f USING (qualified_name)"))
def node_communities(w: Workspace) -> DataFrame:
    return ST.assign_communities(w.graph.nodes, w.file_members).select("qualified_name", "community_id")


@register("stored_flow_paths", flow("SELECT root, position // 10000 AS chunk, string_agg(node, ' > ' ORDER BY position) AS path FROM positioned GROUP BY 1, 2"))
def stored_flow_paths(w: Workspace) -> DataFrame:
    return ST.flow_paths(w.flow_members).select("root", "chunk", F.array_join("path", " > ").alias("path"))


def report(sql: str) -> str:
    return over(FINDINGS, HISTORY, VERDICTS, sql=sql)


def _titled(w: Workspace) -> DataFrame:
    return judged(w)


@register("report_summary", report("""
SELECT count(*) AS total, count(*) FILTER (NOT fp) AS active, count(*) FILTER (fp) AS false_positives, count(*) FILTER (NOT fp AND severity = 'CRITICAL') AS critical,
 count(*) FILTER (NOT fp AND severity = 'HIGH') AS high, count(*) FILTER (NOT fp AND severity = 'MEDIUM') AS medium, count(*) FILTER (NOT fp AND severity = 'LOW') AS low
FROM (SELECT *, coalesce(verdict = 'FALSE_POSITIVE', false) AS fp FROM judged)"""))
def report_summary(w: Workspace) -> DataFrame:
    return RP.json_summary(_titled(w))


@register("report_json", report("""
SELECT fingerprint, rule_id, severity, CAST(line_start AS BIGINT) AS line_start, substr(file_path, 6) AS file FROM judged"""))
def report_json(w: Workspace) -> DataFrame:
    j = RP.json_findings(_titled(w), "user")
    get = lambda k: F.get_json_object("json", f"$.{k}")
    return j.select("fingerprint", get("rule_id").alias("rule_id"), get("severity").alias("severity"),
                    get("line_start").cast("bigint").alias("line_start"), get("file").alias("file"))


LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'LOW' THEN 'note' ELSE 'warning' END"


@register("sarif_rules", report(f"""
SELECT rule_id AS id, arg_min({LEVEL}, (first_run, fingerprint)) AS level, arg_min(cwe, (first_run, fingerprint)) AS tag FROM judged WHERE coalesce(verdict, '') <> 'FALSE_POSITIVE' GROUP BY 1"""))
def sarif_rules(w: Workspace) -> DataFrame:
    return RP.sarif_rules(_titled(w), F.struct("first_run", "fingerprint")).select("id", "level", "tag")


@register("sarif_results", report(f"""
SELECT rule_id AS "ruleId", {LEVEL} AS level, file_path AS uri, CASE WHEN line_start = 0 THEN 1 ELSE line_start END AS "startLine",
 CASE WHEN line_end = 0 THEN 1 ELSE line_end END AS "endLine" FROM judged WHERE coalesce(verdict, '') <> 'FALSE_POSITIVE'"""))
def sarif_results(w: Workspace) -> DataFrame:
    return RP.sarif_results(_titled(w)).select("ruleId", "level", "uri", "startLine", "endLine")


@register("markdown_sections", report("""
SELECT fingerprint, CASE WHEN verdict = 'FALSE_POSITIVE' THEN 1 ELSE 0 END AS appendix, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS severity_order,
 true AS located, verdict IS NOT NULL AS judged FROM judged"""))
def markdown_sections(w: Workspace) -> DataFrame:
    md = F.col("markdown")
    return RP.markdown_sections(_titled(w)).select(
        "fingerprint", "appendix", "severity_order",
        F.contains(md, F.concat(F.lit("| **Location** | "), "file_path", F.lit(" line "), F.col("line_start").cast("string"), F.lit(" |"))).alias("located"),
        F.contains(md, F.lit("**Verdict**")).alias("judged"))


@register("wiki_pages", graph("SELECT DISTINCT community_id, 'generated' AS state FROM file_members"))
def wiki_pages(w: Workspace) -> DataFrame:
    pages = _pages(w)
    nothing = pages.select("community_id", F.lit("").alias("page_hash")).limit(0)
    return RP.page_changes(pages, nothing).select("community_id", "state")


@register("wiki_refresh", graph("SELECT DISTINCT community_id, CASE WHEN contains(community_id, 'promo') THEN 'updated' ELSE 'unchanged' END AS state FROM file_members"))
def wiki_refresh(w: Workspace) -> DataFrame:
    pages = _pages(w)
    stored = pages.select("community_id", F.sha2(F.when(F.col("community_id").contains("promo"), "old").otherwise(F.col("page")), 256).alias("page_hash"))
    return RP.page_changes(pages, stored).select("community_id", "state")


def _pages(w: Workspace) -> DataFrame:
    members = w.file_members.join(w.graph.nodes.select("qualified_name", "name", "kind", "file_path", "line_start"), "qualified_name")
    shown = C.top_per_key(members.where("kind <> 'File'"), ["community_id"], [F.asc("qualified_name")], 50).withColumn("position", F.col("qualified_name"))
    return RP.wiki_pages(
        C.community_table(w.graph, w.file_members), shown,
        C.community_flows(w.flows, w.flow_members, w.file_members), C.dependency_counts(w.graph, w.file_members))


# --- incremental and sessions ------------------------------------------------


def calls(w: Workspace) -> DataFrame:
    """Events as tool calls of a session per user."""
    kind = F.col("event_type")
    tool = (
        F.when(kind == "click", "query_graph").when(kind == "view", "list_flows").when(kind == "signup", "detect_changes")
        .when(kind == "purchase", "refactor").otherwise("semantic_search_nodes")
    )
    return w.table("events").select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("call_id"), tool.alias("tool"))


CALLS = """
calls AS MATERIALIZED (SELECT user_id AS session_id, ts, event_id AS call_id,
  CASE event_type WHEN 'click' THEN 'query_graph' WHEN 'view' THEN 'list_flows' WHEN 'signup' THEN 'detect_changes' WHEN 'purchase' THEN 'refactor' ELSE 'semantic_search_nodes' END AS tool FROM events)
"""
_FRAME = "OVER (PARTITION BY session_id ORDER BY ts, call_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


INTENT_SQL = over(CALLS, sql=f"""
WITH r AS (SELECT session_id, call_id, tool, count(*) FILTER (tool = 'detect_changes') {_FRAME} AS a, count(*) FILTER (tool IN ('query_graph', 'semantic_search_nodes')) {_FRAME} AS b,
 count(*) FILTER (tool = 'refactor') {_FRAME} AS c, count(*) FILTER (tool = 'list_flows') {_FRAME} AS d FROM calls)
SELECT session_id, call_id, tool, CASE WHEN greatest(a, b, c, d) = a THEN 'reviewing' WHEN greatest(a, b, c, d) = b THEN 'debugging' WHEN greatest(a, b, c, d) = c THEN 'refactoring' ELSE 'exploring' END AS intent FROM r""")


@register("session_intent", INTENT_SQL)
def session_intent(w: Workspace) -> DataFrame:
    return SS.session_intents(calls(w))


@register("session_intent_split", INTENT_SQL)
def session_intent_split(w: Workspace) -> DataFrame:
    """The same through the many-task path that serves hot sessions."""
    return SS.session_intents(calls(w), bound=20)


@register("next_steps", over(CALLS, sql="""
WITH wf(tool, next_tool, place) AS (VALUES ('query_graph', 'get_flow', 1), ('query_graph', 'list_flows', 2), ('list_flows', 'get_flow', 1), ('list_flows', 'refactor', 2),
 ('detect_changes', 'get_impact_radius', 1), ('refactor', 'query_graph', 1), ('refactor', 'find_dead_code', 2), ('semantic_search_nodes', 'get_flow', 1)),
rec AS (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, call_id DESC) <= 100),
l AS (SELECT session_id, arg_max(tool, (ts, call_id)) AS tool FROM rec GROUP BY 1)
SELECT l.session_id, l.tool, wf.next_tool, wf.place FROM l JOIN wf ON wf.tool = l.tool WHERE NOT EXISTS (SELECT 1 FROM rec WHERE rec.session_id = l.session_id AND rec.tool = wf.next_tool)"""))
def next_steps(w: Workspace) -> DataFrame:
    rows = [("query_graph", "get_flow", 1), ("query_graph", "list_flows", 2), ("list_flows", "get_flow", 1), ("list_flows", "refactor", 2),
            ("detect_changes", "get_impact_radius", 1), ("refactor", "query_graph", 1), ("refactor", "find_dead_code", 2),
            ("semantic_search_nodes", "get_flow", 1)]
    workflow = w.spark.createDataFrame(rows, "tool string, next_tool string, place int")
    return SS.next_steps(calls(w), workflow).select("session_id", "tool", "next_tool", "place")


@register("live_previews", "SELECT event_id AS refactor_id FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 600")
def live_previews(w: Workspace) -> DataFrame:
    previews = w.table("events").select(F.col("event_id").alias("refactor_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"))
    now = w.table("events").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("n")).first()["n"]
    return RF.live_previews(previews.withColumn("created_at", F.col("created_us")), now, 600_000_000).select("refactor_id")


@register("rename_apply", """
SELECT 'gen/p' || p_partkey || '.py' AS file_path, 16 AS lines_kept FROM part""")
def rename_apply(w: Workspace) -> DataFrame:
    """``helper_N`` renamed at its definition in every generated module."""
    files = python_files(w)
    name = F.concat(F.lit("helper_"), F.regexp_extract("file_path", r"p(\d+)\.py$", 1))
    edits = files.select(F.col("file_path").alias("file"), F.lit(10).alias("line"), name.alias("old"), F.concat(name, F.lit("_v2")).alias("new"))
    done = RF.apply_edits(files.select("file_path", "text"), edits).join(files.select("file_path", F.col("text").alias("before")), "file_path")
    now, old = F.split("text", "\n"), F.split("before", "\n")
    same = F.size(F.filter(F.zip_with(now, old, lambda a, b: a == b), lambda x: x))
    renamed = F.contains(F.element_at(now, 10), F.lit("_v2(x)"))
    return done.select("file_path", F.when(renamed, same).otherwise(-1).alias("lines_kept"))


@register("source_windows", r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS code, unnest(range(1, len(regexp_split_to_array(text, '\r\n|\r|\n')) + 1)) AS line FROM documents)
SELECT doc_id, CAST(line AS INTEGER) AS line, code, line BETWEEN 3 AND 4 AS highlight FROM l WHERE line BETWEEN 1 AND 6""")
def source_windows(w: Workspace) -> DataFrame:
    from codelattice.functions.text import source_window

    return w.table("documents").select("doc_id", F.explode(source_window(F.col("text"), 3, 4, 2)).alias("x")).select("doc_id", "x.*")
