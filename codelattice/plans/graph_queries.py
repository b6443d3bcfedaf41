"""Registered graph analyses: each a Spark plan with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions import paths as P
from codelattice.functions import text as X
from codelattice.operators import lookup as L
from codelattice.operators import refactor as RF
from codelattice.operators import relations as R
from codelattice.operators import resolve as RS
from codelattice.operators import risk as K
from codelattice.operators import summary as SM
from codelattice.operators import traversal as T
from codelattice.plans.oracle_base import ENTRY, graph
from codelattice.sources.commerce import Workspace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- lookups -----------------------------------------------------------------


@register("graph_nodes", graph("SELECT kind, name, qualified_name, file_path, line_start, line_end, language, parent_name, params, return_type, is_test FROM nodes"))
def graph_nodes(w: Workspace) -> DataFrame:
    return w.graph.nodes.drop("decorators", "extra")


@register("graph_edges", graph("SELECT kind, source, target, file_path, line FROM edges"))
def graph_edges(w: Workspace) -> DataFrame:
    return w.graph.edges


@register("nodes_in_changed_files", graph("SELECT qualified_name, kind, file_path FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files)"))
def nodes_in_changed_files(w: Workspace) -> DataFrame:
    return L.nodes_by_file(w.graph, w.changed_files).select("qualified_name", "kind", "file_path")


@register("nodes_by_kind", graph("SELECT qualified_name, kind FROM nodes WHERE kind IN ('Function', 'Class') AND file_path ILIKE '%small%'"))
def nodes_by_kind(w: Workspace) -> DataFrame:
    return L.nodes_by_kind(w.graph, ["Function", "Class"], "SMALL").select("qualified_name", "kind")


@register("large_functions", graph("""
SELECT qualified_name, kind, CAST(line_end - line_start + 1 AS BIGINT) AS line_count FROM nodes
WHERE line_start IS NOT NULL AND line_end IS NOT NULL AND line_end - line_start + 1 >= 40 AND kind = 'Function'"""))
def large_functions(w: Workspace) -> DataFrame:
    return L.nodes_by_size(w.graph, 40, kind="Function", limit=None).select("qualified_name", "kind", "line_count")


@register("largest_nodes_top50", graph("""
SELECT qualified_name, CAST(line_end - line_start + 1 AS BIGINT) AS line_count FROM nodes
WHERE line_end IS NOT NULL AND line_end - line_start + 1 >= 50 ORDER BY line_count DESC, qualified_name LIMIT 50"""))
def largest_nodes_top50(w: Workspace) -> DataFrame:
    return L.nodes_by_size(w.graph).select("qualified_name", "line_count")


@register("bare_call_edges", graph("SELECT source, target, file_path, line FROM edges WHERE kind = 'CALLS' AND NOT contains(target, '::')"))
def bare_call_edges(w: Workspace) -> DataFrame:
    return L.edges_by_bare_target(w.graph).select("source", "target", "file_path", "line")


@register("edges_among_changed", graph("""
WITH s AS (SELECT qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files))
SELECT kind, source, target, file_path, line FROM edges
WHERE source IN (SELECT qualified_name FROM s) AND target IN (SELECT qualified_name FROM s)"""))
def edges_among_changed(w: Workspace) -> DataFrame:
    return L.edges_among(w.graph, L.nodes_by_file(w.graph, w.changed_files)).select("kind", "source", "target", "file_path", "line")


@register("induced_subgraph_size", graph("""
WITH s AS (SELECT qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files))
SELECT (SELECT count(*) FROM s) AS node_count, (SELECT count(*) FROM edges
  WHERE source IN (SELECT qualified_name FROM s) AND target IN (SELECT qualified_name FROM s)) AS edge_count"""))
def induced_subgraph_size(w: Workspace) -> DataFrame:
    sub = L.subgraph(w.graph, L.nodes_by_file(w.graph, w.changed_files))
    return sub.nodes.agg(F.count("*").alias("node_count")).select("node_count", sub.edges.agg(F.count("*")).scalar().alias("edge_count"))


@register("keyword_nodes", graph("""
SELECT qualified_name, kind FROM nodes WHERE (name ILIKE '%red%' OR qualified_name ILIKE '%red%') AND (name ILIKE '%bolt%' OR qualified_name ILIKE '%bolt%')"""))
def keyword_nodes(w: Workspace) -> DataFrame:
    return L.search_nodes(w.graph, "Red BOLT", None).select("qualified_name", "kind")


@register("files_matching_suffix", graph("SELECT DISTINCT file_path FROM nodes WHERE file_path ILIKE '%/m1.py'"))
def files_matching_suffix(w: Workspace) -> DataFrame:
    return L.files_matching(w.graph, "/M1.py")


@register("all_files", graph("SELECT DISTINCT file_path FROM nodes WHERE kind = 'File'"))
def all_files(w: Workspace) -> DataFrame:
    return L.all_files(w.graph)


@register("call_targets", graph("SELECT DISTINCT target FROM edges WHERE kind = 'CALLS'"))
def call_targets(w: Workspace) -> DataFrame:
    return L.call_targets(w.graph)


@register("outgoing_targets", graph("""
SELECT target, count(*) AS n FROM edges WHERE source IN (SELECT qualified_name FROM nodes WHERE kind = 'Class') GROUP BY 1"""))
def outgoing_targets(w: Workspace) -> DataFrame:
    return L.outgoing_targets(w.graph, w.graph.nodes_of("Class")).groupBy("target").agg(F.count("*").alias("n"))


@register("incoming_sources", graph("""
SELECT source, count(*) AS n FROM edges WHERE target IN (SELECT qualified_name FROM nodes WHERE kind = 'Class') GROUP BY 1"""))
def incoming_sources(w: Workspace) -> DataFrame:
    return L.incoming_sources(w.graph, w.graph.nodes_of("Class")).groupBy("source").agg(F.count("*").alias("n"))


@register("node_page", graph("""
SELECT kind, file_path, line_start, qualified_name, (SELECT count(*) FROM nodes WHERE file_path ILIKE '%promo%') AS total
FROM nodes WHERE file_path ILIKE '%promo%' ORDER BY kind, file_path, line_start, qualified_name LIMIT 100 OFFSET 50"""))
def node_page(w: Workspace) -> DataFrame:
    page, total = L.list_nodes(w.graph, file_path="promo", offset=50)
    return page.select("kind", "file_path", "line_start", "qualified_name", total.scalar().alias("total"))


@register("edge_page", graph("""
SELECT kind, source, target, file_path, line, (SELECT count(*) FROM edges WHERE kind = 'CALLS') AS total
FROM edges WHERE kind = 'CALLS' ORDER BY kind, file_path, line, source, target LIMIT 100 OFFSET 20"""))
def edge_page(w: Workspace) -> DataFrame:
    page, total = L.list_edges(w.graph, "CALLS", offset=20)
    return page.select("kind", "source", "target", "file_path", "line", total.scalar().alias("total"))


@register("best_function", graph("""
SELECT name, qualified_name FROM nodes WHERE kind IN ('Function', 'Method') AND (name = 'new_ring' OR qualified_name = 'new_ring' OR qualified_name ILIKE '%new_ring%')
ORDER BY length(qualified_name), qualified_name LIMIT 1"""))
def best_function(w: Workspace) -> DataFrame:
    return L.best_function(w.graph, "new_ring").select("name", "qualified_name")


@register("file_symbols_fallback", graph("""
SELECT qualified_name, kind, line_start FROM nodes WHERE kind IN ('Function', 'Method', 'Class') AND file_path ILIKE '%m3.py%'"""))
def file_symbols_fallback(w: Workspace) -> DataFrame:
    return L.file_symbols(w.graph, "elsewhere/m3.py").select("qualified_name", "kind", "line_start")


@register("file_map", graph("""
SELECT split_part(file_path, '/', 3) AS base_name, qualified_name, kind, line_start, line_end FROM nodes WHERE kind IN ('Function', 'Class')"""))
def file_map(w: Workspace) -> DataFrame:
    return L.functions_by_file_name(w.graph).select("base_name", "qualified_name", "kind", "line_start", "line_end")


@register("resolve_target", graph("""
WITH hits AS (SELECT qualified_name FROM nodes WHERE name ILIKE '%red_ring%' OR qualified_name ILIKE '%red_ring%' ORDER BY qualified_name LIMIT 5)
SELECT qualified_name, CASE WHEN (SELECT count(*) FROM hits) = 1 THEN 'ok' ELSE 'ambiguous' END AS status, 3 AS stage FROM hits"""))
def resolve_target(w: Workspace) -> DataFrame:
    return L.resolve_target(w.graph, "red_ring", "src").select("qualified_name", "status", "stage")


@register("node_predicates", graph(rf"""
SELECT qualified_name, {ENTRY} AS entry_name, decorated AS framework_decorator,
  regexp_matches(file_path, 'test_.*\.py$|_test\.py$|\.test\.[jt]sx?$|\.spec\.[jt]sx?$|_test\.go$|tests?/|_test\.dart$|test[_-].*\.[rR]$|tests/testthat/|Test\.kt$|Test\.java$') AS test_file,
  regexp_matches(name, '^test_|^Test|_test$|\.test\.|\.spec\.|_spec$') AS test_function,
  regexp_matches(lower(name) || ' ' || lower(qualified_name), 'auth|login|password|token|session|crypt|secret|credential|permission|sql|query|execute|connect|socket|request|http|sanitize|validate|encrypt|decrypt|hash|sign|verify|admin|privilege') AS security,
  regexp_matches(lower(name), 'auth|login|password|token|session|crypt|secret|credential|permission|sql|execute') AS risk_index_security
FROM nodes"""))
def node_predicates(w: Workspace) -> DataFrame:
    return L.flag_predicates(w.graph)


@register("node_signatures", graph("""
SELECT qualified_name, CASE WHEN kind IN ('Function', 'Test') THEN 'def ' || name || '(' || coalesce(params, '') || ')' || CASE WHEN coalesce(return_type, '') <> '' THEN ' -> ' || return_type ELSE '' END
  WHEN kind = 'Class' THEN 'class ' || name ELSE name END AS signature FROM nodes"""))
def node_signatures(w: Workspace) -> DataFrame:
    c = F.col
    return w.graph.nodes.select("qualified_name", P.signature(c("kind"), c("name"), c("params"), c("return_type")).alias("signature"))


@register("slim_nodes", graph("SELECT kind, name, qualified_name, file_path, line_start, line_end, language FROM nodes"))
def slim_nodes(w: Workspace) -> DataFrame:
    return L.slim(w.graph.nodes).select("kind", "name", "qualified_name", "file_path", "line_start", "line_end", "language")


@register("identifier_words", graph(r"""
SELECT word, count(*) AS n FROM (
  SELECT unnest(list_filter(regexp_split_to_array(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '[_\-.\s]+'), lambda x: x <> '')) AS word FROM nodes WHERE kind <> 'File') GROUP BY 1"""))
def identifier_words(w: Workspace) -> DataFrame:
    return w.graph.nodes.where("kind <> 'File'").select(F.explode(X.split_identifier(F.col("name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("name_slugs", graph(r"""
SELECT qualified_name, substr(regexp_replace(regexp_replace(lower(qualified_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) AS slug FROM nodes"""))
def name_slugs(w: Workspace) -> DataFrame:
    return w.graph.nodes.select("qualified_name", X.slug(F.col("qualified_name")).alias("slug"))


@register("path_languages", graph("""
SELECT file_path, 'python' AS language, 'python' AS rule_language, substr(file_path, 5) AS relative_path FROM nodes WHERE kind = 'File'"""))
def path_languages(w: Workspace) -> DataFrame:
    p = F.col("file_path")
    return L.all_files(w.graph).select(
        "file_path", P.language_of(p).alias("language"), P.rule_language_of(p).alias("rule_language"),
        P.relative_to(p, "src").alias("relative_path"))


# --- joins -------------------------------------------------------------------


@register("callers_like", graph("""
SELECT DISTINCT e.source AS qualified_name, n.file_path, n.line_start FROM edges e LEFT JOIN nodes n ON n.qualified_name = e.source
WHERE e.kind = 'CALLS' AND (e.target = 'ring' OR e.target ILIKE '%ring%')"""))
def callers_like(w: Workspace) -> DataFrame:
    return R.callers_like(w.graph, "ring", None)


@register("callees_like", graph("""
SELECT DISTINCT e.target AS qualified_name, n.file_path, n.line_start FROM edges e LEFT JOIN nodes n ON n.qualified_name = e.target
WHERE e.kind = 'CALLS' AND (e.source = 'bolt' OR e.source ILIKE '%bolt%')"""))
def callees_like(w: Workspace) -> DataFrame:
    return R.callees_like(w.graph, "bolt", None)


@register("callers_of", graph("""
WITH alive AS (SELECT source, target, line FROM edges WHERE kind = 'CALLS' AND source IN (SELECT qualified_name FROM nodes)),
direct AS (SELECT n.qualified_name, a.source, a.line AS call_line, 'qualified' AS matched_by FROM nodes n JOIN alive a ON a.target = n.qualified_name)
SELECT * FROM direct UNION ALL
SELECT n.qualified_name, a.source, a.line, 'bare' FROM nodes n JOIN alive a ON a.target = n.name AND n.name <> n.qualified_name
WHERE n.qualified_name NOT IN (SELECT qualified_name FROM direct)"""))
def callers_of(w: Workspace) -> DataFrame:
    return R.callers_of(w.graph, w.graph.nodes)


@register("callees_of", graph("""
SELECT e.source, e.target, e.line AS call_line, n.kind AS node_kind FROM edges e JOIN nodes n ON n.qualified_name = e.target WHERE e.kind = 'CALLS'
AND e.source IN (SELECT qualified_name FROM nodes)"""))
def callees_of(w: Workspace) -> DataFrame:
    return R.callees_of(w.graph, w.graph.nodes)


@register("imports_of", graph("SELECT source, target AS import_target, line FROM edges WHERE kind = 'IMPORTS_FROM' AND source IN (SELECT qualified_name FROM nodes)"))
def imports_of(w: Workspace) -> DataFrame:
    return R.imports_of(w.graph, w.graph.nodes)


@register("importers_of", graph("SELECT target AS imported, source AS importer, file_path AS file, line FROM edges WHERE kind = 'IMPORTS_FROM' AND target IN (SELECT file_path FROM nodes)"))
def importers_of(w: Workspace) -> DataFrame:
    return R.importers_of(w.graph, w.graph.nodes)


@register("children_of", graph("SELECT e.source, e.target AS child, n.kind AS child_kind FROM edges e JOIN nodes n ON n.qualified_name = e.target WHERE e.kind = 'CONTAINS'"))
def children_of(w: Workspace) -> DataFrame:
    return R.children_of(w.graph, w.graph.nodes)


@register("inheritors_of", graph("""
SELECT e.target AS base, e.source AS child, n.kind AS node_kind FROM edges e JOIN nodes n ON n.qualified_name = e.source
WHERE e.kind IN ('INHERITS', 'IMPLEMENTS') AND e.target IN (SELECT name FROM nodes WHERE kind = 'Class')"""))
def inheritors_of(w: Workspace) -> DataFrame:
    return R.inheritors_of(w.graph, w.graph.nodes_of("Class").select(F.col("name").alias("base")))


@register("tests_for", graph("""
SELECT e.target AS qualified_name, e.source AS test FROM edges e JOIN nodes n ON n.qualified_name = e.source WHERE e.kind = 'TESTED_BY'
UNION
SELECT n.qualified_name, t.qualified_name FROM nodes n JOIN nodes t ON t.is_test
 AND (contains(lower(t.qualified_name), 'test_' || lower(n.name)) OR contains(lower(t.qualified_name), 'test' || lower(n.name)))"""))
def tests_for(w: Workspace) -> DataFrame:
    return R.tests_for(w.graph, w.graph.nodes)


@register("tests_for_outgoing", graph("SELECT DISTINCT e.source AS qualified_name, e.target AS test FROM edges e JOIN nodes n ON n.qualified_name = e.target WHERE e.kind = 'TESTED_BY' AND e.source IN (SELECT qualified_name FROM nodes)"))
def tests_for_outgoing(w: Workspace) -> DataFrame:
    return R.tests_by_edge(w.graph, w.graph.nodes, "outgoing")


@register("uncalled_functions", graph("""
SELECT kind, name, qualified_name, file_path, line_start, language FROM nodes n WHERE kind IN ('Function', 'Method')
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target = n.qualified_name)"""))
def uncalled_functions(w: Workspace) -> DataFrame:
    return R.uncalled_functions(w.graph, None)


@register("entry_points", graph(f"""
SELECT qualified_name, kind FROM nodes n WHERE kind IN ('Function', 'Test')
AND ({ENTRY} OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target = n.qualified_name))"""))
def entry_points(w: Workspace) -> DataFrame:
    return R.entry_points(w.graph).select("qualified_name", "kind")


@register("entry_points_decorated", graph(f"""
SELECT qualified_name, kind FROM nodes n WHERE kind IN ('Function', 'Test')
AND (decorated OR {ENTRY} OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target = n.qualified_name))"""))
def entry_points_decorated(w: Workspace) -> DataFrame:
    return R.entry_points(w.graph, decorators=True).select("qualified_name", "kind")


@register("dead_code", graph(f"""
SELECT name, qualified_name, kind, file_path AS file, line_start AS line FROM nodes n
WHERE kind IN ('Function', 'Class') AND NOT is_test AND NOT {ENTRY}
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind IN ('CALLS', 'TESTED_BY', 'IMPORTS_FROM') AND e.target = n.qualified_name)"""))
def dead_code(w: Workspace) -> DataFrame:
    return R.dead_code(w.graph)


@register("diff_overlap", graph("""
SELECT DISTINCT n.qualified_name, n.kind FROM nodes n JOIN changed_ranges r ON r.file_path = n.file_path
WHERE n.line_start IS NOT NULL AND n.line_end IS NOT NULL AND n.line_start <= r.stop AND n.line_end >= r.start"""))
def diff_overlap(w: Workspace) -> DataFrame:
    return w.overlapping.select("qualified_name", "kind")


@register("diff_overlap_suffix", graph("""
SELECT DISTINCT n.qualified_name, n.kind FROM nodes n JOIN changed_ranges r ON n.file_path ILIKE '%' || substr(r.file_path, 4)
WHERE n.line_start IS NOT NULL AND n.line_end IS NOT NULL AND n.line_start <= r.stop AND n.line_end >= r.start"""))
def diff_overlap_suffix(w: Workspace) -> DataFrame:
    ranges = w.changed_ranges.withColumn("file_path", F.substring("file_path", 4, 10000))
    return K.overlapping_nodes(w.graph, ranges).select("qualified_name", "kind")


@register("test_gaps", graph("""
WITH c AS (SELECT DISTINCT n.* FROM nodes n JOIN changed_ranges r ON r.file_path = n.file_path AND n.line_start <= r.stop AND n.line_end >= r.start)
SELECT name, qualified_name, file_path AS file, line_start, line_end FROM c WHERE kind IN ('Function', 'Test', 'Class') AND NOT is_test
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'TESTED_BY' AND e.target = c.qualified_name)"""))
def test_gaps(w: Workspace) -> DataFrame:
    return R.test_gaps(w.graph, w.overlapping)


@register("symbol_resolution", graph("""
WITH defs AS (SELECT file_path, name, arg_min(qualified_name, (line_start, qualified_name)) AS local FROM nodes WHERE kind IN ('Function', 'Class', 'Test') GROUP BY 1, 2)
SELECT e.kind, e.source, CASE WHEN e.kind = 'CALLS' AND NOT contains(e.target, '::') AND d.local IS NOT NULL THEN d.local ELSE e.target END AS target, e.file_path, e.line
FROM edges e LEFT JOIN defs d ON d.file_path = e.file_path AND d.name = e.target"""))
def symbol_resolution(w: Workspace) -> DataFrame:
    return RS.resolve_same_file(w.graph.nodes, w.graph.edges)


@register("module_resolution", graph("""
WITH imp AS (SELECT DISTINCT file_path, replace(replace(substr(target, 5), '.py', ''), '/', '.') AS module FROM edges
  WHERE kind = 'IMPORTS_FROM' AND NOT contains(target, '::'))
SELECT file_path, module, CASE WHEN 'src/' || replace(module, '.', '/') || '.py' IN (SELECT file_path FROM nodes) THEN 'src/' || replace(module, '.', '/') || '.py' END AS resolved FROM imp"""))
def module_resolution(w: Workspace) -> DataFrame:
    dotted = F.replace(F.replace(F.substring("target", 5, 10000), F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))
    imports = w.graph.edges_of("IMPORTS_FROM").where(~F.col("target").contains("::")).select(
        "file_path", dotted.alias("module"), F.lit("python").alias("language"))
    return RS.resolve_modules(imports, L.all_files(w.graph)).select("file_path", "module", "resolved")


@register("alias_resolution", graph("""
WITH imp AS (SELECT DISTINCT file_path, '@' || split_part(target, '/', 2) || '/' || replace(split_part(target, '/', 3), '.py', '') AS module, target FROM edges
  WHERE kind = 'IMPORTS_FROM' AND NOT contains(target, '::'))
SELECT file_path, module, target AS resolved FROM imp"""))
def alias_resolution(w: Workspace) -> DataFrame:
    files = L.all_files(w.graph)
    imports = w.graph.edges_of("IMPORTS_FROM").where(~F.col("target").contains("::")).select(
        "file_path",
        F.concat(F.lit("@"), F.split("target", "/")[1], F.lit("/"), F.regexp_replace(F.split("target", "/")[2], r"\.py$", "")).alias("module"))
    aliases = files.select(
        F.lit("src").alias("config_dir"), F.concat(F.lit("@"), F.split("file_path", "/")[1], F.lit("/*")).alias("pattern"),
        F.concat(F.split("file_path", "/")[1], F.lit("/*.py")).alias("target"), F.lit("src").alias("base_dir")).distinct()
    return RS.resolve_aliases(imports, aliases, files)


@register("export_resolution", graph("""
WITH keys AS (
  SELECT DISTINCT key, qualified_name, file_path FROM (
    SELECT unnest(CASE WHEN kind = 'File' THEN [name, replace(replace(file_path, '/', '.'), '.py', ''), file_path, split_part(file_path, '/', 2) || '/' || split_part(file_path, '/', 3), split_part(file_path, '/', 3)]
      ELSE [name, split_part(qualified_name, '/', 3), replace(replace(file_path, '/', '.'), '.py', '') || '.' || name] END) AS key, qualified_name, file_path FROM nodes)),
ends AS (SELECT DISTINCT target AS t, source AS s FROM edges),
cand AS (
  SELECT e.t, e.s, count(*) AS n, min(k.qualified_name) AS c,
    count(*) FILTER (k.file_path = split_part(e.s, '::', 1)) AS nf, min(k.qualified_name) FILTER (k.file_path = split_part(e.s, '::', 1)) AS cf,
    count(*) FILTER (starts_with(k.file_path, regexp_replace(split_part(e.s, '::', 1), '/[^/]*$', '') || '/')) AS nd,
    min(k.qualified_name) FILTER (starts_with(k.file_path, regexp_replace(split_part(e.s, '::', 1), '/[^/]*$', '') || '/')) AS cd
  FROM ends e JOIN keys k ON k.key = e.t GROUP BY 1, 2)
SELECT e.kind, e.source AS source_node, CASE WHEN x.qualified_name IS NOT NULL THEN e.target WHEN n = 1 THEN c WHEN nf = 1 THEN cf WHEN nd = 1 THEN cd ELSE c END AS target_node, count(*) AS edge_count
FROM edges e LEFT JOIN nodes x ON x.qualified_name = e.target LEFT JOIN cand ON cand.t = e.target AND cand.s = e.source
WHERE x.qualified_name IS NOT NULL OR c IS NOT NULL GROUP BY 1, 2, 3"""))
def export_resolution(w: Workspace) -> DataFrame:
    return RS.resolve_for_export(w.graph).groupBy("kind", "source_node", "target_node").agg(F.count("*").alias("edge_count"))


@register("rename_edits", graph("""
WITH sites AS (
  SELECT qualified_name, file_path AS file, line_start AS line, 'definition' AS site FROM sym
  UNION ALL SELECT s.qualified_name, e.file_path, e.line, 'call' FROM sym s JOIN edges e ON e.kind = 'CALLS' AND e.target = s.qualified_name),
bare AS (SELECT DISTINCT s.qualified_name, e.file_path AS file, e.line FROM sym s JOIN edges e ON e.kind = 'CALLS' AND e.target = s.name),
imp AS (SELECT DISTINCT s.qualified_name, e.file_path AS file, e.line FROM sym s JOIN edges e ON e.kind = 'IMPORTS_FROM' AND e.target = s.qualified_name)
SELECT * FROM sites
UNION ALL SELECT *, 'bare_call' FROM (SELECT * FROM bare EXCEPT SELECT qualified_name, file, line FROM sites)
UNION ALL SELECT *, 'import' FROM (SELECT * FROM imp EXCEPT SELECT qualified_name, file, line FROM sites EXCEPT SELECT * FROM bare)"""))
def rename_edits(w: Workspace) -> DataFrame:
    return RF.rename_edits(w.graph, w.graph.nodes.where("kind <> 'File'"))


# --- traversal ---------------------------------------------------------------

BOTH = "both_ways AS MATERIALIZED (SELECT source, target FROM edges UNION SELECT target, source FROM edges)"
SEEDS = "seeds AS (SELECT qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files))"
REACH2 = f"""{BOTH}, {SEEDS},
r(q, d) AS (SELECT qualified_name, 0 FROM seeds UNION SELECT b.target, r.d + 1 FROM r JOIN both_ways b ON b.source = r.q WHERE r.d < 2),
near AS MATERIALIZED (SELECT q, min(d) AS depth FROM r GROUP BY q)"""


@register("impact_radius", graph(f"""WITH {REACH2}
SELECT n.qualified_name, n.kind, n.file_path, c.depth, CASE WHEN c.depth = 0 THEN 'changed' ELSE 'impacted' END AS role
FROM near c JOIN nodes n ON n.qualified_name = c.q"""))
def impact_radius(w: Workspace) -> DataFrame:
    return T.impact_radius(w.graph, w.changed_files)


@register("impact_radius_shown", graph(f"""WITH {REACH2},
rows AS MATERIALIZED (SELECT n.qualified_name, n.kind, n.file_path, c.depth, CASE WHEN c.depth = 0 THEN 'changed' ELSE 'impacted' END AS role
  FROM near c JOIN nodes n ON n.qualified_name = c.q),
total AS (SELECT count(*) AS total_impacted FROM rows WHERE depth > 0),
shown AS (SELECT * FROM rows WHERE depth = 0 UNION ALL (SELECT * FROM rows WHERE depth > 0 ORDER BY depth, qualified_name LIMIT 500))
SELECT shown.*, total_impacted, total_impacted > 500 AS truncated FROM shown CROSS JOIN total"""))
def impact_radius_shown(w: Workspace) -> DataFrame:
    return T.impact_radius(w.graph, w.changed_files, max_nodes=500)


@register("impact_radius_full", graph(f"""WITH {REACH2}
SELECT n.qualified_name, n.kind, n.file_path, c.depth, CASE WHEN c.depth = 0 THEN 'changed' ELSE 'impacted' END AS role
FROM near c JOIN nodes n ON n.qualified_name = c.q"""))
def impact_radius_full(w: Workspace) -> DataFrame:
    return T.impact_radius(w.graph, w.changed_files, max_nodes=None)


@register("impact_radius_recursive", graph(f"""WITH {REACH2}
SELECT q AS qualified_name, depth FROM near"""))
def impact_radius_recursive(w: Workspace) -> DataFrame:
    return T.impact_radius_recursive(w.graph, w.changed_files)


@register("impact_radius_four_hops", graph(f"""WITH {BOTH}, {SEEDS},
r(q, d) AS (SELECT qualified_name, 0 FROM seeds UNION SELECT b.target, r.d + 1 FROM r JOIN both_ways b ON b.source = r.q WHERE r.d < 4),
near AS MATERIALIZED (SELECT q, min(d) AS depth FROM r GROUP BY q)
SELECT depth, count(*) AS n FROM near JOIN nodes ON qualified_name = q GROUP BY 1"""))
def impact_radius_four_hops(w: Workspace) -> DataFrame:
    return T.impact_radius(w.graph, w.changed_files, 4, None).groupBy("depth").agg(F.count("*").alias("n"))


@register("impact_edges", graph(f"""WITH {REACH2},
keep AS (SELECT q FROM near JOIN nodes ON qualified_name = q)
SELECT kind, count(*) AS n FROM edges WHERE source IN (SELECT q FROM keep) AND target IN (SELECT q FROM keep) GROUP BY 1"""))
def impact_edges(w: Workspace) -> DataFrame:
    found = T.impact_radius(w.graph, w.changed_files, max_nodes=None)
    return L.edges_among(w.graph, found).groupBy("kind").agg(F.count("*").alias("n"))


@register("impact_review", graph(f"""WITH {REACH2},
keep AS (SELECT q, depth FROM near JOIN nodes ON qualified_name = q),
inner_edges AS (SELECT * FROM edges WHERE source IN (SELECT q FROM keep) AND target IN (SELECT q FROM keep)),
gaps AS (SELECT qualified_name FROM nodes WHERE qualified_name IN (SELECT qualified_name FROM seeds) AND kind = 'Function' AND NOT is_test
  AND qualified_name NOT IN (SELECT source FROM inner_edges WHERE kind = 'TESTED_BY'))
SELECT (SELECT count(*) FROM keep WHERE depth = 0) AS changed, (SELECT count(*) FROM keep WHERE depth > 0) AS impacted,
  CASE WHEN (SELECT count(*) FROM keep WHERE depth > 0) > 20 THEN 'high' WHEN (SELECT count(*) FROM keep WHERE depth > 0) > 5 THEN 'medium' ELSE 'low' END AS risk,
  (SELECT count(*) FROM keep WHERE depth > 0) > 20 AS wide_impact,
  (SELECT count(*) FROM inner_edges WHERE kind IN ('INHERITS', 'IMPLEMENTS')) > 0 AS inheritance_touched,
  (SELECT count(*) FROM changed_files) > 3 AS many_files, (SELECT count(*) FROM gaps) AS untested_functions"""))
def impact_review(w: Workspace) -> DataFrame:
    g = w.graph
    found = T.impact_radius(g, w.changed_files, max_nodes=None)
    changed = L.nodes_by_file(g, w.changed_files)
    gaps = R.review_test_gaps(g, changed, found)
    return K.impact_band(found, L.edges_among(g, found), w.changed_files, gaps)


@register("file_dependents", graph("""WITH
dep AS MATERIALIZED (
  SELECT DISTINCT used, file_path FROM (
    SELECT n.file_path AS used, e.file_path FROM edges e JOIN nodes n ON n.qualified_name = e.target WHERE e.kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS')
    UNION ALL SELECT target, file_path FROM edges WHERE kind = 'IMPORTS_FROM') WHERE used <> file_path),
r(f, d) AS (SELECT file_path, 0 FROM changed_files UNION SELECT dep.file_path, r.d + 1 FROM r JOIN dep ON dep.used = r.f WHERE r.d < 2)
SELECT f AS file_path, min(d) AS hops FROM r GROUP BY f HAVING min(d) > 0"""))
def file_dependents(w: Workspace) -> DataFrame:
    return T.dependent_files(w.graph, w.changed_files)


HUB = "(SELECT target FROM edges WHERE kind = 'CALLS' AND target IN (SELECT qualified_name FROM nodes) GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"


@register("neighborhood", graph(f"""WITH
hub AS MATERIALIZED (SELECT {HUB} AS q),
first AS MATERIALIZED (SELECT * FROM edges WHERE source = (SELECT q FROM hub) OR target = (SELECT q FROM hub)),
f2 AS (SELECT qualified_name AS q FROM nodes WHERE qualified_name IN (SELECT source FROM first UNION SELECT target FROM first) AND qualified_name <> (SELECT q FROM hub))
SELECT kind, source, target, file_path, line FROM first
UNION SELECT kind, source, target, file_path, line FROM edges WHERE source IN (SELECT q FROM f2) OR target IN (SELECT q FROM f2)"""))
def neighborhood(w: Workspace) -> DataFrame:
    g = w.graph
    known = g.nodes.select("qualified_name")
    hub = SM.hub_functions(g, None).join(known, "qualified_name", "left_semi").orderBy(F.desc("caller_count"), "qualified_name").first()
    return T.neighborhood(g, hub["qualified_name"], depth=2)


# --- overviews ---------------------------------------------------------------


@register("graph_stats", graph("""
SELECT 'nodes_by_kind' AS metric, kind AS label, count(*) AS value FROM nodes GROUP BY kind
UNION ALL SELECT 'edges_by_kind', kind, count(*) FROM edges GROUP BY kind
UNION ALL SELECT 'nodes_total', '*', count(*) FROM nodes UNION ALL SELECT 'edges_total', '*', count(*) FROM edges
UNION ALL SELECT 'languages', '*', count(DISTINCT language) FROM nodes WHERE language <> '' UNION ALL SELECT 'files', '*', count(*) FROM nodes WHERE kind = 'File'"""))
def graph_stats(w: Workspace) -> DataFrame:
    return SM.graph_stats(w.graph)


@register("language_share", graph("""
SELECT language, count(*) AS functions, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () + 1e-9::DOUBLE, 2) AS percent FROM nodes WHERE kind = 'Function' GROUP BY language"""))
def language_share(w: Workspace) -> DataFrame:
    return SM.language_share(w.graph)


@register("top_files", graph("SELECT file_path, count(*) AS symbol_count FROM nodes WHERE kind IN ('Function', 'Class') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"))
def top_files(w: Workspace) -> DataFrame:
    return SM.top_files(w.graph)


@register("hub_functions", graph("SELECT target AS qualified_name, count(*) AS caller_count FROM edges WHERE kind = 'CALLS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def hub_functions(w: Workspace) -> DataFrame:
    return SM.hub_functions(w.graph)


@register("entries_by_file", graph(f"""
SELECT file_path, count(*) AS entry_points FROM nodes n WHERE kind IN ('Function', 'Test')
AND ({ENTRY} OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target = n.qualified_name)) GROUP BY 1"""))
def entries_by_file(w: Workspace) -> DataFrame:
    return SM.entries_by_file(R.entry_points(w.graph))


@register("file_supergraph_nodes", graph("""
SELECT file_path, split_part(file_path, '/', 2) || '/' || split_part(file_path, '/', 3) AS label, count(*) FILTER (kind <> 'File') AS symbol_count,
  coalesce(arg_max(language, (line_start, qualified_name)) FILTER (language <> ''), '') AS language FROM nodes GROUP BY file_path"""))
def file_supergraph_nodes(w: Workspace) -> DataFrame:
    return SM.file_supergraph(w.graph)[0].select("file_path", "label", "symbol_count", "language")


@register("file_supergraph_edges", graph("""
SELECT s.file_path AS src_file, t.file_path AS dst_file, count(*) AS weight FROM edges e JOIN nodes s ON s.qualified_name = e.source JOIN nodes t ON t.qualified_name = e.target
WHERE s.file_path <> t.file_path GROUP BY 1, 2"""))
def file_supergraph_edges(w: Workspace) -> DataFrame:
    return SM.file_supergraph(w.graph)[1]


@register("file_tree", graph("""
SELECT folder, count(*) AS files FROM (SELECT unnest(['src', 'src/' || split_part(file_path, '/', 2)]) AS folder FROM nodes WHERE kind = 'File') GROUP BY 1"""))
def file_tree(w: Workspace) -> DataFrame:
    return SM.file_tree(w.graph)
