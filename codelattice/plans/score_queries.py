"""Registered flow, risk, community and evaluation analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.numbers import rounded
from codelattice.functions.text import token_estimate
from codelattice.model import CodeGraph
from codelattice.operators import communities as C
from codelattice.operators import evaluation as EV
from codelattice.operators import flows as FL
from codelattice.operators import lookup as L
from codelattice.operators import relations as R
from codelattice.operators import risk as K
from codelattice.operators import summary as SM
from codelattice.operators import traversal as T
from codelattice.operators.ordering import rank_rows
from codelattice.plans.oracle_base import FLOWS, GRAPH, SECURE, flow, graph, over
from codelattice.sources.commerce import CHECK_WORDS, STRUCTURE, Workspace

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


# --- flows -------------------------------------------------------------------


@register("flow_trace", flow("SELECT root, node, depth FROM members"))
def flow_trace(w: Workspace) -> DataFrame:
    return FL.trace_flows(w.graph).select("root", "node", "depth")


@register("flow_membership", flow("SELECT root, node, position FROM positioned"))
def flow_membership(w: Workspace) -> DataFrame:
    return w.flow_members.select("root", "node", "position")


@register("flow_criticality", flow("SELECT * FROM flows"))
def flow_criticality(w: Workspace) -> DataFrame:
    return FL.score_flows(w.graph, w.flow_members, CHECK_WORDS)


@register("flow_listing", flow("SELECT entry_point, criticality FROM flows ORDER BY criticality DESC, entry_point LIMIT 50"))
def flow_listing(w: Workspace) -> DataFrame:
    return FL.list_flows(w.flows).select("entry_point", "criticality")


@register("flows_by_depth", flow("SELECT entry_point, depth, node_count FROM flows ORDER BY depth DESC, entry_point LIMIT 50"))
def flows_by_depth(w: Workspace) -> DataFrame:
    return FL.list_flows(w.flows, "depth").select("entry_point", "depth", "node_count")


@register("affected_flows", flow("""
SELECT entry_point, criticality FROM flows WHERE entry_point IN (
  SELECT root FROM members WHERE node IN (SELECT qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files)))"""))
def affected_flows(w: Workspace) -> DataFrame:
    return FL.affected_flows(w.flows, w.flow_members, w.graph, w.changed_files).select("entry_point", "criticality")


@register("flow_steps", flow("""
SELECT p.root, p.node, p.depth, p.position, n.name, n.kind, n.file_path, n.line_start FROM positioned p JOIN nodes n ON n.qualified_name = p.node"""))
def flow_steps(w: Workspace) -> DataFrame:
    return FL.flow_steps(w.flow_members.drop("position"), w.graph).select(
        "root", "node", "depth", "position", "name", "kind", "file_path", "line_start")


@register("flow_counts", flow("SELECT node AS qualified_name, count(*) AS flows FROM members GROUP BY 1"))
def flow_counts(w: Workspace) -> DataFrame:
    return FL.flow_counts(w.flow_members)


@register("flow_snapshots", flow("""
WITH named AS (SELECT p.*, n.name, max(position) OVER (PARTITION BY root) AS last FROM positioned p JOIN nodes n ON n.qualified_name = p.node),
agg AS (SELECT root, max(last) AS last,
  max(name) FILTER (position = 1) AS n1, max(name) FILTER (position = 2) AS n2, max(name) FILTER (position = 3) AS n3, max(name) FILTER (position = last) AS final FROM named GROUP BY root),
shown AS (SELECT root, last, final, list_filter(CASE WHEN last >= 2 THEN [root, n1, n2, n3] ELSE [root] END, lambda x: x IS NOT NULL) AS s FROM agg)
SELECT root AS entry_point, array_to_string(CASE WHEN last >= 1 AND NOT list_contains(s, final) THEN list_append(s, final) ELSE s END, ' > ') AS critical_path FROM shown"""))
def flow_snapshots(w: Workspace) -> DataFrame:
    return FL.flow_snapshots(w.flow_members, w.graph).select("entry_point", F.array_join("critical_path", " > ").alias("critical_path"))


@register("flow_refresh", flow("SELECT root, node, depth FROM members"))
def flow_refresh(w: Workspace) -> DataFrame:
    return FL.refresh_flows(w.graph, FL.trace_flows(w.graph_before_change), w.changed_files).select("root", "node", "depth")


@register("call_paths", flow("""
SELECT root, node, depth AS hops, array_to_string(list_prepend(root, list_transform(trail, lambda t: substr(t, 10))), ' > ') AS path FROM members WHERE depth > 0"""))
def call_paths(w: Workspace) -> DataFrame:
    return T.paths(w.flow_members).where("depth > 0").select(
        "root", "node", F.col("depth").alias("hops"), F.array_join("path", " > ").alias("path"))


@register("trace_path", flow("""
WITH ends AS MATERIALIZED (SELECT root, node FROM members WHERE depth <= 8 ORDER BY depth DESC, root, node LIMIT 1),
cd AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE kind = 'CALLS'),
go(node, hops, path) AS (
  SELECT target, 1, [(SELECT root FROM ends), target] FROM cd WHERE contains(lower(source), lower((SELECT root FROM ends))) AND target <> (SELECT root FROM ends)
  UNION SELECT c.target, g.hops + 1, list_append(g.path, c.target) FROM go g JOIN cd c ON c.source = g.node WHERE g.hops < 8 AND NOT list_contains(g.path, c.target)),
hit AS (SELECT * FROM go WHERE contains(node, (SELECT node FROM ends)))
SELECT array_to_string(min(path), ' > ') AS path, CAST(min(hops) AS INTEGER) AS hops FROM hit WHERE hops = (SELECT min(hops) FROM hit)"""))
def trace_path(w: Workspace) -> DataFrame:
    ends = w.flow_members.where("depth <= 8").orderBy(F.desc("depth"), "root", "node").select("root", "node").first()
    return T.call_path(w.graph, ends["root"], ends["node"]).select(F.array_join("path", " > ").alias("path"), "hops")


@register("hunt_candidates", flow(r"""
WITH c AS (SELECT entry_point AS qualified_name, 1 AS priority FROM flows
UNION ALL SELECT qualified_name, 2 FROM nodes n WHERE kind IN ('Function', 'Method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target = n.qualified_name))
SELECT qualified_name, min(priority) AS priority FROM c GROUP BY 1"""))
def hunt_candidates(w: Workspace) -> DataFrame:
    from codelattice.plans.pipelines import hunt_candidates as candidates

    return candidates(w.graph, w.flows, None)


# --- risk --------------------------------------------------------------------

RISK = """
chg AS MATERIALIZED (SELECT DISTINCT n.* FROM nodes n JOIN changed_ranges r ON r.file_path = n.file_path AND n.line_start <= r.stop AND n.line_end >= r.start),
fcount AS MATERIALIZED (SELECT node, count(*) AS flows FROM members GROUP BY 1),
sites AS MATERIALIZED (SELECT target, count(*) AS callers FROM edges WHERE kind = 'CALLS' GROUP BY 1),
crossing AS MATERIALIZED (SELECT target, count(*) AS crossing FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'CALLS') e
  JOIN file_members a ON a.qualified_name = e.source JOIN file_members b ON b.qualified_name = e.target WHERE a.community_id <> b.community_id GROUP BY 1),
tested AS MATERIALIZED (SELECT DISTINCT target AS t FROM edges WHERE kind = 'TESTED_BY'),
risks AS MATERIALIZED (SELECT c.qualified_name, c.name, c.kind, c.file_path, coalesce(f.flows, 0) AS flows, coalesce(x.crossing, 0) AS crossing, coalesce(s.callers, 0) AS callers, t.t IS NOT NULL AS tested,
  round(least(greatest(least(coalesce(f.flows, 0) * 0.05::DOUBLE, 0.25::DOUBLE) + least(coalesce(x.crossing, 0) * 0.05::DOUBLE, 0.15::DOUBLE)
    + CASE WHEN t.t IS NOT NULL THEN 0.05::DOUBLE ELSE 0.30::DOUBLE END + CASE WHEN {secure} THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
    + least(coalesce(s.callers, 0) / 20.0::DOUBLE, 0.10::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) + 1e-9::DOUBLE, 4) AS risk_score
  FROM chg c LEFT JOIN fcount f ON f.node = c.qualified_name LEFT JOIN sites s ON s.target = c.qualified_name
  LEFT JOIN crossing x ON x.target = c.qualified_name LEFT JOIN tested t ON t.t = c.qualified_name WHERE c.kind IN ('Function', 'Test', 'Class')),
hit_flows AS (SELECT DISTINCT root FROM members WHERE node IN (SELECT qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files)))
""".replace("{secure}", SECURE)


def risk_sql(sql: str) -> str:
    return over(GRAPH, FLOWS, RISK, sql=sql)


def _risks(w: Workspace) -> DataFrame:
    return K.change_risk(
        w.graph, w.overlapping, FL.flow_counts(w.flow_members), w.file_members, CHECK_WORDS)


@register("change_risk", risk_sql("SELECT qualified_name, kind, flows, crossing, callers, tested, risk_score FROM risks"))
def change_risk(w: Workspace) -> DataFrame:
    return _risks(w).select("qualified_name", "kind", "flows", "crossing", "callers", "tested", "risk_score")


@register("review_priorities", risk_sql("SELECT qualified_name, risk_score FROM risks ORDER BY risk_score DESC, qualified_name LIMIT 10"))
def review_priorities(w: Workspace) -> DataFrame:
    return K.priorities(_risks(w)).select("qualified_name", "risk_score")


@register("change_summary", risk_sql("""
SELECT (SELECT count(*) FROM changed_files) AS changed_files, count(*) AS changed_functions, (SELECT count(*) FROM hit_flows) AS affected_flows,
  count(*) FILTER (kind IN ('Function', 'Class') AND NOT tested) AS test_gaps, max(risk_score) AS risk_score,
  CASE WHEN max(risk_score) > 0.7 THEN 'high' WHEN max(risk_score) > 0.4 THEN 'medium' ELSE 'low' END AS risk FROM risks"""))
def change_summary(w: Workspace) -> DataFrame:
    gaps = R.test_gaps(w.graph, w.overlapping)
    flows = FL.affected_flows(w.flows, w.flow_members, w.graph, w.changed_files)
    return K.change_summary(_risks(w), gaps, flows, w.changed_files)


@register("minimal_context", risk_sql("""
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
  (SELECT CASE WHEN max(risk_score) > 0.7 THEN 'high' WHEN max(risk_score) > 0.4 THEN 'medium' ELSE 'low' END FROM risks) AS risk,
  (SELECT string_agg(community_id, ', ' ORDER BY size DESC, community_id) FROM (SELECT community_id, count(*) AS size FROM file_members GROUP BY 1 ORDER BY size DESC, community_id LIMIT 3)) AS communities,
  (SELECT string_agg(name, ', ' ORDER BY criticality DESC, entry_point) FROM (SELECT * FROM flows ORDER BY criticality DESC, entry_point LIMIT 3)) AS flows"""))
def minimal_context(w: Workspace) -> DataFrame:
    sizes = w.file_members.groupBy("community_id").agg(F.count("*").alias("size")).withColumn("name", F.col("community_id"))
    return SM.minimal_context(w.graph, sizes, w.flows, _risks(w))


@register("risk_index", graph(f"""
SELECT n.qualified_name, coalesce(c.n, 0) AS caller_count, CASE WHEN t.s IS NOT NULL THEN 'tested' ELSE 'untested' END AS test_coverage, {SECURE} AS security_relevant,
  round(least(CASE WHEN coalesce(c.n, 0) > 10 THEN 0.3::DOUBLE WHEN coalesce(c.n, 0) > 3 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN t.s IS NOT NULL THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN {SECURE} THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) + 1e-9::DOUBLE, 4) AS risk_score
FROM nodes n LEFT JOIN (SELECT target, count(*) AS n FROM edges WHERE kind = 'CALLS' GROUP BY 1) c ON c.target = n.qualified_name
LEFT JOIN (SELECT DISTINCT source AS s FROM edges WHERE kind = 'TESTED_BY') t ON t.s = n.qualified_name WHERE kind IN ('Function', 'Class', 'Test')"""))
def risk_index(w: Workspace) -> DataFrame:
    return K.risk_index(w.graph, CHECK_WORDS)


# --- communities -------------------------------------------------------------

COMMON = ", ".join(f"'{x}'" for x in S.COMMON_NAME_WORDS)
FILE_COMMUNITIES = rf"""
mem AS MATERIALIZED (SELECT m.community_id, n.* FROM file_members m JOIN nodes n USING (qualified_name)),
size AS (SELECT community_id, count(*) AS size FROM mem GROUP BY 1),
ends AS MATERIALIZED (SELECT e.*, s.community_id AS sc, t.community_id AS tc FROM edges e LEFT JOIN file_members s ON s.qualified_name = e.source LEFT JOIN file_members t ON t.qualified_name = e.target),
coh AS MATERIALIZED (SELECT community_id, CAST(sum(internal) AS BIGINT) AS internal_edges, count(*) AS touching_edges, round(sum(internal) / count(*)::DOUBLE + 1e-9::DOUBLE, 4) AS cohesion FROM (
  SELECT sc AS community_id, CASE WHEN sc = tc THEN 1 ELSE 0 END AS internal FROM ends WHERE sc IS NOT NULL
  UNION ALL SELECT tc, 0 FROM ends WHERE tc IS NOT NULL AND tc IS DISTINCT FROM sc) GROUP BY 1),
lang AS (SELECT community_id, language FROM (SELECT community_id, language, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, min((file_path, line_start, qualified_name))) AS rn FROM mem WHERE language <> '' GROUP BY 1, 2) WHERE rn = 1),
cls AS (SELECT community_id, name, n FROM (SELECT community_id, name, count(*) AS n, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, min((file_path, line_start, qualified_name))) AS rn FROM mem WHERE kind = 'Class' GROUP BY 1, 2) WHERE rn = 1),
wl AS (SELECT community_id, file_path, line_start, qualified_name, list_filter(regexp_split_to_array(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '[_\-.\s]+'), lambda x: x <> '') AS ws FROM mem WHERE kind IN ('Function', 'Class', 'Test')),
w1 AS (SELECT community_id, file_path, line_start, qualified_name, unnest(range(1, len(ws) + 1)) AS pos, ws FROM wl),
w2 AS (SELECT *, lower(ws[pos]) AS word FROM w1),
kw AS (SELECT community_id, word FROM (SELECT community_id, word, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, min((file_path, line_start, qualified_name, pos))) AS rn FROM w2
  WHERE word NOT IN ({COMMON}) AND length(word) > 1 GROUP BY 1, 2) WHERE rn = 1),
table_rows AS MATERIALIZED (
  SELECT s.community_id, s.size, coalesce(coh.cohesion, 0) AS cohesion, coalesce(lang.language, '') AS dominant_language, split_part(s.community_id, '/', 2) AS prefix,
    CASE WHEN cls.n > s.size * 0.4::DOUBLE THEN substr(regexp_replace(regexp_replace(lower(cls.name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) ELSE coalesce(kw.word, '') END AS tail
  FROM size s LEFT JOIN coh USING (community_id) LEFT JOIN lang USING (community_id) LEFT JOIN cls USING (community_id) LEFT JOIN kw USING (community_id)),
community_rows AS MATERIALIZED (
  SELECT community_id, size, cohesion, dominant_language, CASE WHEN tail <> '' THEN prefix || '-' || tail ELSE prefix END AS name FROM table_rows)
"""


def file_sql(sql: str) -> str:
    return over(GRAPH, FILE_COMMUNITIES, sql=sql)


@register("communities_by_file", file_sql("SELECT community_id, size, cohesion, dominant_language, name FROM community_rows"))
def communities_by_file(w: Workspace) -> DataFrame:
    return C.community_table(w.graph, w.file_members)


@register("community_listing", file_sql("SELECT community_id, size, cohesion FROM community_rows WHERE size >= 5"))
def community_listing(w: Workspace) -> DataFrame:
    return C.list_communities(C.community_table(w.graph, w.file_members), "cohesion", 5).select("community_id", "size", "cohesion")


@register("community_by_name", file_sql("SELECT community_id, name FROM community_rows WHERE contains(lower(name), 'promo') ORDER BY community_id LIMIT 1"))
def community_by_name(w: Workspace) -> DataFrame:
    return C.find_community(C.community_table(w.graph, w.file_members), "Promo").select("community_id", "name")


@register("community_cohesion", file_sql("SELECT * FROM coh"))
def community_cohesion(w: Workspace) -> DataFrame:
    return C.cohesion(w.graph, w.file_members)


@register("cross_community_edges", file_sql("SELECT sc AS source_community, tc AS target_community, kind AS edge_kind, source, target FROM ends WHERE sc <> tc"))
def cross_community_edges(w: Workspace) -> DataFrame:
    return C.cross_edges(w.graph, w.file_members)


@register("community_coupling", file_sql("SELECT least(sc, tc) AS community_a, greatest(sc, tc) AS community_b, count(*) AS edge_count FROM ends WHERE sc <> tc GROUP BY 1, 2 HAVING count(*) > 2"))
def community_coupling(w: Workspace) -> DataFrame:
    return C.coupling(w.graph, w.file_members, 2)


@register("key_symbols", graph("""
WITH deg AS (SELECT q, sum(o) AS m, sum(i) AS n FROM (SELECT source AS q, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY q),
sc AS (SELECT community_id, f.qualified_name, n.name, CAST(coalesce(m, 0) * greatest(coalesce(deg.n, 0), 1) + coalesce(deg.n, 0) * greatest(coalesce(m, 0), 1) AS BIGINT) AS weight
 FROM file_members f JOIN nodes n ON n.qualified_name = f.qualified_name AND n.kind <> 'File' LEFT JOIN deg ON deg.q = f.qualified_name)
SELECT community_id, qualified_name, name, weight FROM sc QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY weight DESC, qualified_name) <= 5"""))
def key_symbols(w: Workspace) -> DataFrame:
    return C.key_symbols(w.graph, w.file_members)


@register("community_purpose", graph("SELECT DISTINCT community_id, split_part(community_id, '/', 2) AS purpose FROM file_members"))
def community_purpose(w: Workspace) -> DataFrame:
    return C.purpose(w.graph, w.file_members)


@register("move_suggestions", graph("""
SELECT e.target AS qualified_name, b.community_id AS from_community, min(a.community_id) AS to_community
FROM (SELECT DISTINCT source, target FROM edges WHERE kind = 'CALLS') e JOIN nodes n ON n.qualified_name = e.target AND n.kind = 'Function'
JOIN file_members a ON a.qualified_name = e.source JOIN file_members b ON b.qualified_name = e.target
GROUP BY 1, 2 HAVING count(DISTINCT a.community_id) = 1 AND min(a.community_id) <> b.community_id"""))
def move_suggestions(w: Workspace) -> DataFrame:
    return C.move_suggestions(w.graph, w.file_members)


@register("community_dependencies", file_sql("""
WITH c AS (SELECT sc AS community_id, 'outgoing' AS direction, target AS other, count(*) AS edge_count FROM ends WHERE sc IS NOT NULL AND sc IS DISTINCT FROM tc GROUP BY 1, 2, 3
UNION ALL SELECT tc, 'incoming', source, count(*) FROM ends WHERE tc IS NOT NULL AND sc IS DISTINCT FROM tc GROUP BY 1, 2, 3)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY community_id, direction ORDER BY edge_count DESC, other) <= 15"""))
def community_dependencies(w: Workspace) -> DataFrame:
    return C.dependency_counts(w.graph, w.file_members)


@register("community_flows", flow("""
WITH top AS (SELECT entry_point, criticality FROM flows),
t AS (SELECT DISTINCT f.community_id, top.entry_point, top.criticality FROM top JOIN members m ON m.root = top.entry_point JOIN file_members f ON f.qualified_name = m.node)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY criticality DESC, entry_point) <= 10"""))
def community_flows(w: Workspace) -> DataFrame:
    return C.community_flows(w.flows, w.flow_members, w.file_members)


@register("community_supergraph_nodes", graph("SELECT coalesce(f.community_id, '-1') AS community_id, count(*) AS member_count FROM nodes n LEFT JOIN file_members f USING (qualified_name) GROUP BY 1"))
def community_supergraph_nodes(w: Workspace) -> DataFrame:
    return SM.community_supergraph(w.graph, w.file_members)[0]


@register("community_supergraph_edges", graph("""
WITH f AS (SELECT n.qualified_name, coalesce(m.community_id, '-1') AS c FROM nodes n LEFT JOIN file_members m USING (qualified_name))
SELECT least(a.c, b.c) AS community_a, greatest(a.c, b.c) AS community_b, count(*) AS weight FROM edges e JOIN f a ON a.qualified_name = e.source JOIN f b ON b.qualified_name = e.target WHERE a.c <> b.c GROUP BY 1, 2"""))
def community_supergraph_edges(w: Workspace) -> DataFrame:
    return SM.community_supergraph(w.graph, w.file_members)[1]


def _label_sql(sql: str, rounds: int = 10) -> str:
    """The label rounds unrolled; a settled labelling stays as it is."""
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.EDGE_WEIGHTS.items())
    parts = [f"""
pairs AS MATERIALIZED (SELECT a, b, CAST(CASE k {weights} ELSE 0.5 END AS DOUBLE) AS w FROM (
  SELECT least(source, target) AS a, greatest(source, target) AS b, min(kind) AS k FROM edges
  WHERE source <> target AND source IN (SELECT qualified_name FROM nodes) AND target IN (SELECT qualified_name FROM nodes) GROUP BY 1, 2)),
both_p AS (SELECT a AS node, b AS via, w FROM pairs UNION ALL SELECT b, a, w FROM pairs),
lk AS MATERIALIZED (SELECT node, via, CAST(round(w * 10) AS BIGINT) AS w FROM both_p UNION ALL SELECT node, node, CAST(round(max(w) * 10) AS BIGINT) FROM both_p GROUP BY node),
lab0 AS MATERIALIZED (SELECT DISTINCT node, node AS label FROM both_p)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""
lab{i} AS MATERIALIZED (SELECT node, label FROM (
  SELECT lk.node, l.label, row_number() OVER (PARTITION BY lk.node ORDER BY sum(lk.w) DESC, l.label) AS rn FROM lk JOIN lab{i - 1} l ON l.node = lk.via GROUP BY 1, 2) WHERE rn = 1)""")
    parts.append(f"""
lm AS MATERIALIZED (SELECT label AS community_id, node AS qualified_name FROM lab{rounds} WHERE label IN (SELECT label FROM lab{rounds} GROUP BY 1 HAVING count(*) >= 2))""")
    return over(GRAPH, *parts, sql=sql)


@register("label_communities", _label_sql("SELECT community_id, qualified_name FROM lm"))
def label_communities(w: Workspace) -> DataFrame:
    return w.label_members


_MODULARITY = """
WITH t AS (SELECT sum(w) AS total FROM pairs), j AS (SELECT a.community_id AS ca, b.community_id AS cb, w FROM pairs JOIN lm a ON a.qualified_name = pairs.a JOIN lm b ON b.qualified_name = pairs.b)
SELECT round(sum(i / total - power(d / (total * 2), 2)) + 1e-9::DOUBLE, 6) AS modularity FROM (SELECT c, sum(i) AS i, sum(d) AS d FROM (
  SELECT ca AS c, CASE WHEN ca = cb THEN w ELSE 0 END AS i, w AS d FROM j UNION ALL SELECT cb, 0, w FROM j) GROUP BY c), t"""


@register("label_modularity", _label_sql(_MODULARITY))
def label_modularity(w: Workspace) -> DataFrame:
    return C.modularity(C.weighted_pairs(w.graph), w.label_members).select(rounded(F.col("modularity"), 6).alias("modularity"))


def _settle_sql(name: str, nodes: str, links: str, start: str, quiet: str, single: bool = False) -> str:
    """Rounds of moves as a recursion over the whole labelling; it ends when neither half raises modularity."""
    alone = "AND t.n = 1" if single else ""
    return f"""
{name}(r, quiet, q, node, label) AS (
  SELECT 0, {quiet}, (SELECT coalesce(sum(l.w), 0) FROM {links} l JOIN {start} x ON x.node = l.node JOIN {start} y ON y.node = l.via WHERE x.label = y.label)::HUGEINT * (SELECT m FROM whole)
    - (SELECT sum(t * t) FROM (SELECT sum(k)::HUGEINT AS t FROM {start} JOIN {nodes} USING (node) GROUP BY label)), node, label FROM {start}
  UNION ALL
  SELECT * FROM (
    WITH cur AS MATERIALIZED (SELECT c.*, n.k, n.half FROM {name} c JOIN {nodes} n USING (node) WHERE quiet < 2),
    tot AS MATERIALIZED (SELECT label, sum(k)::HUGEINT AS t, count(*) AS n FROM cur GROUP BY label),
    near AS MATERIALIZED (SELECT l.node, c.label, sum(l.w)::HUGEINT AS s FROM {links} l JOIN cur c ON c.node = l.via GROUP BY 1, 2),
    stay AS MATERIALIZED (SELECT c.node, c.k, c.label, coalesce(e.s, 0) * whole.m - c.k * (t.t - c.k) AS g FROM cur c JOIN tot t USING (label) LEFT JOIN near e ON e.node = c.node AND e.label = c.label, whole WHERE c.half = c.r % 2 {alone}),
    best AS MATERIALIZED (SELECT node, label, home, gain FROM (SELECT e.node, e.label, st.label AS home, e.s * whole.m - st.k * t.t - st.g AS gain, row_number() OVER (PARTITION BY e.node ORDER BY e.s * whole.m - st.k * t.t DESC, e.label) AS rn
      FROM near e JOIN stay st ON st.node = e.node JOIN tot t ON t.label = e.label, whole WHERE e.label <> st.label AND e.s * whole.m - st.k * t.t > st.g) WHERE rn = 1),
    named AS MATERIALIZED (SELECT node FROM (SELECT node, c, row_number() OVER (PARTITION BY c ORDER BY gain DESC, node) AS rn FROM (
      SELECT node, gain, label AS c FROM best UNION ALL SELECT node, gain, home FROM best)) WHERE rn = 1),
    made AS MATERIALIZED (SELECT node FROM named GROUP BY node HAVING count(*) = 2),
    fresh AS MATERIALIZED (SELECT c.node, c.k, c.label AS old, coalesce(b.label, c.label) AS label, CASE WHEN c.node IN (SELECT node FROM made) THEN b.label ELSE c.label END AS few FROM cur c LEFT JOIN best b USING (node)),
    q2 AS MATERIALIZED (SELECT (SELECT coalesce(sum(l.w), 0) FROM {links} l JOIN fresh x ON x.node = l.node JOIN fresh y ON y.node = l.via WHERE x.label = y.label)::HUGEINT * m
      - (SELECT sum(t * t) FROM (SELECT sum(k)::HUGEINT AS t FROM fresh GROUP BY label)) AS q,
      (SELECT coalesce(sum(l.w), 0) FROM {links} l JOIN fresh x ON x.node = l.node JOIN fresh y ON y.node = l.via WHERE x.few = y.few)::HUGEINT * m
      - (SELECT sum(t * t) FROM (SELECT sum(k)::HUGEINT AS t FROM fresh GROUP BY few)) AS p FROM whole)
    SELECT c.r + 1, CASE WHEN greatest(q2.q, q2.p) > c.q THEN 0 ELSE c.quiet + 1 END, CASE WHEN q2.q > c.q THEN q2.q ELSE greatest(q2.p, c.q) END,
      c.node, CASE WHEN q2.q > c.q THEN f.label WHEN q2.p > c.q THEN f.few ELSE f.old END
    FROM cur c JOIN fresh f ON f.node = c.node, q2))"""


def _leiden_sql(sql: str, levels: int = 7) -> str:
    """Levels of moves, refinement and contraction; a level that is no smaller than the one before stays as it is."""
    kinds = ", ".join(f"'{k}'" for k in STRUCTURE)
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.EDGE_WEIGHTS.items())
    last = lambda t: f"(SELECT node, label FROM {t} WHERE r = (SELECT max(r) FROM {t}))"
    parts = [f"""
pairs AS MATERIALIZED (SELECT a, b, CAST(CASE k {weights} ELSE 0.5 END AS DOUBLE) AS w FROM (
  SELECT least(source, target) AS a, greatest(source, target) AS b, min(kind) AS k FROM edges
  WHERE kind IN ({kinds}) AND source <> target AND source IN (SELECT qualified_name FROM nodes) AND target IN (SELECT qualified_name FROM nodes) GROUP BY 1, 2)),
l0 AS MATERIALIZED (SELECT a AS node, b AS via, CAST(round(w * 10) AS BIGINT) AS w FROM pairs UNION ALL SELECT b, a, CAST(round(w * 10) AS BIGINT) FROM pairs),
n0 AS MATERIALIZED (SELECT node, sum(w)::HUGEINT AS k, ascii(right(md5(node), 1)) % 2 AS half FROM l0 GROUP BY node),
whole AS MATERIALIZED (SELECT sum(k)::HUGEINT AS m FROM n0),
s0 AS MATERIALIZED (SELECT node, node AS label FROM n0),
x0 AS MATERIALIZED (SELECT node AS member, node FROM n0)"""]
    for i in range(levels):
        quiet = "0" if i == 0 else f"CASE WHEN (SELECT count(*) FROM n{i}) = (SELECT count(*) FROM n{i - 1}) THEN 2 ELSE 0 END"
        parts += [
            _settle_sql(f"r{i}", f"n{i}", f"l{i}", f"s{i}", quiet),
            f"""
a{i} AS MATERIALIZED {last(f"r{i}")},
z{i} AS MATERIALIZED (SELECT node, node AS label FROM n{i}),
i{i} AS MATERIALIZED (SELECT l.* FROM l{i} l JOIN a{i} x ON x.node = l.node JOIN a{i} y ON y.node = l.via WHERE x.label = y.label)""",
            _settle_sql(f"f{i}", f"n{i}", f"i{i}", f"z{i}", quiet, single=True),
            f"""
g{i} AS MATERIALIZED {last(f'f{i}')},
n{i + 1} AS MATERIALIZED (SELECT g.label AS node, sum(k)::HUGEINT AS k, ascii(right(md5(g.label), 1)) % 2 AS half FROM n{i} JOIN g{i} g USING (node) GROUP BY g.label),
l{i + 1} AS MATERIALIZED (SELECT x.label AS node, y.label AS via, sum(w)::BIGINT AS w FROM l{i} l JOIN g{i} x ON x.node = l.node JOIN g{i} y ON y.node = l.via WHERE x.label <> y.label GROUP BY 1, 2),
s{i + 1} AS MATERIALIZED (SELECT DISTINCT g.label AS node, min(g.label) OVER (PARTITION BY a.label) AS label FROM g{i} g JOIN a{i} a USING (node)),
x{i + 1} AS MATERIALIZED (SELECT member, g.label AS node FROM x{i} JOIN g{i} g USING (node))"""]
    parts.append(f"""
found AS (SELECT min(member) OVER (PARTITION BY label) AS community_id, member AS qualified_name, count(*) OVER (PARTITION BY label) AS n FROM x{levels} JOIN s{levels} USING (node)),
lm AS MATERIALIZED (SELECT community_id, qualified_name FROM found WHERE n >= 2)""")
    return over(GRAPH, *parts, sql=sql)


@register("leiden_communities", _leiden_sql("SELECT community_id, qualified_name FROM lm"))
def leiden_communities(w: Workspace) -> DataFrame:
    return w.leiden_members


@register("leiden_modularity", _leiden_sql(_MODULARITY))
def leiden_modularity(w: Workspace) -> DataFrame:
    return C.modularity(C.weighted_pairs(CodeGraph(w.graph.nodes, w.graph.edges_of(*STRUCTURE))), w.leiden_members).select(rounded(F.col("modularity"), 6).alias("modularity"))


@register("label_communities_split")
def label_communities_split(w: Workspace) -> DataFrame:
    return C.propagated_members(w.graph, split_above=20)


# --- evaluation --------------------------------------------------------------


@register("impact_accuracy", graph("""
WITH changed AS (SELECT qualified_name FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files)),
bw AS MATERIALIZED (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
r(q, d) AS (SELECT qualified_name, 0 FROM changed UNION SELECT bw.target, r.d + 1 FROM r JOIN bw ON bw.source = r.q WHERE r.d < 2),
pred AS (SELECT DISTINCT split_part(file_path, '/', 2) AS repo, file_path FROM r JOIN nodes ON qualified_name = q),
act AS (SELECT DISTINCT split_part(file_path, '/', 2) AS repo, file_path FROM (
  SELECT n.file_path FROM edges e JOIN nodes n ON n.qualified_name = e.source WHERE e.kind IN ('CALLS', 'IMPORTS_FROM') AND e.target IN (SELECT qualified_name FROM changed)
  UNION ALL SELECT file_path FROM changed_files)),
c AS (SELECT coalesce(p.repo, a.repo) AS repo, count(p.file_path) AS predicted, count(a.file_path) AS actual, count(*) FILTER (p.file_path IS NOT NULL AND a.file_path IS NOT NULL) AS hit
 FROM pred p FULL JOIN act a ON a.file_path = p.file_path GROUP BY 1)
-- An empty side gives 0 for its ratio, and F1 is 0 when both ratios are.
SELECT repo, predicted, actual, hit, round(p + 1e-9::DOUBLE, 4) AS precision, round(r + 1e-9::DOUBLE, 4) AS recall,
 round(CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END + 1e-9::DOUBLE, 4) AS f1
FROM (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted::DOUBLE ELSE 0.0::DOUBLE END AS p, CASE WHEN actual > 0 THEN hit / actual::DOUBLE ELSE 0.0::DOUBLE END AS r FROM c)"""))
def impact_accuracy(w: Workspace) -> DataFrame:
    repo = F.split("file_path", "/")[1].alias("repo")
    predicted = T.impact_radius(w.graph, w.changed_files, max_nodes=None).select("file_path").distinct().select(repo, "file_path")
    actual = EV.changed_file_truth(w.graph, w.changed_files).select(repo, "file_path")
    return EV.precision_recall(predicted, actual, ["repo"], "file_path")


@register("search_mrr", """
WITH r AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos FROM documents)
SELECT lang, coalesce(1.0::DOUBLE / min(pos) FILTER (contains(source, '7')), 0.0) AS reciprocal_rank FROM r GROUP BY lang""")
def search_mrr(w: Workspace) -> DataFrame:
    docs = w.table("documents").select("doc_id", "lang", "source", "n_chars")
    ranked = rank_rows(docs, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], "pos").withColumn("pos", F.col("pos") + 1)
    return EV.reciprocal_rank(ranked, ["lang"], "pos", F.contains("source", F.lit("7")))


@register("token_totals", "SELECT role, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def token_totals(w: Workspace) -> DataFrame:
    return EV.token_totals(w.table("conversations"), ["role"], "text")


@register("token_efficiency", """
WITH t AS (SELECT source, sum(length(text) // 4)::DOUBLE AS raw, sum(greatest(n_chars // 40, 1))::DOUBLE AS g FROM documents GROUP BY source)
SELECT source, round(g / raw + 1e-9::DOUBLE, 4) AS ratio, round((1.0::DOUBLE - g / raw) * 100 + 1e-9::DOUBLE, 2) AS reduction FROM t""")
def token_efficiency(w: Workspace) -> DataFrame:
    t = w.table("documents").groupBy("source").agg(
        F.sum(token_estimate(F.col("text"))).alias("raw"),
        F.sum(F.greatest(F.floor(F.col("n_chars") / 40), F.lit(1))).alias("g"))
    ratio, reduction = EV.token_efficiency(F.col("raw"), F.col("g"))
    return t.select("source", ratio.alias("ratio"), reduction.alias("reduction"))


@register("evaluation_pivot", """
SELECT event_type AS repo, round(avg(value / 1000.0::DOUBLE) + 1e-9::DOUBLE, 4) AS mrr, arg_max(value, event_id) AS f1, CAST(arg_max(user_id, event_id) AS DOUBLE) AS recall FROM events GROUP BY 1""")
def evaluation_pivot(w: Workspace) -> DataFrame:
    results = w.table("events").select(
        F.col("event_type").alias("repo"), (F.col("value") / 1000.0).alias("reciprocal_rank"),
        F.col("value").alias("f1"), F.col("user_id").cast("double").alias("recall"), F.col("event_id").alias("seq"))
    return EV.report_pivot(results)


@register("flow_recall", flow("""
WITH x AS (SELECT DISTINCT replace(p_name, ' ', '_') AS expected FROM part)
SELECT count(*) AS expected, count(*) FILTER (EXISTS (SELECT 1 FROM flows WHERE contains(lower(entry_point), x.expected))) AS found,
 round(count(*) FILTER (EXISTS (SELECT 1 FROM flows WHERE contains(lower(entry_point), x.expected))) / count(*)::DOUBLE + 1e-9::DOUBLE, 4) AS recall FROM x"""))
def flow_recall(w: Workspace) -> DataFrame:
    expected = w.table("part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("expected")).distinct()
    return EV.flow_recall(w.flows, expected)


# --- further forms -----------------------------------------------------------


@register("impact_radius_stop_on_size", graph("""
WITH bw AS MATERIALIZED (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
r(q, d) AS (SELECT qualified_name, 0 FROM nodes WHERE file_path IN (SELECT file_path FROM changed_files) UNION SELECT bw.target, r.d + 1 FROM r JOIN bw ON bw.source = r.q WHERE r.d < 6),
near AS MATERIALIZED (SELECT q, min(d) AS depth FROM r GROUP BY q),
named AS MATERIALIZED (SELECT n.qualified_name, near.depth FROM near JOIN nodes n ON n.qualified_name = near.q),
shown AS (SELECT * FROM named WHERE depth = 0 UNION ALL (SELECT * FROM named WHERE depth > 0 ORDER BY depth, qualified_name LIMIT 1000))
SELECT shown.*, total AS total_impacted, total > 1000 AS truncated FROM shown, (SELECT count(*) FILTER (depth > 0) AS total FROM named)"""))
def impact_radius_stop_on_size(w: Workspace) -> DataFrame:
    return T.impact_radius(w.graph, w.changed_files, 6, 1000).select("qualified_name", "depth", "total_impacted", "truncated")


@register("communities_refresh", graph("SELECT community_id, qualified_name FROM file_members"))
def communities_refresh(w: Workspace) -> DataFrame:
    return C.refresh_communities(w.graph, w.file_members, w.changed_files)


@register("hub_edges", graph("""
WITH h AS (SELECT target AS q FROM edges WHERE kind = 'CALLS' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT kind, source, target, file_path, line FROM edges WHERE source = (SELECT q FROM h) OR target = (SELECT q FROM h)"""))
def hub_edges(w: Workspace) -> DataFrame:
    return L.edges_of_node(w.graph, SM.hub_functions(w.graph, 1).first()["qualified_name"]).select(*S.EDGE_KEY)
