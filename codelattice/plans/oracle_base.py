"""Shared SQL of the checks: the commerce tables as graph, findings and flows."""

from __future__ import annotations

GRAPH = """
np AS (SELECT max(p_partkey) + 1 AS n FROM part),
sym0 AS (
  SELECT p_partkey AS k, p_size, p_retailprice, replace(p_brand, '#', '') AS brand, p_brand,
    CASE p_size % 10 WHEN 0 THEN 'Class' WHEN 1 THEN 'Test' ELSE 'Function' END AS kind,
    replace(p_name, ' ', '_') || '_' || p_partkey AS base,
    upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2)
      || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)
      || p_partkey AS class_name,
    'src/' || lower(p_type) || '/m' || (p_partkey // 40) || '.py' AS file_path,
    CAST(p_partkey % 40 * 60 + 1 AS INTEGER) AS line_start
  FROM part),
sym1 AS (
  SELECT k, kind, file_path, line_start, base, brand, p_brand,
    CASE WHEN kind = 'Class' THEN class_name WHEN kind = 'Test' THEN 'test_' || base
         WHEN p_size % 20 = 2 THEN 'handle_' || base ELSE base END AS name,
    CASE WHEN p_size <> 49 THEN CAST(line_start + p_size AS INTEGER) END AS line_end,
    CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' ELSE '' END AS language,
    CASE WHEN p_size % 10 IN (3, 4) THEN brand END AS parent_name,
    CASE WHEN kind <> 'Class' THEN '(' || lower(brand) || ', ' || p_size || ')' END AS params,
    CASE WHEN kind <> 'Class' AND p_retailprice > 1000 THEN 'float' END AS return_type,
    kind = 'Test' AS is_test, p_size % 20 = 5 AS decorated
  FROM sym0),
sym AS MATERIALIZED (
  SELECT *, file_path || '::' || coalesce(parent_name || '.', '') || name AS qualified_name FROM sym1),
nodes AS MATERIALIZED (
  SELECT kind, name, qualified_name, file_path, line_start, line_end, language, parent_name, params,
         return_type, is_test, decorated FROM sym
  UNION ALL
  SELECT 'File', file_path, file_path, file_path, 1, CAST(max(line_start) + 59 AS INTEGER), 'python',
         NULL, NULL, NULL, false, false FROM sym GROUP BY file_path),
refs AS (
  SELECT s.file_path, CAST(s.line_start + l.l_linenumber AS INTEGER) AS line, CAST(l.l_quantity AS INTEGER) AS q,
         coalesce(l.l_returnflag = 'R' AND l.l_quantity >= 42, false) AS coded,
         s.qualified_name AS src, s.is_test AS src_test, d.qualified_name AS dst, d.name AS dst_name,
         d.file_path AS dst_file, p.s_name
  FROM lineitem l CROSS JOIN np
  JOIN sym s ON s.k = l.l_orderkey % np.n
  JOIN sym d ON d.k = l.l_partkey
  LEFT JOIN supplier p ON p.s_suppkey = l.l_suppkey),
kinded AS (
  SELECT *, CASE WHEN coded THEN CASE WHEN q IN (45, 43) THEN 'IMPORTS_FROM' WHEN q = 44 THEN 'INHERITS'
              WHEN q = 42 THEN 'DEPENDS_ON' ELSE 'CALLS' END
            ELSE CASE q % 4 WHEN 0 THEN 'DEPENDS_ON' WHEN 1 THEN 'REFERENCES' WHEN 2 THEN 'IMPLEMENTS' ELSE 'IMPORTS_FROM' END
            END AS kind FROM refs),
typed AS (
  SELECT kind,
         CASE WHEN kind = 'IMPORTS_FROM' THEN file_path ELSE src END AS source,
         CASE WHEN coded AND q = 47 THEN s_name WHEN kind = 'IMPLEMENTS' OR (coded AND q IN (46, 44)) THEN dst_name
              WHEN coded AND q = 45 THEN dst_file ELSE dst END AS target,
         file_path, line, coded AND q >= 48 AND src_test AS tested
  FROM kinded),
edges AS MATERIALIZED (
  SELECT kind, source, target, file_path, line FROM typed WHERE source <> target
  UNION
  SELECT 'TESTED_BY', target, source, file_path, line FROM typed WHERE source <> target AND tested
  UNION
  SELECT 'CONTAINS', file_path, qualified_name, file_path, line_start FROM sym),
changed_files AS MATERIALIZED (
  SELECT DISTINCT file_path FROM sym JOIN lineitem ON l_partkey = k
  WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)),
changed_ranges AS MATERIALIZED (
  SELECT DISTINCT file_path, CAST(line_start + l_linenumber * 7 AS INTEGER) AS start,
         CAST(line_start + l_linenumber * 7 + l_quantity % 20 AS INTEGER) AS stop
  FROM lineitem JOIN sym ON k = l_partkey),
file_members AS MATERIALIZED (
  SELECT file_path AS community_id, qualified_name FROM nodes
  WHERE file_path IN (SELECT file_path FROM nodes GROUP BY 1 HAVING count(*) >= 2))
"""

ENTRY = r"regexp_matches(name, '^main$|^__main__$|^test_|^Test[A-Z]|^on_|^handle_')"
# Part names hold no security words, so the checks use words they do hold.
WORDS = ("ring", "bolt")
SECURE = "(contains(lower(name), 'ring') OR contains(lower(name), 'bolt'))"

FLOWS = f"""
entry_nodes AS (
  SELECT * FROM nodes n WHERE kind IN ('Function', 'Test')
  AND ({ENTRY} OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target = n.qualified_name))),
rc AS MATERIALIZED (
  SELECT source, target, min(line) AS line FROM edges
  WHERE kind = 'CALLS' AND target IN (SELECT qualified_name FROM nodes) GROUP BY 1, 2),
walk(root, node, depth, trail) AS (
  SELECT qualified_name, qualified_name, 0, CAST([] AS VARCHAR[]) FROM entry_nodes
  WHERE qualified_name IN (SELECT source FROM rc WHERE source <> target)
  UNION ALL
  SELECT w.root, c.target, w.depth + 1, list_append(w.trail, lpad(CAST(c.line AS VARCHAR), 9, '0') || c.target)
  FROM walk w JOIN rc c ON c.source = w.node
  WHERE w.depth < 15 AND c.target <> w.root
    AND NOT list_contains(list_transform(w.trail, lambda t: substr(t, 10)), c.target)),
least_depth AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY 1, 2),
members AS MATERIALIZED (
  SELECT w.root, w.node, w.depth, min(w.trail) AS trail FROM walk w
  JOIN least_depth d ON d.root = w.root AND d.node = w.node AND d.depth = w.depth GROUP BY 1, 2, 3),
positioned AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, trail) - 1 AS position FROM members),
features AS MATERIALIZED (
  SELECT n.qualified_name AS node, n.file_path, CASE WHEN {SECURE} THEN 1 ELSE 0 END AS security,
    (SELECT count(*) FROM edges e WHERE e.kind = 'CALLS' AND e.source = n.qualified_name
       AND e.target NOT IN (SELECT qualified_name FROM nodes)) AS ext,
    CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'TESTED_BY' AND e.target = n.qualified_name) THEN 1 ELSE 0 END AS tested
  FROM nodes n),
flow_sums AS (
  SELECT root, max(depth) AS depth, count(*) AS node_count, count(DISTINCT file_path) AS file_count,
         CAST(sum(ext) AS BIGINT) AS external_calls, CAST(sum(security) AS BIGINT) AS security_hits,
         CAST(sum(tested) AS BIGINT) AS tested_nodes
  FROM members JOIN features USING (node) GROUP BY root HAVING count(*) >= 2),
flows AS MATERIALIZED (
  SELECT root AS entry_point, name, depth, node_count, file_count, external_calls, security_hits, tested_nodes,
    round(least(greatest(
      (CASE WHEN file_count > 1 THEN least((file_count - 1) / 4.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END) * 0.30::DOUBLE
      + least(external_calls / 5.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE
      + least(security_hits / node_count::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE
      + (1.0::DOUBLE - tested_nodes / node_count::DOUBLE) * 0.15::DOUBLE
      + least(depth / 10.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) + 1e-9::DOUBLE, 4) AS criticality
  FROM flow_sums JOIN nodes ON qualified_name = root)
"""

FINDINGS = """
raw AS MATERIALIZED (
  SELECT event_id AS seq, 'rule.' || event_type || '.' || (event_id % 5) AS rule_id,
    'user/' || user_id AS file_path,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS line_start,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) + CAST(floor(value) AS INTEGER) % 4 AS INTEGER) AS line_end,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'CWE-0' || (event_id % 7) END AS cwe,
    CASE event_id % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'WARNING' WHEN 4 THEN 'INFO' END AS severity,
    CAST(ts AS DATE) AS run_day, value
  FROM events),
norm AS MATERIALIZED (
  SELECT seq, rule_id, file_path, line_start, line_end, cwe, run_day, value, severity AS raw_severity,
    CASE coalesce(severity, 'MEDIUM') WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'ERROR' THEN 'HIGH' WHEN 'HIGH' THEN 'HIGH'
      WHEN 'INFO' THEN 'LOW' WHEN 'LOW' THEN 'LOW' ELSE 'MEDIUM' END AS severity,
    sha256(rule_id || ':' || file_path || ':' || line_start) AS fingerprint
  FROM raw)
"""


def over(*parts: str, sql: str) -> str:
    """Shared tables, then the body; a body may open with its own ``WITH``."""
    body = sql.strip()
    shared = ",\n".join(p.strip() for p in parts)
    if body.upper().startswith(("WITH ", "WITH\n")):
        return f"WITH RECURSIVE {shared},\n{body[5:]}"
    return f"WITH RECURSIVE {shared}\n{body}"


def graph(sql: str) -> str:
    return over(GRAPH, sql=sql)


def flow(sql: str) -> str:
    return over(GRAPH, FLOWS, sql=sql)


def found(sql: str) -> str:
    return over(FINDINGS, sql=sql)
