"""Registered finding, rule, search and text analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions import findings as X
from codelattice.functions.numbers import rounded
from codelattice.operators import findings as FD
from codelattice.operators import relations as R
from codelattice.operators import rules as RU
from codelattice.operators import search as SE
from codelattice.plans.oracle_base import FINDINGS, GRAPH, found, graph, over
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


# --- findings ----------------------------------------------------------------


@register("finding_normalise", found("""
SELECT seq, rule_id, severity, fingerprint, split_part(rule_id, '.', 3) AS title FROM norm"""))
def finding_normalise(w: Workspace) -> DataFrame:
    return w.normalised.select("seq", "rule_id", "severity", "fingerprint", "title")


@register("fingerprints", found("SELECT fingerprint, count(*) AS sightings FROM norm GROUP BY 1"))
def fingerprints(w: Workspace) -> DataFrame:
    return w.normalised.groupBy("fingerprint").agg(F.count("*").alias("sightings"))


@register("cwe_normalise", found("""
SELECT seq, CASE WHEN cwe = '' THEN '' ELSE 'CWE-' || CAST(CAST(substr(cwe, 5) AS INTEGER) AS VARCHAR) END AS cwe_id,
 'CWE-' || (seq % 100) || ': TEXT' AS full_text FROM raw"""))
def cwe_normalise(w: Workspace) -> DataFrame:
    worded = F.concat(F.lit("cwe-"), (F.col("seq") % 100).cast("string"), F.lit(": Text"))
    return w.findings.select("seq", X.normalise_cwe(F.col("cwe")).alias("cwe_id"), X.normalise_cwe(worded).alias("full_text"))


@register("cvss_bands", found("""
SELECT CASE WHEN s >= 9 THEN 'Critical' WHEN s >= 7 THEN 'High' WHEN s >= 4 THEN 'Medium' ELSE 'Low' END AS rating, count(*) AS n FROM (SELECT line_start / 10.0 AS s FROM raw) GROUP BY 1"""))
def cvss_bands(w: Workspace) -> DataFrame:
    return w.findings.select(X.cvss_rating(F.col("line_start") / 10.0).alias("rating")).groupBy("rating").agg(F.count("*").alias("n"))


DEDUP = """
dd AS (SELECT *, CASE WHEN cwe = '' THEN '' ELSE 'CWE-' || CAST(CAST(substr(cwe, 5) AS INTEGER) AS VARCHAR) END AS key,
  CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 ELSE 2 END AS rnk FROM raw),
sw AS (SELECT *, max(line_end) OVER (PARTITION BY {part}file_path, key ORDER BY line_start, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM dd WHERE key <> ''),
cl AS (SELECT *, sum(CASE WHEN reach IS NULL OR line_start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {part}file_path, key ORDER BY line_start, seq) AS cluster FROM sw),
best AS (SELECT *, count(*) OVER (PARTITION BY {part}file_path, key, cluster) AS merged, row_number() OVER (PARTITION BY {part}file_path, key, cluster ORDER BY rnk DESC, length(rule_id) DESC, line_start, seq) AS rn FROM cl)
"""


@register("finding_dedup", over(FINDINGS, DEDUP.format(part=""), sql="""
SELECT seq, rule_id, file_path, line_start, line_end, cwe, severity, merged FROM best WHERE rn = 1
UNION ALL SELECT seq, rule_id, file_path, line_start, line_end, cwe, severity, 1 FROM dd WHERE key = ''"""))
def finding_dedup(w: Workspace) -> DataFrame:
    return FD.deduplicate(w.findings.drop("value", "run_day"))


@register("finding_dedup_per_run", over(FINDINGS, DEDUP.format(part="run_day, "), sql="""
SELECT seq, run_day, merged FROM best WHERE rn = 1 UNION ALL SELECT seq, run_day, 1 FROM dd WHERE key = ''"""))
def finding_dedup_per_run(w: Workspace) -> DataFrame:
    return FD.deduplicate(w.findings.drop("value"), ("run_day",)).select("seq", "run_day", "merged")


HISTORY = """
hist AS MATERIALIZED (SELECT fingerprint, arg_min(rule_id, (run_day, seq)) AS rule_id, arg_min(severity, (run_day, seq)) AS severity, arg_min(file_path, (run_day, seq)) AS file_path,
  arg_min(line_start, (run_day, seq)) AS line_start, arg_min(line_end, (run_day, seq)) AS line_end, arg_min(cwe, (run_day, seq)) AS cwe,
  arg_max(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), (run_day, seq)) AS snippet, min(run_day) AS first_run, max(run_day) AS last_run, count(DISTINCT run_day) AS runs, 'open' AS status FROM norm GROUP BY 1)
"""


def hist(sql: str) -> str:
    return over(FINDINGS, HISTORY, sql=sql)


@register("finding_history", hist("SELECT * FROM hist"))
def finding_history(w: Workspace) -> DataFrame:
    return w.history.drop("title")


def _last_run(w: Workspace):
    return w.findings.agg(F.max("run_day")).first()[0]


@register("finding_upsert", hist("""
SELECT fingerprint, severity, snippet, first_run, last_run, status, first_run = (SELECT max(run_day) FROM raw) AS is_new, last_run = (SELECT max(run_day) FROM raw) AS in_run FROM hist"""))
def finding_upsert(w: Workspace) -> DataFrame:
    """The last run merged into the store of all earlier runs."""
    last = _last_run(w)
    stored = FD.fold_history(w.normalised.where(F.col("run_day") < F.lit(last)), run="run_day").drop("runs")
    incoming = w.normalised.where(F.col("run_day") == F.lit(last)).select(
        "fingerprint", "rule_id", "title", "severity", "file_path", "line_start", "line_end", "cwe", "snippet", "seq")
    return FD.upsert(stored, incoming, last).select(
        "fingerprint", "severity", "snippet", "first_run", "last_run", "status", "is_new", "in_run")


RUNS = """
links AS MATERIALIZED (SELECT DISTINCT run_day, fingerprint FROM norm),
ord AS (SELECT run_day, lead(run_day) OVER (ORDER BY run_day) AS next_run, lag(run_day) OVER (ORDER BY run_day) AS prev_run FROM (SELECT DISTINCT run_day FROM links)),
moved AS (SELECT next_run AS run_day, fingerprint FROM links JOIN ord USING (run_day) WHERE next_run IS NOT NULL),
cmp AS MATERIALIZED (SELECT coalesce(l.run_day, m.run_day) AS run_day, coalesce(l.fingerprint, m.fingerprint) AS fingerprint,
  CASE WHEN m.fingerprint IS NULL THEN 'new' WHEN l.fingerprint IS NULL THEN 'fixed' ELSE 'recurring' END AS change
  FROM links l FULL JOIN moved m ON l.run_day = m.run_day AND l.fingerprint = m.fingerprint)
"""


def runs(sql: str) -> str:
    return over(FINDINGS, RUNS, sql=sql)


@register("run_diff", runs("SELECT * FROM cmp"))
def run_diff(w: Workspace) -> DataFrame:
    return FD.compare_runs(FD.run_links(w.normalised, "run_day"), "run_day")


@register("run_diff_latest", runs("SELECT fingerprint, change FROM cmp WHERE run_day = (SELECT max(run_day) FROM raw)"))
def run_diff_latest(w: Workspace) -> DataFrame:
    return FD.compare_with_previous(FD.run_links(w.normalised, "run_day"), _last_run(w), "run_day")


@register("run_counters", runs("""
SELECT run_day, count(*) FILTER (change = 'new') AS "new", count(*) FILTER (change = 'recurring') AS recurring, count(*) FILTER (change = 'fixed') AS fixed FROM cmp GROUP BY 1"""))
def run_counters(w: Workspace) -> DataFrame:
    return FD.run_counters(FD.compare_runs(FD.run_links(w.normalised, "run_day"), "run_day"), "run_day")


@register("run_listing", runs("SELECT run_day, count(*) AS findings FROM links GROUP BY 1 ORDER BY 1 DESC LIMIT 20"))
def run_listing(w: Workspace) -> DataFrame:
    per_run = FD.run_links(w.normalised, "run_day").groupBy(F.col("run_day").alias("run_id")).agg(F.count("*").alias("findings"))
    return FD.latest_runs(per_run).withColumnRenamed("run_id", "run_day")


@register("run_findings", over(FINDINGS, HISTORY, sql="""
SELECT DISTINCT n.run_day, n.fingerprint, h.severity, CASE h.severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END AS severity_order
FROM norm n JOIN hist h USING (fingerprint)"""))
def run_findings(w: Workspace) -> DataFrame:
    return FD.run_findings(w.history, FD.run_links(w.normalised, "run_day"), "run_day").select(
        "run_day", "fingerprint", "severity", "severity_order")


VERDICTS = """
judged AS MATERIALIZED (SELECT h.*, CASE line_start % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'FALSE_POSITIVE' WHEN 2 THEN 'NEEDS_REVIEW' END AS verdict,
  CASE WHEN line_start % 5 <> 0 THEN line_start / 10.0::DOUBLE END AS cvss_score, CASE WHEN line_start % 3 = 0 THEN 'detail' ELSE '' END AS description FROM hist h),
old_count AS (SELECT file_path, count(*) AS n FROM raw WHERE run_day < (SELECT max(run_day) FROM raw) GROUP BY 1),
new_count AS (SELECT file_path, count(*) AS n FROM raw GROUP BY 1),
cached AS (SELECT j.*, substr(sha256(j.file_path || ':' || o.n), 1, 16) AS file_hash, coalesce(substr(sha256(c.file_path || ':' || c.n), 1, 16), 'missing') AS current_hash
  FROM judged j LEFT JOIN old_count o ON o.file_path = j.file_path LEFT JOIN new_count c ON c.file_path = j.file_path)
"""


def judged(w: Workspace) -> DataFrame:
    k = F.col("line_start")
    return w.history.select(
        "*",
        F.when(k % 4 == 0, "CONFIRMED").when(k % 4 == 1, "FALSE_POSITIVE").when(k % 4 == 2, "NEEDS_REVIEW").alias("verdict"),
        F.when(k % 5 != 0, k / 10.0).alias("cvss_score"),
        F.when(k % 3 == 0, "detail").otherwise("").alias("description"),
        F.lit(None).cast("string").alias("verdict_severity"), F.lit("events").alias("source"),
    )


@register("verdict_cache", over(FINDINGS, HISTORY, VERDICTS, sql="""
SELECT fingerprint, verdict, verdict IS NOT NULL AND coalesce(file_hash IS NULL OR file_hash = current_hash, true) AND (cvss_score IS NOT NULL OR description <> '') AS hit,
 verdict IS NOT NULL AND NOT coalesce(file_hash IS NULL OR file_hash = current_hash, true) AS stale FROM cached"""))
def verdict_cache(w: Workspace) -> DataFrame:
    last = w.findings.agg(F.max("run_day")).scalar()

    def hashes(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("file_path").agg(F.count("*").alias("n"))
        return counts.select("file_path", X.content_hash(F.concat_ws(":", "file_path", F.col("n").cast("string"))).alias(name))

    stored = judged(w).join(hashes(w.findings.where(F.col("run_day") < last), "file_hash"), "file_path", "left").select(
        "fingerprint", "verdict", "cvss_score", "description", "file_hash")
    return FD.verdict_cache(w.history, stored, hashes(w.findings, "current_hash")).select("fingerprint", "verdict", "hit", "stale")


@register("severity_matrix", over(FINDINGS, HISTORY, VERDICTS, sql="""
SELECT coalesce(s, '*') AS severity, coalesce(v, '*') AS verdict, count(*) AS findings FROM (SELECT coalesce(severity, 'UNKNOWN') AS s, coalesce(verdict, 'UNANALYSED') AS v FROM judged)
GROUP BY GROUPING SETS ((s), (v), ())"""))
def severity_matrix(w: Workspace) -> DataFrame:
    return FD.severity_matrix(judged(w))


@register("finding_page", over(FINDINGS, HISTORY, VERDICTS, sql="""
SELECT fingerprint, severity, file_path, line_start, (SELECT count(*) FROM judged WHERE verdict = 'CONFIRMED' AND file_path ILIKE '%user/1%') AS total FROM judged
WHERE verdict = 'CONFIRMED' AND file_path ILIKE '%user/1%'
ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, file_path, line_start, fingerprint LIMIT 100 OFFSET 10"""))
def finding_page(w: Workspace) -> DataFrame:
    page, total = FD.list_findings(judged(w), verdict="confirmed", file_path="user/1", offset=10)
    return page.select("fingerprint", "severity", "file_path", "line_start", total.scalar().alias("total"))


@register("finding_text_filter", over(FINDINGS, HISTORY, VERDICTS, sql="SELECT fingerprint, file_path FROM judged WHERE verdict IS NULL AND (contains(lower(rule_id), 'error') OR contains(lower(file_path), 'error'))"))
def finding_text_filter(w: Workspace) -> DataFrame:
    return FD.text_filter(judged(w), "ERROR", "UNANALYSED").select("fingerprint", "file_path")


@register("verdict_write", over(FINDINGS, HISTORY, VERDICTS, sql="""
SELECT fingerprint, CASE WHEN severity = 'CRITICAL' THEN 'CONFIRMED' ELSE verdict END AS verdict, CASE WHEN severity = 'CRITICAL' THEN 9.5::DOUBLE ELSE cvss_score END AS cvss_score FROM judged"""))
def verdict_write(w: Workspace) -> DataFrame:
    fresh = w.history.where(F.col("severity") == "CRITICAL").select(
        "fingerprint", F.lit("CONFIRMED").alias("verdict"), F.lit(9.5).alias("cvss_score"))
    return FD.set_verdicts(judged(w), fresh).select("fingerprint", "verdict", "cvss_score")


ANSWER = """'Some notes' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'VERDICT: ' || CASE WHEN toxic = 1 THEN 'confirmed' WHEN quality = 1 THEN 'FALSE_POSITIVE' ELSE 'Needs_Review' END || chr(10) END
 || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'SEVERITY: high' || chr(10) END || 'CVSS: ' || CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE (doc_id % 10) || '.5' END || chr(10)
 || 'POC: ' || CASE WHEN doc_id % 2 = 0 THEN 'N/A' ELSE 'curl ' || doc_id END || chr(10) || 'REASONING: because ' || doc_id || chr(10) || 'second line'"""


def answer_text():
    d, nl = F.col("doc_id"), F.lit("\n")
    word = F.when(F.col("toxic") == 1, "confirmed").when(F.col("quality") == 1, "FALSE_POSITIVE").otherwise("Needs_Review")
    return F.concat(
        F.lit("Some notes"), nl, F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("VERDICT: "), word, nl)),
        F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("SEVERITY: high"), nl)),
        F.lit("CVSS: "), F.when(d % 4 == 0, "none").otherwise(F.concat((d % 10).cast("string"), F.lit(".5"))), nl,
        F.lit("POC: "), F.when(d % 2 == 0, "N/A").otherwise(F.concat(F.lit("curl "), d.cast("string"))), nl,
        F.lit("REASONING: because "), d.cast("string"), nl, F.lit("second line"))


@register("verdict_parse", f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'NEEDS_REVIEW' WHEN toxic = 1 THEN 'CONFIRMED' WHEN quality = 1 THEN 'FALSE_POSITIVE' ELSE 'NEEDS_REVIEW' END AS verdict,
 CASE WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
 CASE WHEN doc_id % 5 <> 0 THEN 'because ' || doc_id || chr(10) || 'second line' ELSE 'LLM analysis could not produce a verdict.' END AS reasoning,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 1 THEN 'curl ' || doc_id END AS poc,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 <> 0 THEN doc_id % 10 + 0.5::DOUBLE END AS cvss_score, length({ANSWER}) AS chars FROM labels""")
def verdict_parse(w: Workspace) -> DataFrame:
    v = w.table("labels").select("doc_id", answer_text().alias("answer")).withColumn("v", X.parse_verdict(F.col("answer")))
    return v.select("doc_id", "v.verdict", "v.severity", "v.reasoning", "v.poc", "v.cvss_score", F.length("answer").cast("bigint").alias("chars"))


@register("hunt_answer_parse", """
SELECT doc_id AS entry, pos, 'hunter.sql-injection-' || pos AS rule_id, 'SQL Injection ' || pos AS title, CASE WHEN toxic = 1 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
 'app/f' || doc_id || '.py' AS file_path, CAST(doc_id % 100 AS INTEGER) AS line_start, 'why ' || quality AS message FROM labels, (SELECT unnest([0, 1]) AS pos)
WHERE pos <= quality""")
def hunt_answer_parse(w: Workspace) -> DataFrame:
    d, nl = F.col("doc_id"), F.lit("\n")

    def block(i: int):
        return F.concat(
            F.lit(f"FINDING_START\nvuln_type: SQL Injection {i}\n"),
            F.when(F.col("toxic") == 1, "severity: critical\n").otherwise(""),
            F.lit("location: app/f"), d.cast("string"), F.lit(".py:"), (d % 100).cast("string"), nl,
            F.lit("reasoning: why "), F.col("quality").cast("string"), F.lit("\nFINDING_END\n"))

    answers = w.table("labels").select("doc_id", F.concat(block(0), F.when(F.col("quality") == 1, block(1)).otherwise("")).alias("answer"))
    return FD.parse_hunt_answers(answers, "answer", "doc_id").select(
        "entry", "pos", "rule_id", "title", "severity", "file_path", "line_start", "message")


# --- rules -------------------------------------------------------------------

RULES = """
classes AS (SELECT id, upper(substr(id, 1, 1)) || substr(id, 2) AS name, 'CWE-' || (length(id) * 10) AS cwe_id, CASE length(id) WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS id FROM part)),
sigs AS MATERIALIZED (SELECT 'sig-' || replace(p_name, ' ', '-') AS id, replace(p_name, ' ', '_') AS qualified_pattern, split_part(p_name, ' ', 2) AS vuln_class_id,
  CASE length(split_part(p_name, ' ', 1)) % 3 WHEN 0 THEN 'SINK' WHEN 1 THEN 'SOURCE' ELSE 'SANITIZER' END AS sig_type,
  CASE WHEN length(split_part(p_name, ' ', 1)) % 2 = 0 THEN 'any' ELSE 'python' END AS language, min(p_partkey) AS seq FROM part GROUP BY p_name),
uncalled AS MATERIALIZED (SELECT qualified_name, file_path FROM nodes n WHERE kind IN ('Function', 'Method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'CALLS' AND e.target = n.qualified_name)),
near3(root, node, d) AS (SELECT qualified_name, qualified_name, 0 FROM uncalled UNION SELECT r.root, e.target, r.d + 1 FROM near3 r JOIN edges e ON e.kind = 'CALLS' AND e.source = r.node WHERE r.d < 3),
reached AS MATERIALIZED (SELECT DISTINCT root, node FROM near3 WHERE node <> root),
sinks AS MATERIALIZED (SELECT DISTINCT r.root AS entry, s.vuln_class_id, split_part(r.node, '::', -1) AS matched_sink
  FROM reached r JOIN sigs s ON s.sig_type = 'SINK' AND contains(lower(r.node), lower(s.qualified_pattern))),
signals AS MATERIALIZED (SELECT entry, vuln_class_id, array_to_string(list_sort(list(matched_sink)), ',') AS matched_sinks FROM sinks GROUP BY 1, 2)
"""


def rules(sql: str) -> str:
    return over(GRAPH, RULES, sql=sql)


@register("taint_signatures", rules("SELECT * FROM sigs"))
def taint_signatures(w: Workspace) -> DataFrame:
    return w.signatures


@register("signature_lookup", rules("SELECT id, qualified_pattern FROM sigs WHERE sig_type = 'SINK' AND language IN ('any', 'python')"))
def signature_lookup(w: Workspace) -> DataFrame:
    return RU.signatures_by(w.signatures, "sink", language="python").select("id", "qualified_pattern")


@register("rule_counts", rules("SELECT 'vuln_classes' AS table_name, count(*) AS row_count FROM classes UNION ALL SELECT 'taint_signatures', count(*) FROM sigs UNION ALL SELECT 'detectors', count(DISTINCT p_brand) FROM part"))
def rule_counts(w: Workspace) -> DataFrame:
    return RU.rule_counts(w.rule_classes, w.signatures, w.table("part").select("p_brand").distinct())


@register("rule_override", rules("""
SELECT id, CASE WHEN seq % 2 = 0 THEN 'custom' ELSE 'builtin' END AS origin, qualified_pattern FROM sigs"""))
def rule_override(w: Workspace) -> DataFrame:
    builtin = w.signatures.withColumn("origin", F.lit("builtin"))
    custom = w.signatures.where(F.col("seq") % 2 == 0).withColumn("origin", F.lit("custom"))
    return RU.combine_sources([builtin, custom]).select("id", "origin", "qualified_pattern")


@register("sink_match", rules("""
SELECT n.name, s.qualified_pattern FROM (SELECT DISTINCT target AS name FROM edges WHERE kind = 'CALLS') n JOIN sigs s ON contains(lower(n.name), lower(s.qualified_pattern))"""))
def sink_match(w: Workspace) -> DataFrame:
    names = w.graph.edges_of("CALLS").select(F.col("target").alias("name")).distinct()
    return RU.contains_join(names, "name", w.signatures.select("qualified_pattern"), "qualified_pattern")


@register("signal_match", rules("SELECT s.entry, s.vuln_class_id, c.severity, c.cwe_id, s.matched_sink FROM sinks s JOIN classes c ON c.id = s.vuln_class_id"))
def signal_match(w: Workspace) -> DataFrame:
    found_ = RU.detect_signals(w.graph, R.uncalled_functions(w.graph, None), w.signatures, w.rule_classes)
    return found_.select("entry", "vuln_class_id", "severity", "cwe_id", "matched_sink")


@register("signal_prompts", rules("""
WITH lists AS (SELECT vuln_class_id, list_sort(list(DISTINCT qualified_pattern) FILTER (sig_type = 'SOURCE')) AS so, list_sort(list(DISTINCT qualified_pattern) FILTER (sig_type = 'SANITIZER')) AS sa FROM sigs GROUP BY 1)
SELECT s.entry, s.vuln_class_id, c.name || ' (' || c.cwe_id || ') [' || c.severity || '] sinks: ' || array_to_string(string_split(s.matched_sinks, ','), ', ')
 || '; sources: ' || CASE WHEN coalesce(len(so), 0) > 0 THEN array_to_string(so, ', ') ELSE '-' END || '; sanitizers: ' || CASE WHEN coalesce(len(sa), 0) > 0 THEN array_to_string(sa, ', ') ELSE 'none known' END AS prompt
FROM signals s JOIN classes c ON c.id = s.vuln_class_id LEFT JOIN lists l ON l.vuln_class_id = s.vuln_class_id"""))
def signal_prompts(w: Workspace) -> DataFrame:
    found_ = RU.detect_signals(w.graph, R.uncalled_functions(w.graph, None), w.signatures, w.rule_classes)
    return RU.signal_prompt(found_, w.signatures)


@register("taint_paths", rules("""
WITH cleanless AS MATERIALIZED (SELECT source, target, min(line) AS line FROM edges WHERE kind = 'CALLS' AND NOT contains(lower(target), 'gear') GROUP BY 1, 2),
tp(root, node, d, trail, path) AS (SELECT qualified_name, qualified_name, 0, CAST([] AS VARCHAR[]), [qualified_name] FROM uncalled
 UNION ALL SELECT r.root, e.target, r.d + 1, list_append(r.trail, lpad(CAST(e.line AS VARCHAR), 9, '0') || e.target), list_append(r.path, e.target)
 FROM tp r JOIN cleanless e ON e.source = r.node WHERE r.d < 15 AND NOT list_contains(r.path, e.target)),
hit AS (SELECT root, node, min(d) AS depth FROM tp WHERE d > 0 AND contains(lower(node), 'bolt') GROUP BY 1, 2)
SELECT h.root AS entry, h.node AS sink, h.depth, sha256(array_to_string(min_by(t.path, t.trail), ' > ')) AS path_hash
FROM hit h JOIN tp t ON t.root = h.root AND t.node = h.node AND t.d = h.depth GROUP BY 1, 2, 3"""))
def taint_paths(w: Workspace) -> DataFrame:
    nouns = w.rule_classes.select(F.col("id").alias("pattern"))
    return RU.taint_paths(
        w.graph, R.uncalled_functions(w.graph, None), nouns.where("pattern = 'bolt'"), nouns.where("pattern = 'gear'")
    ).select("entry", "sink", "depth", F.sha2(F.array_join("path", " > "), 256).alias("path_hash"))


@register("sink_states", rules("""
WITH c AS MATERIALIZED (SELECT DISTINCT source, target FROM edges WHERE kind = 'CALLS'),
names AS MATERIALIZED (SELECT DISTINCT target AS node FROM c),
hot AS MATERIALIZED (SELECT DISTINCT node, vuln_class_id AS k FROM names JOIN sigs ON sig_type = 'SINK' AND contains(lower(node), lower(qualified_pattern))),
shut AS MATERIALIZED (SELECT DISTINCT node, vuln_class_id AS k FROM names JOIN sigs ON sig_type = 'SANITIZER' AND contains(lower(node), lower(qualified_pattern))),
r(node, k, passed, d) AS (SELECT c.source, hot.k, EXISTS (SELECT 1 FROM shut WHERE shut.node = hot.node AND shut.k = hot.k), 1 FROM hot JOIN c ON c.target = hot.node
 UNION SELECT c.source, r.k, r.passed OR shut.node IS NOT NULL, r.d + 1 FROM r JOIN c ON c.target = r.node LEFT JOIN shut ON shut.node = r.node AND shut.k = r.k WHERE r.d < 60)
SELECT node AS entry, k AS vuln_class_id, min(d) AS hops, min(d) FILTER (NOT passed) AS open_hops,
 CASE WHEN bool_and(passed) THEN 'guarded' ELSE 'open' END AS state FROM r WHERE node IN (SELECT qualified_name FROM nodes WHERE kind IN ('Function', 'Test')) GROUP BY 1, 2"""))
def sink_states(w: Workspace) -> DataFrame:
    return RU.sink_states(w.graph, w.graph.nodes_of("Function", "Test"), w.signatures)


@register("missing_checks", rules("""
WITH tp(root, node, d) AS (SELECT qualified_name, qualified_name, 0 FROM uncalled UNION SELECT r.root, e.target, r.d + 1 FROM tp r JOIN edges e ON e.kind = 'CALLS' AND e.source = r.node WHERE r.d < 15),
k AS (SELECT id AS check_name FROM classes WHERE id IN ('ring', 'gear'))
SELECT u.qualified_name AS entry, k.check_name FROM uncalled u, k WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.root = u.qualified_name AND contains(lower(tp.node), k.check_name))"""))
def missing_checks(w: Workspace) -> DataFrame:
    checks = w.rule_classes.where(F.col("id").isin("ring", "gear")).select(F.col("id").alias("check_name"), F.col("id").alias("pattern"))
    return RU.missing_checks(w.graph, R.uncalled_functions(w.graph, None), checks)


# --- search ------------------------------------------------------------------

TOKENS = r"""
tok AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents),
st AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS al FROM tok),
flat AS MATERIALIZED (SELECT doc_id, len(words) AS doc_len, unnest(words) AS term, unnest(range(len(words))) AS pos FROM tok)
"""


@register("postings_terms", over(TOKENS, sql="SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS tf FROM flat GROUP BY 1"))
def postings_terms(w: Workspace) -> DataFrame:
    return w.document_index.term_counts().groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("tf").alias("tf"))


BM25 = """
hits AS MATERIALIZED (SELECT a.doc_id, a.doc_len, count(*) AS tf FROM flat a JOIN flat b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.term = '{0}' AND b.term = '{1}' GROUP BY 1, 2),
scored AS MATERIALIZED (SELECT doc_id, tf, doc_len, ln(1.0::DOUBLE + (n - (SELECT count(*) FROM hits) + 0.5::DOUBLE) / ((SELECT count(*) FROM hits) + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / al))) AS score FROM hits, st)
"""


@register("bm25_search", over(TOKENS, BM25.format("in", "the"), sql="SELECT doc_id, tf, doc_len, round(score, 6) AS score FROM scored"))
def bm25_search(w: Workspace) -> DataFrame:
    return w.document_index.phrase_search("in the", None, across=True).select("doc_id", "tf", "doc_len", F.round("score", 6).alias("score"))


@register("bm25_top", over(TOKENS, BM25.format("de", "la"), sql="SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20"))
def bm25_top(w: Workspace) -> DataFrame:
    found = w.document_index.phrase_search("de la", None, across=True)
    return found.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@register("term_search", over(TOKENS, sql="SELECT doc_id, len(words) AS doc_len FROM tok WHERE list_contains(words, 'und') AND list_contains(words, 'der')"))
def term_search(w: Workspace) -> DataFrame:
    return w.document_index.term_search("und der").select("doc_id", "doc_len")


@register("keyword_search", graph("""
SELECT qualified_name AS doc_id, CASE WHEN lower(name) = 'red_bolt' THEN 3.0::DOUBLE WHEN starts_with(lower(name), 'red_bolt') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score
FROM nodes WHERE name ILIKE '%red_bolt%' OR qualified_name ILIKE '%red_bolt%'"""))
def keyword_search(w: Workspace) -> DataFrame:
    return SE.keyword_scores(w.graph, "red_bolt")


@register("rrf_fusion", over(TOKENS, BM25.format("in", "the"), sql="""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 60)),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 60))
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rn)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1"""))
def rrf_fusion(w: Workspace) -> DataFrame:
    docs = w.table("documents")
    by_text = w.document_index.phrase_search("in the", None, across=True)
    by_size = docs.select("doc_id", F.col("n_chars").alias("score"))
    return SE.fuse([by_text.select("doc_id", "score"), by_size], limit=60).select("doc_id", F.round("score", 6).alias("score"))


@register("cosine_topk", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 20""")
def cosine_topk(w: Workspace) -> DataFrame:
    vectors = w.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    query = vectors.where("doc_id = 0").first()["vector"]
    return SE.cosine_top(vectors, query).select("doc_id", F.round("score", 6).alias("score"))


LETTERS = """
nt AS MATERIALIZED (SELECT qualified_name AS doc_id, concat_ws(' ', name, CASE WHEN kind <> 'File' THEN lower(kind) END, 'in ' || nullif(parent_name, ''), nullif(params, ''), 'returns ' || nullif(return_type, ''), nullif(language, '')) AS text FROM nodes),
vec AS MATERIALIZED (SELECT doc_id, text, list_transform(range(97, 123), lambda c: (length(text) - length(replace(lower(text), chr(c::INTEGER), '')))::DOUBLE) AS v FROM nt)
"""


@register("node_text", over(GRAPH, LETTERS, sql="SELECT doc_id, text FROM nt"))
def node_text(w: Workspace) -> DataFrame:
    return SE.node_text(w.graph)


@register("node_vector_search", over(GRAPH, LETTERS, sql="""
WITH q AS (SELECT v FROM vec ORDER BY doc_id LIMIT 1), s AS (SELECT doc_id, list_cosine_similarity(vec.v, q.v) AS score FROM vec, q)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""))
def node_vector_search(w: Workspace) -> DataFrame:
    vectors = SE.embed(SE.node_text(w.graph))
    query = vectors.orderBy("doc_id").first()["vector"]
    ranked = SE.cosine_top(vectors.select("doc_id", "vector"), query, None).withColumn("score", F.round("score", 9))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@register("embedding_refresh", over(GRAPH, LETTERS, sql="SELECT doc_id, sha256(text) AS text_hash, 'letters' AS provider FROM nt"))
def embedding_refresh(w: Workspace) -> DataFrame:
    texts = SE.node_text(w.graph)
    stale = SE.embed(texts.withColumn("text", F.regexp_replace("text", "ring", "wheel")))
    return SE.refresh_embeddings(stale, texts).select("doc_id", "text_hash", "provider")


@register("hybrid_search", over(GRAPH, r"""
nd AS (SELECT qualified_name AS doc_id, kind, file_path, concat_ws(' ', name, qualified_name, file_path,
  CASE WHEN kind IN ('Function', 'Test') THEN 'def ' || name || '(' || coalesce(params, '') || ')' || CASE WHEN coalesce(return_type, '') <> '' THEN ' -> ' || return_type ELSE '' END WHEN kind = 'Class' THEN 'class ' || name ELSE name END) AS text FROM nodes),
tok AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM nd),
st AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS al FROM tok),
flat AS MATERIALIZED (SELECT doc_id, len(words) AS doc_len, unnest(words) AS term, unnest(range(len(words))) AS pos FROM tok)
""", BM25.format("old", "bolt"), sql="""
WITH f AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS score FROM (SELECT * FROM scored ORDER BY score DESC, doc_id LIMIT 60)),
b AS (SELECT f.doc_id, n.kind, n.file_path, f.score * CASE WHEN n.kind = 'Function' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS s FROM f JOIN nodes n ON n.qualified_name = f.doc_id)
SELECT doc_id AS qualified_name, kind, file_path, round(s + 1e-9::DOUBLE, 6) AS score FROM b WHERE kind = 'Function' ORDER BY s DESC, doc_id LIMIT 20"""))
def hybrid_search(w: Workspace) -> DataFrame:
    return SE.hybrid_search(w.graph, "old_bolt", kind="Function", index=w.node_index)


@register("run_table", over(FINDINGS, HISTORY, RUNS, sql="""
WITH s AS (SELECT l.run_day, count(*) AS findings, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
 count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM links l JOIN hist USING (fingerprint) GROUP BY 1),
c AS (SELECT run_day, count(*) FILTER (change = 'new') AS "new", count(*) FILTER (change = 'recurring') AS recurring, count(*) FILTER (change = 'fixed') AS fixed FROM cmp GROUP BY 1)
SELECT * FROM s JOIN c USING (run_day)"""))
def run_table(w: Workspace) -> DataFrame:
    return FD.run_table(FD.run_links(w.normalised, "run_day"), w.history, "run_day")


@register("stemmed_phrase_search")
def stemmed_phrase_search(w: Workspace) -> DataFrame:
    """The phrase search of an index of stems (no SQL form)."""
    return w.stemmed_index.phrase_search("in the", None, across=True).select("doc_id", "tf", "doc_len", "score")


# A tenth of the documents is written anew with other words, another tenth is emptied; all others keep their postings.
REFRESHED = r"""
docs2 AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'fresh words in the fresh text ' || doc_id WHEN doc_id % 10 = 4 THEN '' ELSE text END AS text FROM documents),
tok AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM docs2),
st AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS al FROM tok),
flat AS MATERIALIZED (SELECT doc_id, len(words) AS doc_len, unnest(words) AS term, unnest(range(len(words))) AS pos FROM tok)
"""


@register("index_refresh", over(REFRESHED, BM25.format("in", "the"), sql="SELECT doc_id, tf, doc_len, round(score, 6) AS score FROM scored"))
def index_refresh(w: Workspace) -> DataFrame:
    """Documents replaced in a stored index, then searched."""
    index = w._index(w.document_texts)
    tenth = F.col("doc_id") % 10
    changed = w.document_texts.where(tenth.isin(3, 4)).withColumn(
        "text", F.when(tenth == 3, F.concat(F.lit("fresh words in the fresh text "), F.col("doc_id").cast("string"))).otherwise(""))
    index = index.refresh(changed.select("file_path"), changed)
    return index.phrase_search("in the", None, across=True).select("doc_id", "tf", "doc_len", F.round("score", 6).alias("score"))


@register("cross_repo_search", over(GRAPH, r"""
nd AS (SELECT qualified_name AS doc_id, kind, split_part(file_path, '/', 2) AS repo, concat_ws(' ', name, qualified_name, file_path,
  CASE WHEN kind IN ('Function', 'Test') THEN 'def ' || name || '(' || coalesce(params, '') || ')' || CASE WHEN coalesce(return_type, '') <> '' THEN ' -> ' || return_type ELSE '' END WHEN kind = 'Class' THEN 'class ' || name ELSE name END) AS text FROM nodes),
tok AS MATERIALIZED (SELECT doc_id, repo, kind, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM nd),
st AS (SELECT repo, count(*)::DOUBLE AS n, avg(len(words)) AS al FROM tok GROUP BY repo),
flat AS MATERIALIZED (SELECT doc_id, repo, kind, len(words) AS doc_len, unnest(words) AS term, unnest(range(len(words))) AS pos FROM tok),
hits AS MATERIALIZED (SELECT a.doc_id, a.repo, a.kind, a.doc_len, count(*) AS tf FROM flat a JOIN flat b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'red' AND b.term = 'ring' GROUP BY 1, 2, 3, 4),
hn AS (SELECT repo, count(*) AS c FROM hits GROUP BY repo),
scored AS (SELECT h.*, ln(1.0::DOUBLE + (n - c + 0.5::DOUBLE) / (c + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / al))) AS score FROM hits h JOIN st USING (repo) JOIN hn USING (repo)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, doc_id) AS rn FROM scored)
""", sql="""
WITH b AS (SELECT repo, doc_id, round(1.0::DOUBLE / (60 + rn) * CASE WHEN kind = 'Function' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END + 1e-9::DOUBLE, 6) AS score,
  1.0::DOUBLE / (60 + rn) * CASE WHEN kind = 'Function' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS s FROM ranked WHERE rn <= 60),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY repo ORDER BY s DESC, doc_id) <= 20)
SELECT repo, doc_id AS qualified_name, score FROM t ORDER BY score DESC, repo, doc_id LIMIT 20"""))
def cross_repo_search(w: Workspace) -> DataFrame:
    """One repository per top folder of the commerce graph."""
    return SE.cross_repo_search(w.node_index, w.repo_nodes, "red_ring").select("repo", "qualified_name", "score")
