"""Findings: parsing, deduplication, history, run diff and verdict cache.

Raw findings: rule_id, file_path, line_start, line_end, cwe, severity, seq
(``seq`` is the arrival order and breaks every tie).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions import findings as X
from codelattice.functions.text import contains_text
from codelattice.operators.lookup import _cut


def normalise(raw: DataFrame) -> DataFrame:
    """Scanner rows to findings: title, severity word, fingerprint."""
    return raw.withColumn("title", X.rule_title(F.col("rule_id"))).withColumn(
        "raw_severity", F.col("severity")
    ).withColumn("severity", X.normalise_severity(F.col("severity"))).withColumn(
        "fingerprint", X.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_start"))
    )


def deduplicate(raw: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Merge overlapping or adjacent findings of one file and CWE, keeping the best.

    Rows that start on the same line always share a cluster, so they are first
    reduced to one row per start line (best finding, greatest end). The sweep
    then sees at most one row per line of a file. Findings without a CWE stay.
    """
    keys = [*scope, "file_path", "cwe_key"]
    rows = raw.withColumn("cwe_key", X.normalise_cwe(F.col("cwe"))).withColumn(
        "line_end", F.coalesce("line_end", "line_start")
    )
    known = rows.where(F.col("cwe_key") != "")
    payload = F.struct(*raw.columns)
    rank = F.struct(
        X.dedup_rank(F.col("severity")).alias("r"), F.length("rule_id").alias("l"),
        (-F.col("line_start")).alias("s"), (-F.col("seq")).alias("q"),
    )
    per_line = known.groupBy(*keys, "line_start").agg(
        F.max("line_end").alias("far"), F.max(rank).alias("rank"), F.max_by(payload, rank).alias("best"),
        F.count("*").alias("merged"),
    )
    order = Window.partitionBy(*keys).orderBy("line_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swept = per_line.withColumn("reach", F.max("far").over(before)).withColumn(
        "fresh",
        F.when(F.col("reach").isNull() | (F.col("line_start") > F.col("reach") + 1), 1).otherwise(0),
    ).withColumn("cluster", F.sum("fresh").over(order))
    kept = swept.groupBy(*keys, "cluster").agg(
        F.max_by("best", F.col("rank")).alias("best"), F.sum("merged").alias("merged")
    )
    return kept.select("best.*", "merged").unionByName(
        rows.where(F.col("cwe_key") == "").select(
            *[F.col(c) for c in raw.columns], F.lit(1).cast("bigint").alias("merged")
        )
    )


def fold_history(found: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """The stored finding table after all runs, by aggregates on the fingerprint.

    Title, severity and location keep their first values; snippet and last run
    come from the latest sighting.
    """
    when = F.struct(F.col(run), F.col(order))
    first = lambda c: F.min_by(c, when).alias(c)
    return found.groupBy("fingerprint").agg(
        first("rule_id"), first("title"), first("severity"), first("file_path"),
        first("line_start"), first("line_end"), first("cwe"),
        F.max_by("snippet", when).alias("snippet"),
        F.min(run).alias("first_run"), F.max(run).alias("last_run"),
        F.countDistinct(run).alias("runs"), F.lit("open").alias("status"),
    )


VERDICT_COLUMNS = (
    "verdict", "verdict_severity", "reasoning", "description", "poc", "cvss_score", "cvss_vector",
)


def upsert(stored: DataFrame, incoming: DataFrame, run_id) -> DataFrame:
    """One run's findings merged into the store, with ``is_new``.

    A known fingerprint refreshes only last run and snippet, plus the verdict
    columns and file hash when the incoming row carries a verdict. So of several
    sightings in one run the first is stored, with the last snippet and verdict.
    """
    rest = [c for c in incoming.columns if c != "fingerprint"]
    judged_at = F.when(F.col("verdict").isNotNull(), F.col("seq")) if "verdict" in rest else F.col("seq")

    def kept(c: str) -> Column:
        if c in VERDICT_COLUMNS or c == "file_hash":
            return F.max_by(c, judged_at)
        return F.max_by(c, "seq") if c == "snippet" else F.min_by(c, "seq")

    new = incoming.groupBy("fingerprint").agg(*[kept(c).alias(f"n_{c}") for c in rest])
    joined = stored.join(new, "fingerprint", "full")
    is_new = F.col("first_run").isNull()
    seen = F.col("n_seq").isNotNull()
    out: list[Column] = [F.col("fingerprint")]
    for c in stored.columns:
        if c in ("fingerprint", "first_run", "last_run", "status", "snippet", "file_hash") or c in VERDICT_COLUMNS:
            continue
        out.append(F.when(is_new, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c))
    out.append(F.when(seen, F.col("n_snippet")).otherwise(F.col("snippet")).alias("snippet"))
    judged = F.col("n_verdict").isNotNull() if "verdict" in rest else F.lit(False)
    for c in VERDICT_COLUMNS:
        if c in stored.columns:
            out.append((F.when(judged, F.col(f"n_{c}")).otherwise(F.col(c)) if c in rest else F.col(c)).alias(c))
    if "file_hash" in stored.columns:
        hashed = F.when(judged & ~is_new, F.col("n_file_hash")).otherwise(F.col("file_hash")) if "file_hash" in rest else F.col("file_hash")
        out.append(hashed.alias("file_hash"))
    out += [
        F.coalesce("first_run", F.lit(run_id)).alias("first_run"),
        F.when(seen, F.lit(run_id)).otherwise(F.col("last_run")).alias("last_run"),
        F.coalesce("status", F.lit("open")).alias("status"),
        (is_new & seen).alias("is_new"), seen.alias("in_run"),
    ]
    return joined.select(*out)


def run_links(found: DataFrame, run: str = "run_id") -> DataFrame:
    return found.select(run, "fingerprint").distinct()


def run_order(links: DataFrame, run: str = "run_id") -> DataFrame:
    """Each run with the run before and after it (one row per run)."""
    runs = links.select(run).distinct()
    w = Window.orderBy(run)
    return runs.select(run, F.lag(run).over(w).alias("prev_run"), F.lead(run).over(w).alias("next_run"))


def compare_runs(links: DataFrame, run: str = "run_id") -> DataFrame:
    """Status of every fingerprint per run against the preceding run.

    The first run has only new findings; a finding of the last run has no
    later run to be fixed in.
    """
    order = run_order(links, run)
    now = links.withColumn("now", F.lit(True))
    moved = (
        links.join(order.select(run, "next_run"), run).where(F.col("next_run").isNotNull())
        .select(F.col("next_run").alias(run), "fingerprint", F.lit(True).alias("before"))
    )
    return now.join(moved, [run, "fingerprint"], "full").select(
        run, "fingerprint",
        F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "fixed")
        .otherwise("recurring").alias("change"),
    )


def compare_with_previous(links: DataFrame, run_id, run: str = "run_id") -> DataFrame:
    """The same for a single run."""
    earlier = links.where(F.col(run) < F.lit(run_id))
    prev = earlier.agg(F.max(run)).scalar()
    now = links.where(F.col(run) == F.lit(run_id)).select("fingerprint", F.lit(True).alias("now"))
    old = earlier.where(F.col(run) == prev).select("fingerprint", F.lit(True).alias("before"))
    return now.join(old, "fingerprint", "full").select(
        "fingerprint",
        F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "fixed")
        .otherwise("recurring").alias("change"),
    )


def run_counters(compared: DataFrame, run: str = "run_id") -> DataFrame:
    one = lambda word: F.count_if(F.col("change") == word).alias(word)
    return compared.groupBy(run).agg(one("new"), one("recurring"), one("fixed"))


def verdict_cache(findings: DataFrame, stored: DataFrame, hashes: DataFrame, enriched: bool = True) -> DataFrame:
    """Cache state per finding: a hit needs a verdict, a fresh file and, if asked, detail.

    ``stored``: fingerprint, verdict, cvss_score, description, file_hash.
    ``hashes``: file_path, current_hash (absent files count as ``missing``).
    """
    known = stored.where(F.col("verdict").isNotNull())
    fresh = (
        F.col("file_hash").isNull() | (F.col("file_hash") == "")
        | (F.col("file_hash") == F.coalesce("current_hash", F.lit("missing")))
    )
    hit = F.col("verdict").isNotNull() & fresh
    if enriched:
        hit = hit & (F.col("cvss_score").isNotNull() | F.coalesce(F.col("description") != "", F.lit(False)))
    return findings.select("fingerprint", "file_path").distinct().join(known, "fingerprint", "left").join(
        hashes, "file_path", "left"
    ).select(
        "fingerprint", "file_path", "verdict", F.coalesce(hit, F.lit(False)).alias("hit"),
        F.coalesce(F.col("verdict").isNotNull() & ~fresh, F.lit(False)).alias("stale"),
    )


def set_verdicts(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Write verdict columns by fingerprint; other rows stay as they are."""
    fresh = [c for c in verdicts.columns if c != "fingerprint"]
    renamed = verdicts.select("fingerprint", *[F.col(c).alias(f"n_{c}") for c in fresh]).withColumn("_hit", F.lit(True))
    joined = stored.join(renamed, "fingerprint", "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)
        for c in stored.columns
    ])


def list_findings(
    findings: DataFrame, severity: str | None = None, verdict: str | None = None, source: str | None = None,
    status: str | None = None, file_path: str | None = None, in_run: DataFrame | None = None,
    limit: int | None = 100, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Filtered page in report order, and the total over the same predicate."""
    found = findings
    for column, value in (("severity", severity and severity.upper()), ("verdict", verdict and verdict.upper()),
                          ("source", source), ("status", status)):
        if value:
            found = found.where(F.col(column) == value)
    if file_path:
        found = found.where(contains_text(F.col("file_path"), file_path, wildcards=True))
    if in_run is not None:
        found = found.join(in_run.select("fingerprint").distinct(), "fingerprint", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(X.severity_order(F.col("severity")), "file_path", "line_start", "fingerprint").offset(offset)
    return (page if limit is None else page.limit(limit)), total


def text_filter(findings: DataFrame, text: str = "", verdict: str | None = None) -> DataFrame:
    """Free text over file, rule and title; ``UNANALYSED`` selects rows without a verdict."""
    found = findings
    if verdict == "UNANALYSED":
        found = found.where(F.col("verdict").isNull())
    elif verdict:
        found = found.where(F.col("verdict") == verdict)
    if text:
        low = text.lower()
        hit = F.lit(False)
        for c in ("file_path", "rule_id", "title"):
            hit = hit | F.coalesce(F.lower(c).contains(low), F.lit(False))
        found = found.where(hit)
    return found


def severity_matrix(findings: DataFrame) -> DataFrame:
    """Counts by severity, by verdict and in all, with one grouping-sets pass."""
    sev = F.coalesce("severity", F.lit("UNKNOWN"))
    ver = F.coalesce("verdict", F.lit("UNANALYSED"))
    shaped = findings.select(sev.alias("severity"), ver.alias("verdict"))
    return shaped.groupingSets(
        [["severity"], ["verdict"], []], "severity", "verdict"
    ).agg(F.count("*").alias("findings")).select(
        F.coalesce("severity", F.lit("*")).alias("severity"),
        F.coalesce("verdict", F.lit("*")).alias("verdict"), "findings",
    )


def latest_runs(runs: DataFrame, limit: int | None = 20) -> DataFrame:
    return _cut(runs, [F.desc("run_id")], limit)


def run_findings(history: DataFrame, links: DataFrame, run: str = "run_id") -> DataFrame:
    """Findings of each run with their report position keys."""
    return links.join(history, "fingerprint").withColumn("severity_order", X.severity_order(F.col("severity")))


def parse_hunt_answers(answers: DataFrame, text: str = "answer", entry: str = "entry") -> DataFrame:
    """Answer texts to finding rows (zero or more per answer)."""
    blocks = answers.select(F.col(entry).alias("entry"), F.posexplode(X.finding_blocks(F.col(text))).alias("pos", "body"))
    f = lambda key: X.block_field(F.col("body"), key)
    clean = lambda c: F.when(F.upper(c).isin("N/A", "NA", "NONE", "-"), "").otherwise(F.coalesce(c, F.lit("")))
    title = F.coalesce(f("vuln_type"), F.lit("Unknown"))
    location = F.coalesce(f("location"), F.lit(""))
    path = F.regexp_replace(location, ":[^:]*$", "")
    line = F.regexp_extract(location, r":\s*([+-]?\d+)\s*$", 1)
    description = F.coalesce(f("description"), F.lit(""))
    reasoning = F.coalesce(f("reasoning"), F.lit(""))
    return blocks.select(
        "entry", "pos",
        F.concat(F.lit("hunter."), F.regexp_replace(F.lower(title), " ", "-")).alias("rule_id"),
        title.alias("title"), F.upper(F.coalesce(f("severity"), F.lit("MEDIUM"))).alias("severity"),
        path.alias("file_path"),
        F.when(line == "", 0).otherwise(line.try_cast("int")).alias("line_start"),
        F.trim(F.when(description != "", description).otherwise(reasoning)).alias("message"),
        reasoning.alias("reasoning"), description.alias("description"), clean(f("poc")).alias("poc"),
        f("cvss").try_cast("double").alias("cvss_score"), clean(f("cvss_vector")).alias("cvss_vector"),
        F.coalesce(f("function"), F.col("entry")).alias("function"),
    )


def run_table(links: DataFrame, history: DataFrame, run: str = "run_id") -> DataFrame:
    """One record per run: findings by severity and the change counters."""
    found = links.join(history.select("fingerprint", "severity"), "fingerprint").groupBy(run).agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
    return found.join(run_counters(compare_runs(links, run), run), run)
