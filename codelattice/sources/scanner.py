"""Scanner output and rule documents (JSON texts) as finding and rule rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.findings import normalise_severity

_RESULTS = (
    "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,"
    "extra:struct<severity:string,message:string,lines:string,metadata:struct<cwe:string>>>>"
)

# Weaknesses rated CRITICAL whatever the rule says.
CRITICAL_CWES = ("CWE-89", "CWE-78", "CWE-94", "CWE-502", "CWE-918", "CWE-611", "CWE-434")
NAME_NOISE = ("python", "java", "javascript", "go", "ruby", "php", "security", "vuln", "detect", "semgrep")


def _first_of(text: Column) -> Column:
    """A field that is one string or a list: its first string."""
    return F.when(
        F.ltrim(text).startswith("["), F.coalesce(F.get(F.from_json(text, "array<string>"), F.lit(0)), F.lit(""))
    ).otherwise(F.coalesce(text, F.lit("")))


def scanner_findings(reports: DataFrame) -> DataFrame:
    """(report_id, text) to raw finding rows; a broken report gives none."""
    rows = reports.select("report_id", F.posexplode(F.from_json("text", _RESULTS)["results"]).alias("pos", "r"))
    start = F.coalesce("r.start.line", F.lit(0))
    return rows.select(
        "report_id", "pos", F.coalesce("r.check_id", F.lit("unknown")).alias("rule_id"),
        F.coalesce("r.path", F.lit("")).alias("file_path"), start.alias("line_start"),
        F.coalesce("r.end.line", start).alias("line_end"), _first_of(F.col("r.extra.metadata.cwe")).alias("cwe"),
        F.col("r.extra.severity").alias("severity"),
        F.coalesce("r.extra.message", F.lit("")).alias("message"),
        F.trim(F.coalesce("r.extra.lines", F.lit(""))).alias("snippet"),
    )


_SIG = "array<struct<id:string,name:string,qualified_pattern:string,language:string,sig_type:string,vuln_class_id:string,description:string>>"
_CUSTOM = (
    "id string, cwe_id string, owasp_cat string, name string, language string, severity string, description string, "
    f"taint_signatures {_SIG}, sinks {_SIG}, sources {_SIG}, sanitizers {_SIG}, "
    "detectors array<struct<id:string,detector_type:string,language:string,confidence:string,content:string>>"
)


def custom_rules(documents: DataFrame) -> dict[str, DataFrame]:
    """Rule documents (seq, text: one object or a list) as class, signature and detector rows."""
    listed = F.from_json("text", f"array<struct<{_as_fields(_CUSTOM)}>>")
    single = F.array(F.from_json("text", _CUSTOM))
    rules = documents.select("seq", F.explode(F.when(F.ltrim("text").startswith("["), listed).otherwise(single)).alias("r"))
    rules = rules.select("seq", "r.*").where(F.coalesce("id", F.lit("")) != "")
    blank = lambda c: F.coalesce(c, F.lit(""))
    classes = rules.where(blank("name") != "").select(
        "id", blank("cwe_id").alias("cwe_id"), blank("owasp_cat").alias("owasp_cat"), "name",
        blank("description").alias("description"), F.coalesce("severity", F.lit("MEDIUM")).alias("severity"),
        F.coalesce("language", F.lit("any")).alias("language"), F.lit("custom").alias("source"), "seq",
    )
    parts = None
    for field, forced in (("taint_signatures", None), ("sinks", "SINK"), ("sources", "SOURCE"), ("sanitizers", "SANITIZER")):
        part = rules.select("seq", F.col("id").alias("rule"), F.explode(field).alias("s"))
        made = F.concat("rule", F.lit(f"-{(forced or 'sig').lower()}-"), F.coalesce("s.name", F.lit("unknown")))
        rows = part.select(
            F.coalesce("s.id", made).alias("id"), F.col("s.name").alias("name"), "s.qualified_pattern",
            F.coalesce("s.language", F.lit("any")).alias("language"),
            (F.lit(forced) if forced else F.upper("s.sig_type")).alias("sig_type"),
            (F.col("rule") if forced else F.coalesce("s.vuln_class_id", "rule")).alias("vuln_class_id"),
            F.lit("custom").alias("source"), "seq",
        )
        parts = rows if parts is None else parts.unionByName(rows)
    detectors = rules.select("seq", F.col("id").alias("vuln_class_id"), F.explode("detectors").alias("d")).select(
        "d.*", "vuln_class_id", "seq"
    )
    return {"classes": classes, "signatures": parts, "detectors": detectors}


def _as_fields(ddl: str) -> str:
    """``name type`` columns as ``name:type`` struct fields."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)


_REGISTRY = (
    "rules array<struct<id:string,message:string,severity:string,languages:array<string>,"
    "metadata:struct<cwe:string,owasp:string,category:string,confidence:string>>>"
)


def registry_rules(documents: DataFrame) -> dict[str, DataFrame]:
    """Pattern-registry documents (seq, text) to classes and detectors.

    Kept are rules with a CWE or the security category; the first CWE and the
    first language represent the rule.
    """
    rules = documents.select("seq", F.explode(F.from_json("text", _REGISTRY)["rules"]).alias("r")).select("seq", "r.*")
    cwe_text = F.coalesce("metadata.cwe", F.lit(""))
    number = F.regexp_extract(cwe_text, r"(?i)CWE-(\d+)", 1)
    cwe = F.when(number != "", F.concat(F.lit("CWE-"), number)).otherwise("")
    kept = rules.where((F.trim(F.coalesce("id", F.lit(""))) != "") & ((cwe_text != "") | F.coalesce(F.col("metadata.category") == "security", F.lit(False))))
    words = F.filter(F.split(F.regexp_replace("id", "[-.]", " "), r"\s+"), lambda x: ~F.lower(x).isin(*NAME_NOISE) & (x != ""))
    title = F.initcap(F.array_join(F.slice(words, 1, 6), " "))
    title = F.when(title == "", F.col("id")).otherwise(title)
    confidence = F.upper(F.coalesce("metadata.confidence", F.lit("MEDIUM")))
    shaped = kept.select(
        "seq", F.concat(F.lit("semgrep-"), F.trim("id")).alias("id"), cwe.alias("cwe_id"),
        F.regexp_extract(F.coalesce("metadata.owasp", F.lit("")), r"(A\d{2})", 1).alias("owasp_cat"),
        F.when(cwe != "", F.concat(title, F.lit(" ("), cwe, F.lit(")"))).otherwise(title).alias("name"),
        F.coalesce("message", F.lit("")).alias("description"),
        F.when(cwe.isin(*CRITICAL_CWES), "CRITICAL").otherwise(
            normalise_severity(F.coalesce("severity", F.lit("WARNING")))).alias("severity"),
        F.coalesce(F.get("languages", F.lit(0)), F.lit("any")).alias("language"),
        F.when(confidence.isin("HIGH", "MEDIUM", "LOW"), confidence).otherwise("MEDIUM").alias("confidence"),
        F.to_json(F.struct("id", "message", "severity", "languages", "metadata")).alias("content"),
    )
    return {
        "classes": shaped.drop("confidence", "content").withColumn("source", F.lit("semgrep")),
        "detectors": shaped.select(
            F.concat(F.lit("semgrep-det-"), F.substring("id", 9, 10000)).alias("id"), F.col("id").alias("vuln_class_id"),
            F.lit("semgrep").alias("detector_type"), "content", "language", "confidence", "seq"),
    }


def catalogue_signatures(entries: DataFrame) -> DataFrame:
    """Catalogue rows (class_id, role, position, pattern) as numbered signatures.

    The catalogue itself is an input table; ids are ``<class>-<role>-NNN``.
    """
    return entries.select(
        F.format_string("%s-%s-%03d", F.col("class_id"), F.lower("role"), F.col("position").cast("int")).alias("id"),
        F.col("pattern").alias("qualified_pattern"), F.upper("role").alias("sig_type"),
        F.col("class_id").alias("vuln_class_id"), F.lit("any").alias("language"), F.col("position").alias("seq"),
    )
