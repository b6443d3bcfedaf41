"""Scalar expressions on findings: severity, CWE, hashes, verdict text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelattice import schema as S

_BLANKS = ("N/A", "NA", "NONE", "-")


def _lookup(pairs: dict, key: Column, default) -> Column:
    flat: list[Column] = []
    for k, v in pairs.items():
        flat += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*flat), key), F.lit(default))


def normalise_severity(raw: Column) -> Column:
    return _lookup(S.SEVERITY_ALIASES, F.upper(F.coalesce(raw, F.lit("MEDIUM"))), "MEDIUM")


def dedup_rank(raw: Column) -> Column:
    """Rank on raw severities; scanner words outside the four count as MEDIUM."""
    word = F.upper(F.when(raw.isNull() | (raw == ""), F.lit("MEDIUM")).otherwise(raw))
    return _lookup(S.DEDUP_SEVERITY_RANK, word, S.DEDUP_SEVERITY_RANK["MEDIUM"])


def severity_order(severity: Column) -> Column:
    order = F.lit(len(S.REPORT_SEVERITY_ORDER) + 1)
    for position, word in reversed(list(enumerate(S.REPORT_SEVERITY_ORDER, start=1))):
        order = F.when(severity == word, F.lit(position)).otherwise(order)
    return order


def effective_severity(verdict_severity: Column, severity: Column) -> Column:
    return F.when(
        verdict_severity.isNotNull() & (verdict_severity != ""), verdict_severity
    ).otherwise(severity)


def cvss_rating(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= 9.0, "Critical")
        .when(score >= 7.0, "High")
        .when(score >= 4.0, "Medium")
        .otherwise("Low")
    )


def normalise_cwe(raw: Column) -> Column:
    """``cwe-089`` to ``CWE-89``; a non-numeric tail keeps its upper-cased text."""
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    number = F.regexp_replace(F.regexp_extract(text, r"^CWE-\s*\+?(\d+)\s*$", 1), "^0+(?=\\d)", "")
    return F.when(number != "", F.concat(F.lit("CWE-"), number)).otherwise(text)


def fingerprint(rule: Column, path: Column, line: Column) -> Column:
    return F.sha2(F.concat_ws(":", rule, path, line.cast("string")), 256)


def content_hash(content: Column) -> Column:
    """First 16 hex digits of the content's SHA-256; ``missing`` when unreadable."""
    return F.coalesce(F.substring(F.sha2(content, 256), 1, 16), F.lit("missing"))


def rule_title(rule: Column) -> Column:
    last = F.element_at(F.split(rule, r"\."), -1)
    return F.initcap(F.regexp_replace(last, "[-_]", " "))


def _field(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, rf"(?is){name}\s*:\s*(.+?)(?:\n[A-Z_]+\s*:|$)", 1)
    return F.when(found == "", F.lit(None)).otherwise(F.trim(found))


def _unless_blank(col: Column) -> Column:
    return F.when(F.upper(col).isin(*_BLANKS), F.lit(None)).otherwise(col)


def parse_verdict(text: Column) -> Column:
    """Free verdict text to a struct; no VERDICT line gives the default row."""
    verdict = F.upper(
        F.regexp_extract(text, r"(?i)VERDICT\s*:\s*(CONFIRMED|FALSE_POSITIVE|NEEDS_REVIEW)", 1)
    )
    severity = F.upper(F.regexp_extract(text, r"(?i)SEVERITY\s*:\s*(CRITICAL|HIGH|MEDIUM|LOW)", 1))
    score = F.regexp_extract(text, r"(?i)CVSS\s*:\s*([\d.]+)", 1).try_cast("double")
    known = verdict != ""
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.when(known, verdict).otherwise("NEEDS_REVIEW").alias("verdict"),
        F.when(known & (severity != ""), severity).otherwise("MEDIUM").alias("severity"),
        F.when(known, F.coalesce(_field(text, "REASONING"), F.trim(text)))
        .otherwise("LLM analysis could not produce a verdict.")
        .alias("reasoning"),
        F.when(known, _field(text, "DESCRIPTION")).otherwise(nothing).alias("description"),
        F.when(known, _unless_blank(_field(text, "POC"))).otherwise(nothing).alias("poc"),
        F.when(known, score).alias("cvss_score"),
        F.when(known, _unless_blank(_field(text, "CVSS_VECTOR"))).otherwise(nothing).alias("cvss_vector"),
    )


def finding_blocks(text: Column) -> Column:
    """All ``FINDING_START … FINDING_END`` bodies of one answer."""
    return F.regexp_extract_all(text, F.lit(r"(?s)FINDING_START\s*\n(.*?)FINDING_END"), 1)


def block_field(block: Column, key: str) -> Column:
    found = F.trim(F.regexp_extract(block, rf"(?im)^\s*{key}\s*:\s*(.+)$", 1))
    return F.when(found == "", F.lit(None)).otherwise(found)
