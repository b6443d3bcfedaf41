"""String expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_name(col: Column, max_len: int | None = None) -> Column:
    """Drop control characters other than tab and newline; cut only for a display that asks for it."""
    whole = F.regexp_replace(col, r"[\x00-\x08\x0B-\x1F]", "")
    return whole if max_len is None else F.substring(whole, 1, max_len)


def slug(col: Column, max_len: int = 30, default: str = "") -> Column:
    dashed = F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, max_len)
    return F.when(cut == "", F.lit(default)).otherwise(cut)


def split_identifier(col: Column) -> Column:
    """camelCase / snake_case / dotted name to its words."""
    broken = F.regexp_replace(col, "([a-z])([A-Z])", "$1_$2")
    return F.filter(F.split(broken, r"[_\-.\s]+"), lambda w: w != "")


def token_estimate(col: Column) -> Column:
    return F.floor(F.length(col) / 4).cast("bigint")


def contains_any(words: Iterable[str], *cols: Column) -> Column:
    """True when any word is a substring of any lower-cased column."""
    pattern = "|".join(words)
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(F.lower(col).rlike(pattern), F.lit(False))
    return hit


def matches_any(patterns: Iterable[str], col: Column) -> Column:
    return F.coalesce(col.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def like_escape(text: str) -> str:
    """User text as a literal inside a Spark LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(col: Column, text: str, wildcards: bool = False) -> Column:
    """Case-insensitive ``%text%``; ``wildcards`` keeps ``_`` and ``%`` live."""
    inner = text.replace("\\", "\\\\") if wildcards else like_escape(text)
    return col.ilike(f"%{inner}%")


def words_of(col: Column) -> Column:
    """Lower-cased runs of letters and digits in order (whole text)."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """1-based inclusive range of lines, clamped to the text."""
    lines = F.split(text, "\r\n|\r|\n")
    first = F.greatest(F.coalesce(start, F.lit(1)), F.lit(1))
    last = F.least(F.coalesce(end, F.size(lines)), F.size(lines))
    return F.when(last < first, F.lit("")).otherwise(
        F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    )


def doc_section(text: Column, name: str) -> Column:
    """Body of ``<section name="...">``; empty when absent."""
    quoted = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in name)
    return F.trim(F.regexp_extract(text, rf'(?is)<section name="{quoted}">(.*?)</section>', 1))


def source_window(text: Column, start: int, end: int, context: int = 5) -> Column:
    """Array of (line, code, highlight) around a line range, clamped to the text."""
    lines = F.split(text, "\r\n|\r|\n")
    first = max(start - context, 1)
    shown = F.slice(lines, F.lit(first), F.lit(end + context - first + 1))
    return F.transform(
        shown,
        lambda code, i: F.struct(
            (i + first).alias("line"), code.alias("code"), (i + first).between(start, end).alias("highlight")
        ),
    )
