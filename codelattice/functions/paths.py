"""Path, language and qualified-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.text import matches_any


def _map(pairs: dict[str, str]) -> Column:
    flat: list[Column] = []
    for key, value in pairs.items():
        flat += [F.lit(key), F.lit(value)]
    return F.create_map(*flat)


def extension_of(path: Column) -> Column:
    """Lower-cased suffix of the last path part, with its dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension; NULL for an unknown one."""
    return F.try_element_at(_map(S.EXTENSION_LANGUAGE), extension_of(path))


def rule_language_of(path: Column) -> Column:
    return F.try_element_at(_map(S.RULE_LANGUAGE), extension_of(path))


def is_test_file(path: Column) -> Column:
    return matches_any(S.TEST_FILE_PATTERNS, path)


def is_test_function(name: Column, path: Column, decorators: Column | None = None) -> Column:
    hit = matches_any(S.TEST_NAME_PATTERNS, name) | (
        is_test_file(path) & name.isin(*S.TEST_RUNNER_NAMES)
    )
    if decorators is not None:
        marked = F.exists(decorators, lambda d: d.isin(*S.TEST_ANNOTATIONS))
        hit = hit | F.coalesce(marked, F.lit(False))
    return hit


def qualified_name(kind: Column, path: Column, parent: Column, name: Column) -> Column:
    return (
        F.when(kind == "File", path)
        .when(parent.isNotNull() & (parent != ""), F.concat(path, F.lit("::"), parent, F.lit("."), name))
        .otherwise(F.concat(path, F.lit("::"), name))
    )


def file_of(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, "::"), 1)


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(
        path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1 - len(prefix))
    ).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_label(path: Column) -> Column:
    """Parent directory, or the file stem when there is none."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(stem)


def signature(kind: Column, name: Column, params: Column, return_type: Column) -> Column:
    """Display signature, cut at 512 characters."""
    call = F.concat(
        F.lit("def "), name, F.lit("("), F.coalesce(params, F.lit("")), F.lit(")"),
        F.when(
            return_type.isNotNull() & (return_type != ""),
            F.concat(F.lit(" -> "), return_type),
        ).otherwise(F.lit("")),
    )
    text = (
        F.when(kind.isin("Function", "Test"), call)
        .when(kind == "Class", F.concat(F.lit("class "), name))
        .otherwise(name)
    )
    return text


def glob_to_regex(pattern: str) -> str:
    """A shell glob as an anchored regular expression (for ignore lists)."""
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch.isalnum() or ch in "/_- ":
            out.append(ch)
        else:
            out.append("\\" + ch)
    return "^(?:" + "".join(out) + ")$"
