"""Rule tables and their match against the call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions.findings import severity_order
from codelattice.functions.paths import rule_language_of
from codelattice.model import CodeGraph
from codelattice.operators.class_reach import class_reach, hops_left
from codelattice.operators.traversal import paths, trace
from codelattice.session import shuffled, stage

# So many patterns at most are sent to every executor by ``contains_join``.
FEW_PATTERNS = 20_000


def last_wins(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Later rows replace earlier ones with the same id."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, "_r.*")


def combine_sources(sources: list[DataFrame], key: str = "id") -> DataFrame:
    """Ordered rule sources, a later source overriding the same id."""
    tagged = None
    for rank, rows in enumerate(sources):
        part = rows.withColumn("_rank", F.struct(F.lit(rank).alias("r"), F.col("seq")))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    return last_wins(tagged, key, "_rank").drop("_rank")


def signatures_by(signatures: DataFrame, sig_type: str | None = None, class_id: str | None = None,
                  language: str | None = None) -> DataFrame:
    found = signatures
    if sig_type:
        found = found.where(F.upper("sig_type") == sig_type.upper())
    if class_id:
        found = found.where(F.col("vuln_class_id") == class_id)
    if language:
        found = found.where(F.col("language").isin("any", language))
    return found


def rule_counts(classes: DataFrame, signatures: DataFrame, detectors: DataFrame) -> DataFrame:
    """Row counts of the rule tables."""
    tagged = None
    for name, rows in (("vuln_classes", classes), ("taint_signatures", signatures), ("detectors", detectors)):
        part = rows.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def contains_join(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, gram: int = 4) -> DataFrame:
    """Pairs with ``pattern`` a case-insensitive substring of ``text``, as an equi-join.

    A text yields its distinct grams, a pattern its last gram (or itself when
    shorter); a key match is then verified on the whole strings. The patterns
    are measured: few are broadcast, many are shuffled, the grams of the texts
    (many times the texts) are never broadcast.
    """
    low = F.lower(F.col(text))
    p = F.lower(F.col(pattern))
    wanted = patterns.where(F.length(p) > 0)
    lengths = wanted.groupBy(F.least(F.length(p), F.lit(gram)).alias("n")).agg(F.count("*").alias("rows")).collect()
    if not lengths:
        return texts.join(patterns, F.lit(False))
    sizes = F.array(*[F.lit(r["n"]) for r in lengths])  # at most ``gram`` values
    grams = F.array_distinct(F.flatten(F.transform(
        sizes,
        lambda n: F.transform(
            F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - n + 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.substring(low, i, n),
        ),
    )))
    keyed = texts.withColumn("_gram", F.explode(grams))
    wanted = wanted.withColumn(
        "_gram", F.when(F.length(p) > gram, F.substring(p, F.length(p) - gram + 1, F.lit(gram))).otherwise(p)
    )
    few = sum(r["rows"] for r in lengths) <= FEW_PATTERNS
    return keyed.join(F.broadcast(wanted) if few else shuffled(wanted), "_gram").where(F.contains(low, p)).drop("_gram")


def short_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, "::"), -1)


def detect_signals(
    g: CodeGraph, entries: DataFrame, signatures: DataFrame, classes: DataFrame, max_depth: int = 3
) -> DataFrame:
    """Rule classes whose SINK patterns occur in names reachable from each entry.

    One row per (entry, class, matched sink name), with the language the entry
    was matched under. Classes are passed against the calls first; the walk
    starts only at entries that reach one and stays on ways to sinks.
    """
    calls = g.edges_of("CALLS").select("source", "target", "line")
    names = calls.select(F.col("target").alias("node")).distinct()
    sinks = signatures_by(signatures, "SINK").select("qualified_pattern", "language", "vuln_class_id")
    # Substrings of the last parts are substrings of the full name as well.
    matched = stage(contains_join(names, "node", sinks, "qualified_pattern"), "matched_sinks")
    targets = matched.select("node", F.col("vuln_class_id").alias("key"))
    near = class_reach(calls, targets, max_depth=max_depth)
    roots = entries.select(
        F.col("qualified_name").alias("root"), rule_language_of(F.col("file_path")).alias("lang")
    ).join(near.select(F.col("node").alias("root")), "root", "left_semi")
    reached = trace(roots, calls, max_depth, hops_left(near, targets)).where(F.col("depth") > 0).select("root", "node")
    found = (
        reached.join(matched, "node").join(roots, "root")
        .where(F.col("lang").isNull() | (F.col("language") == "any") | (F.col("language") == F.col("lang")))
        .select("root", "lang", "vuln_class_id", short_name(F.col("node")).alias("matched_sink")).distinct()
    )
    return found.join(
        classes.select(F.col("id").alias("vuln_class_id"), "name", "cwe_id", "severity"), "vuln_class_id"
    ).select(
        F.col("root").alias("entry"), "lang", "vuln_class_id", "name", "cwe_id", "severity", "matched_sink",
        severity_order(F.upper("severity")).alias("severity_order"),
    )


def _pattern_lists(signatures: DataFrame) -> DataFrame:
    """Sources and sanitizers per class as arrays of (pattern, language); rules are a curated catalogue."""
    one = F.struct(F.col("qualified_pattern").alias("p"), F.col("language").alias("l"))
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.upper("sig_type") == kind, one)))
    return signatures.groupBy("vuln_class_id").agg(
        pick("SOURCE").alias("sources"), pick("SANITIZER").alias("sanitizers")
    )


def _for_language(column: str) -> Column:
    fits = F.filter(
        F.col(column),
        lambda s: F.col("lang").isNull() | (s["l"] == "any") | (s["l"] == F.col("lang")),
    )
    return F.coalesce(F.transform(fits, lambda s: s["p"]), F.array().cast("array<string>"))


def signal_prompt(signals: DataFrame, signatures: DataFrame, shown_patterns: int | None = None) -> DataFrame:
    """Text per (entry, class) with its sinks, sources and sanitizers, at most ``shown_patterns`` of each if given."""
    keys = ["entry", "lang", "vuln_class_id", "name", "cwe_id", "severity"]
    shown = signals.groupBy(*keys).agg(F.array_sort(F.collect_list("matched_sink")).alias("sinks"))
    known = shown.join(_pattern_lists(signatures), "vuln_class_id", "left").withColumns(
        {"known_sources": _for_language("sources"), "known_sanitizers": _for_language("sanitizers")}
    )
    part = lambda c, none: F.when(
        F.size(c) > 0, F.array_join(F.col(c) if shown_patterns is None else F.slice(F.col(c), 1, shown_patterns), ", ")
    ).otherwise(none)
    cwe = F.when(F.coalesce("cwe_id", F.lit("")) != "", F.concat(F.lit(" ("), F.col("cwe_id"), F.lit(")"))).otherwise("")
    return known.select(
        "entry", "vuln_class_id",
        F.concat(
            F.col("name"), cwe, F.lit(" ["), F.col("severity"), F.lit("] sinks: "),
            part("sinks", "-"), F.lit("; sources: "), part("known_sources", "-"),
            F.lit("; sanitizers: "), part("known_sanitizers", "none known"),
        ).alias("prompt"),
    )


def _matching(g: CodeGraph, patterns: DataFrame, key: str) -> DataFrame:
    """Called names with the keys of the patterns they hold."""
    names = g.edges_of("CALLS").select(F.col("target").alias("node")).distinct()
    return stage(
        contains_join(names, "node", patterns, "pattern").select("node", F.col(key).alias("key")).distinct(), "matching"
    )


def sink_states(g: CodeGraph, entries: DataFrame, signatures: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Per entry and reachable rule class: ``open`` or ``guarded``, and the hops to the nearest sink.

    Guarded means that every way to a sink of the class calls a sanitizer of
    the same class. Patterns are taken whatever their language.
    """
    named = signatures.select("sig_type", F.col("qualified_pattern").alias("pattern"), "vuln_class_id")
    states = class_reach(
        g.edges_of("CALLS"), _matching(g, signatures_by(named, "SINK"), "vuln_class_id"),
        _matching(g, signatures_by(named, "SANITIZER"), "vuln_class_id"), max_depth,
    )
    return entries.select(F.col("qualified_name").alias("node")).distinct().join(states, "node").select(
        F.col("node").alias("entry"), F.col("key").alias("vuln_class_id"), F.col("depth").alias("hops"),
        F.col("open_depth").alias("open_hops"),
        F.when(F.col("open_depth").isNull(), "guarded").otherwise("open").alias("state"),
    )


def taint_paths(g: CodeGraph, entries: DataFrame, sinks: DataFrame, sanitizers: DataFrame,
                max_depth: int = 15) -> DataFrame:
    """Entry → sink chains that call no sanitizer (names given as patterns).

    Sinks are sought against the calls; only entries that reach one are walked,
    only over nodes with a sink in reach, and paths are built for the hits.
    """
    calls = g.edges_of("CALLS").select("source", "target", "line")
    clean = _matching(g, sanitizers, "pattern").select(F.col("node").alias("target")).distinct()
    open_calls = stage(calls.join(clean, "target", "left_anti"), "open_calls")
    hot = _matching(g, sinks.withColumn("kind", F.lit("sink")), "kind")
    near = class_reach(open_calls, hot, max_depth=max_depth)
    roots = entries.select(F.col("qualified_name").alias("root")).join(
        near.select(F.col("node").alias("root")), "root", "left_semi")
    reached = trace(roots, open_calls, max_depth, hops_left(near, hot))
    hits = reached.where(F.col("depth") > 0).join(hot, "node", "left_semi").select("root", "node")
    return paths(reached, hits).select(F.col("root").alias("entry"), F.col("node").alias("sink"), "depth", "path")


def missing_checks(g: CodeGraph, entries: DataFrame, checks: DataFrame, max_depth: int = 15) -> DataFrame:
    """Entries that neither hold nor reach a name with the check's pattern."""
    roots = entries.select(F.col("qualified_name").alias("root")).distinct()
    near = class_reach(g.edges_of("CALLS"), _matching(g, checks, "check_name"), max_depth=max_depth)
    held = contains_join(roots, "root", checks, "pattern").select("root", "check_name")
    hits = near.select(F.col("node").alias("root"), F.col("key").alias("check_name")).unionByName(held).distinct()
    kinds = checks.agg(F.array_sort(F.collect_set("check_name"))).scalar()  # a curated catalogue
    return roots.select("root", F.explode(kinds).alias("check_name")).join(
        hits, ["root", "check_name"], "left_anti"
    ).select(F.col("root").alias("entry"), "check_name")
