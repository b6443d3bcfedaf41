"""Clusters of the graph: grouping, naming, cohesion and coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.functions.numbers import rounded
from codelattice.functions.paths import folder_label
from codelattice.functions.text import slug, split_identifier
from codelattice.model import CodeGraph
from codelattice.operators.lookup import _cut, top_per_key
from codelattice.session import cut, drop_table, shuffled, stage, stage_bucketed


def file_members(g: CodeGraph, min_size: int = 2) -> DataFrame:
    """File grouping: every node of a file with at least ``min_size`` nodes."""
    big = g.nodes.groupBy("file_path").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return g.nodes.join(shuffled(big.select("file_path")), "file_path", "left_semi").select(
        F.col("file_path").alias("community_id"), "qualified_name"
    )


def weighted_pairs(g: CodeGraph) -> DataFrame:
    """Undirected pairs of existing nodes; the first edge of a pair sets its weight."""
    known = g.nodes.select("qualified_name")
    ends = g.edges.join(known.withColumnRenamed("qualified_name", "source"), "source", "left_semi").join(
        known.withColumnRenamed("qualified_name", "target"), "target", "left_semi"
    ).where(F.col("source") != F.col("target"))
    flat: list[Column] = []
    for kind, weight in S.EDGE_WEIGHTS.items():
        flat += [F.lit(kind), F.lit(weight)]
    first = F.min(F.struct("kind", "source", "target", "line"))
    return (
        ends.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        .agg(first.alias("first"))
        .select("a", "b", F.coalesce(F.try_element_at(F.create_map(*flat), F.col("first.kind")), F.lit(0.5)).alias("w"))
    )


def propagate_labels(pairs: DataFrame, rounds: int = 10) -> DataFrame:
    """Weighted label propagation, synchronous and deterministic.

    A node also votes for its own label with its heaviest edge, ties take the
    smallest label; stops when no label moves. Votes are summed before the
    shuffle, so a hub costs one row per (neighbour, label). The rounds work on
    numbers that have the order of the names, a few bytes a row for any name.
    """
    spark = pairs.sparkSession
    ends = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    names = stage(
        ends.repartitionByRange("name").sortWithinPartitions("name").withColumn("id", F.monotonically_increasing_id()),
        "names",
    )
    of = lambda name, number: shuffled(names.select(F.col("name").alias(name), F.col("id").alias(number)))
    weight = F.round(F.col("w") * 10).cast("int").alias("w")
    numbered = stage(pairs.join(of("a", "ia"), "a").join(of("b", "ib"), "b").select("ia", "ib", weight), "numbered")
    links = numbered.select(F.col("ia").alias("node"), F.col("ib").alias("via"), "w").unionByName(
        numbered.select(F.col("ib").alias("node"), F.col("ia").alias("via"), "w")
    )
    own = links.groupBy("node").agg(F.max("w").alias("w")).select("node", F.col("node").alias("via"), "w")
    # The votes are joined once per round, always on the voting neighbour.
    votes_from, table = stage_bucketed(links.unionByName(own), "votes", "via")
    labels = stage(names.select(F.col("id").alias("node"), F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = (
            votes_from.join(labels.select(F.col("node").alias("via"), "label"), "via")
            .groupBy("node", "label").agg(F.sum("w").alias("votes"))
        )
        chosen = votes.groupBy("node").agg(
            F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("label")
        )
        fresh = stage(chosen, "labels")
        moved = fresh.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("old") != F.col("label"))
        stable = moved.isEmpty()
        labels = fresh
        if stable:
            break
    drop_table(spark, table)
    named = names.select(F.col("id").alias("label"), F.col("name").alias("_label"))
    return (
        labels.join(shuffled(names.withColumnRenamed("id", "node")), "node").join(shuffled(named), "label")
        .select(F.col("name").alias("node"), F.col("_label").alias("label"))
    )


def propagated_members(g: CodeGraph, min_size: int = 2, rounds: int = 10, split_above: int | None = 50) -> DataFrame:
    """Communities by label propagation; large ones are re-split once.

    A re-split is kept where it gives at least two parts. Falls back to file
    grouping when no edge joins two nodes.
    """
    pairs = cut(weighted_pairs(g))
    if pairs.isEmpty():
        return file_members(g, min_size)
    labels = propagate_labels(pairs, rounds)
    members = labels.select(F.col("label").alias("community_id"), F.col("node").alias("qualified_name"))
    if split_above is not None:
        size = members.groupBy("community_id").agg(F.count("*").alias("n")).where(F.col("n") > split_above)
        big = cut(members.join(size, "community_id", "left_semi"))
        if not big.isEmpty():
            side = lambda c: big.select(F.col("qualified_name").alias(c), F.col("community_id").alias(f"c{c}"))
            # Inside a large cluster only above-average ties vote again.
            inner = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("ca") == F.col("cb"))
            mean = inner.groupBy("ca").agg(F.avg("w").alias("mean"))
            sub = propagate_labels(
                inner.join(mean, "ca").where(F.col("w") >= F.col("mean")).select("a", "b", "w"), rounds
            )
            parts = big.join(sub.withColumnRenamed("node", "qualified_name"), "qualified_name")
            good = (
                parts.groupBy("community_id", "label").agg(F.count("*").alias("n"))
                .where(F.col("n") >= min_size).groupBy("community_id").agg(F.count("*").alias("parts"))
                .where(F.col("parts") >= 2)
            )
            split = parts.join(good, "community_id", "left_semi").select(
                F.concat("community_id", F.lit("/"), "label").alias("community_id"), "qualified_name"
            )
            members = (
                members.join(good, "community_id", "left_anti").unionByName(split)
            )
    keep = members.groupBy("community_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return members.join(keep, "community_id", "left_semi")


def edge_communities(g: CodeGraph, members: DataFrame) -> DataFrame:
    """Edges with the community of each end (NULL for none)."""
    src = members.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("src_c"))
    dst = members.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("dst_c"))
    return g.edges.join(src, "source", "left").join(dst, "target", "left")


def cohesion(g: CodeGraph, members: DataFrame) -> DataFrame:
    """internal / (internal + external) over all edges touching the members."""
    inside = F.coalesce(F.col("src_c") == F.col("dst_c"), F.lit(False))
    touched = edge_communities(g, members).select(
        inside.cast("bigint").alias("internal"),
        F.explode(F.array_distinct(F.array_compact(F.array("src_c", "dst_c")))).alias("community_id"),
    )
    return touched.groupBy("community_id").agg(
        F.sum("internal").alias("internal_edges"), F.count("*").alias("touching_edges"),
        rounded(F.sum("internal") / F.count("*")).alias("cohesion"),
    )


def most_common(df: DataFrame, keys: list[str], value: str, first_seen: Column) -> DataFrame:
    """Mode per key; ties go to the value seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(first_seen).alias("_first"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col("_first"))).alias(value),
        F.max("_n").alias("_top"),
    )


def community_table(g: CodeGraph, members: DataFrame) -> DataFrame:
    """One row per community: size, cohesion, language, generated name."""
    rows = members.join(
        g.nodes.select("qualified_name", "name", "kind", "file_path", "line_start", "language"), "qualified_name"
    )
    seen = F.struct("file_path", "line_start", "qualified_name")
    key = ["community_id"]
    size = rows.groupBy(*key).agg(F.count("*").alias("size"))
    language = most_common(rows.where(F.col("language") != ""), key, "language", seen).select(
        "community_id", F.col("language").alias("dominant_language")
    )
    folder = most_common(rows.withColumn("folder", folder_label(F.col("file_path"))), key, "folder", seen).select(
        "community_id", slug(F.col("folder")).alias("prefix")
    )
    top_class = most_common(rows.where(F.col("kind") == "Class"), key, "name", seen).select(
        "community_id", F.col("name").alias("top_class"), F.col("_top").alias("class_count")
    )
    words = (
        rows.where(F.col("kind").isin("Function", "Class", "Test", "Type"))
        .select("community_id", "file_path", "line_start", "qualified_name",
                F.posexplode(split_identifier(F.col("name"))).alias("pos", "raw"))
        .withColumn("word", F.lower("raw"))
        .where(~F.col("word").isin(*S.COMMON_NAME_WORDS) & (F.length("word") > 1))
    )
    keyword = most_common(
        words, key, "word", F.struct("file_path", "line_start", "qualified_name", "pos")
    ).select("community_id", F.col("word").alias("keyword"))
    joined = (
        size.join(cohesion(g, members), key, "left").join(language, key, "left").join(folder, key, "left")
        .join(top_class, key, "left").join(keyword, key, "left")
    )
    prefix = F.coalesce("prefix", F.lit(""))
    dominant = F.coalesce(F.col("class_count") > F.col("size") * 0.4, F.lit(False))
    tail = F.when(dominant, slug(F.col("top_class"))).otherwise(F.coalesce("keyword", F.lit("")))
    name = (
        F.when((prefix != "") & (tail != ""), F.concat(prefix, F.lit("-"), tail))
        .when(prefix != "", prefix).when(tail != "", tail).otherwise("cluster")
    )
    return joined.select(
        "community_id", name.alias("name"), "size", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"),
        F.coalesce("dominant_language", F.lit("")).alias("dominant_language"),
    )


def list_communities(table: DataFrame, sort_by: str = "size", min_size: int = 0) -> DataFrame:
    order = {"size": F.desc("size"), "cohesion": F.desc("cohesion"), "name": F.asc("name")}
    return table.where(F.col("size") >= min_size).orderBy(
        order.get(sort_by, order["size"]), "community_id"
    )


def find_community(table: DataFrame, text: str) -> DataFrame:
    """First community whose name contains the text."""
    return table.where(F.lower("name").contains(text.lower())).orderBy("community_id").limit(1)


def cross_edges(g: CodeGraph, members: DataFrame) -> DataFrame:
    return edge_communities(g, members).where(F.col("src_c") != F.col("dst_c")).select(
        F.col("src_c").alias("source_community"), F.col("dst_c").alias("target_community"),
        F.col("kind").alias("edge_kind"), "source", "target",
    )


def coupling(g: CodeGraph, members: DataFrame, above: int = 10) -> DataFrame:
    """Unordered community pairs joined by more than ``above`` edges."""
    return (
        edge_communities(g, members).where(F.col("src_c") != F.col("dst_c"))
        .groupBy(F.least("src_c", "dst_c").alias("community_a"), F.greatest("src_c", "dst_c").alias("community_b"))
        .agg(F.count("*").alias("edge_count")).where(F.col("edge_count") > above)
    )


def degrees(g: CodeGraph) -> DataFrame:
    """Outgoing and incoming edge counts per name in one aggregate."""
    ends = g.edges.select(F.col("source").alias("qualified_name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        g.edges.select(F.col("target").alias("qualified_name"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("qualified_name").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))


def key_symbols(g: CodeGraph, members: DataFrame, k: int = 5) -> DataFrame:
    """Top symbols per community; out- and in-counts multiply as in a double join."""
    m, n = F.coalesce("out_edges", F.lit(0)), F.coalesce("in_edges", F.lit(0))
    weight = m * F.greatest(n, F.lit(1)) + n * F.greatest(m, F.lit(1))
    scored = (
        members.join(g.nodes.where(F.col("kind") != "File").select("qualified_name", "name"), "qualified_name")
        .join(degrees(g), "qualified_name", "left")
        .select("community_id", "qualified_name", "name", weight.alias("weight"))
    )
    return top_per_key(scored, ["community_id"], [F.desc("weight"), F.asc("qualified_name")], k)


def purpose(g: CodeGraph, members: DataFrame) -> DataFrame:
    """Last directory of the common path prefix, from the least and greatest path."""
    span = (
        members.join(g.nodes.select("qualified_name", "file_path"), "qualified_name")
        .groupBy("community_id").agg(F.min("file_path").alias("lo"), F.max("file_path").alias("hi"))
    )
    common = F.array_max(F.filter(
        F.sequence(F.lit(0), F.length("lo")),
        lambda i: F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i),
    ))
    prefix = F.substring(F.col("lo"), F.lit(1), common)
    folder = F.regexp_replace(prefix, "/[^/]*$", "")
    return span.select(
        "community_id",
        F.when(prefix.contains("/"), F.element_at(F.split(folder, "/"), -1)).otherwise("").alias("purpose"),
    )


def move_suggestions(g: CodeGraph, members: DataFrame) -> DataFrame:
    """Functions whose known callers all live in one other community."""
    calls = g.edges_of("CALLS").select("source", "target").distinct()
    own = members.select(F.col("qualified_name").alias("target"), F.col("community_id").alias("from_community"))
    other = members.select(F.col("qualified_name").alias("source"), F.col("community_id").alias("to_community"))
    return (
        g.nodes_of("Function").select(F.col("qualified_name").alias("target")).join(own, "target")
        .join(calls, "target").join(other, "source")
        .groupBy("target", "from_community").agg(
            F.min("to_community").alias("to_community"), F.max("to_community").alias("_hi")
        )
        .where((F.col("to_community") == F.col("_hi")) & (F.col("to_community") != F.col("from_community")))
        .select(F.col("target").alias("qualified_name"), "from_community", "to_community")
    )


def dependency_counts(g: CodeGraph, members: DataFrame, k: int | None = 15) -> DataFrame:
    """Names outside a community that its members use or are used by, most frequent first."""
    ends = edge_communities(g, members)
    outside = ~F.coalesce(F.col("src_c") == F.col("dst_c"), F.lit(False))
    out = ends.where(F.col("src_c").isNotNull() & outside).select(
        F.col("src_c").alias("community_id"), F.lit("outgoing").alias("direction"), F.col("target").alias("other"))
    into = ends.where(F.col("dst_c").isNotNull() & outside).select(
        F.col("dst_c").alias("community_id"), F.lit("incoming").alias("direction"), F.col("source").alias("other"))
    counts = out.unionByName(into).groupBy("community_id", "direction", "other").agg(F.count("*").alias("edge_count"))
    if k is None:
        return counts
    return top_per_key(counts, ["community_id", "direction"], [F.desc("edge_count"), F.asc("other")], k)


def community_flows(flows: DataFrame, flow_members: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """Per community the most critical of all flows through it."""
    through = (
        flow_members.select(F.col("root").alias("entry_point"), F.col("node").alias("qualified_name"))
        .join(flows.select("entry_point", "criticality"), "entry_point")
        .join(members, "qualified_name").select("community_id", "entry_point", "criticality").distinct()
    )
    return top_per_key(through, ["community_id"], [F.desc("criticality"), F.asc("entry_point")], k)


def touches_communities(g: CodeGraph, members: DataFrame, changed_files: DataFrame) -> bool:
    """Gate of the incremental refresh: does a changed file hold a member?"""
    files = changed_files.select("file_path").distinct()
    return not (
        g.nodes.join(files, "file_path", "left_semi").join(members, "qualified_name", "left_semi").isEmpty()
    )


def modularity(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Weighted modularity of a partition; the quality check of a clustering."""
    c = members.select("qualified_name", "community_id")
    ends = pairs.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b")
    total = pairs.agg(F.sum("w")).scalar()
    inner = ends.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inner"))
    degree = (
        ends.select("ca", "w").unionByName(ends.select(F.col("cb").alias("ca"), "w"))
        .groupBy("ca").agg(F.sum("w").alias("deg"))
    )
    share = degree.join(inner, "ca", "left").select(
        F.coalesce("inner", F.lit(0.0)).alias("inner"), "deg"
    )
    return share.agg(
        F.sum(F.col("inner") / total - F.pow(F.col("deg") / (total * 2), F.lit(2.0))).alias("modularity")
    )


def refresh_communities(g: CodeGraph, members: DataFrame, changed_files: DataFrame, detect=file_members) -> DataFrame:
    """Detect again only when a changed file holds a member; else keep the old ones."""
    return detect(g) if touches_communities(g, members, changed_files) else members
