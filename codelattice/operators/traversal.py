"""Bounded graph traversal as level-synchronous joins.

One job per level: the frontier meets the edges (bucketed on their source, so
they are shuffled once for all levels), results are reduced per key before and
after the shuffle, visited names are removed by an anti-join and the level is
written to the shared folder. Walks that need an order or a path keep one
pointer per row to the row before it; paths are rebuilt only where asked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.model import CodeGraph
from codelattice.operators.lookup import top_per_key
from codelattice.session import Levels, cut, drop_table, shuffled, stage, stage_bucketed

# A source with more links than this is spread over several buckets.
HUB_LINKS = 100_000


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    )


class StagedLinks:
    """Links staged once in buckets by source, for many joins on it.

    The links of a source are one bucket and thus one task of every join. The
    out-degrees are measured first; sources above ``hub_links`` are dealt over
    salts by target, and only rows that stand on such a source are repeated,
    once per salt. There are at most links / ``hub_links`` hubs.
    """

    def __init__(self, links: DataFrame, name: str, hub_links: int = HUB_LINKS):
        hubs = stage(
            links.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > hub_links)
            .select("source", F.ceil(F.col("n") / hub_links).cast("int").alias("salts")),
            "hubs",
        )
        self.hubs = None if hubs.isEmpty() else hubs
        self.keys = ["source"]
        if self.hubs is not None:
            self.keys = ["source", "salt"]
            salt = F.pmod(F.xxhash64("target"), F.coalesce("salts", F.lit(1))).cast("int")
            links = links.join(self.hubs, "source", "left").withColumn("salt", salt).drop("salts")
        self.rows, self.table = stage_bucketed(links, name, *self.keys)

    def follow(self, frontier: DataFrame, node: str) -> DataFrame:
        """Frontier rows, their ``node`` as ``source``, beside every link that leaves it."""
        keyed = frontier.withColumnRenamed(node, "source")
        if self.hubs is not None:
            salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
            keyed = keyed.join(self.hubs, "source", "left").withColumn("salt", F.explode(salts)).drop("salts")
        return keyed.join(self.rows, self.keys)

    def drop(self) -> None:
        drop_table(self.rows.sparkSession, self.table)


def ranked(level: DataFrame, *order: str) -> DataFrame:
    """A level with ``rank``, a number that grows in the given order.

    Rows are cut into ranges of the order, so no root is bound to one task.
    Ranks have gaps between ranges; inside one they follow each other.
    """
    return level.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "rank", F.monotonically_increasing_id()
    )


def digest(name: str) -> Column:
    """128 bits that stand for a name where only equality counts: a fraction of the text in every shuffle."""
    return F.unhex(F.md5(F.col(name)))


def reach(
    seeds: DataFrame, edges: DataFrame, max_depth: int, hub_links: int = HUB_LINKS, names: DataFrame | None = None
) -> DataFrame:
    """Names within ``max_depth`` hops of the seeds with their least depth.

    ``seeds`` has ``qualified_name``; ``edges`` has ``source`` and ``target``.
    Names travel as digests. With ``names`` (qualified_name and further columns)
    only these come back, with their columns; else all that were reached.
    """
    spark = seeds.sparkSession
    links = edges.select(digest("source").alias("source"), digest("target").alias("target"))
    staged = StagedLinks(links.distinct(), "links", hub_links) if max_depth > 2 else None
    levels = Levels(spark, "reach")
    frontier = levels.add(seeds.select(digest("qualified_name").alias("node")).distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        here = frontier.select("node")
        met = staged.follow(here, "node") if staged else here.withColumnRenamed("node", "source").join(links, "source")
        step = (
            met.select(F.col("target").alias("node"))
            .distinct()
            .join(levels.all().select("node"), "node", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = levels.add(step)
        if levels.last_rows == 0:
            break
    if staged:
        staged.drop()
    if names is None:
        names = seeds.select("qualified_name").unionByName(
            edges.select(F.col("target").alias("qualified_name"))).distinct()
    return shuffled(names.withColumn("node", digest("qualified_name"))).join(levels.all(), "node").drop("node")


def impact_radius(
    g: CodeGraph,
    changed_files: DataFrame,
    max_depth: int = S.IMPACT_MAX_DEPTH,
    max_nodes: int | None = None,
) -> DataFrame:
    """Nodes around changed files over all edge kinds in both directions.

    Rows: the changed nodes (depth 0) and the impacted ones. Names that are no
    nodes are walked through but not returned. With ``max_nodes`` only the
    nearest impacted nodes of the complete walk are shown, beside how many
    there are (``total_impacted``) and whether some are not shown (``truncated``).
    """
    seeds = g.nodes.join(changed_files.select("file_path").distinct(), "file_path", "left_semi")
    found = reach(
        seeds, both_ways(g.edges), max_depth, names=g.nodes.select("qualified_name", "kind", "file_path")
    ).select(
        "qualified_name", "kind", "file_path", "depth",
        F.when(F.col("depth") == 0, "changed").otherwise("impacted").alias("role"),
    )
    if max_nodes is None:
        return found
    impacted = found.where(F.col("depth") > 0)
    total = impacted.agg(F.count("*")).scalar()
    near = impacted.orderBy("depth", "qualified_name").limit(max_nodes)
    return found.where(F.col("depth") == 0).unionByName(near).select(
        "*", total.alias("total_impacted"), (total > max_nodes).alias("truncated")
    )


def impact_radius_recursive(g: CodeGraph, changed_files: DataFrame, max_depth: int = 2) -> DataFrame:
    """The names of the walk with their depth, also those that are no nodes.

    Spark's recursive SQL would follow every way, not every name, and ends at a million rows.
    """
    seeds = g.nodes.join(changed_files.select("file_path").distinct(), "file_path", "left_semi")
    return reach(seeds, both_ways(g.edges), max_depth)


def impact_files(impact: DataFrame) -> DataFrame:
    return impact.where(F.col("role") == "impacted").select("file_path").distinct()


def trace(
    roots: DataFrame, calls: DataFrame, max_depth: int = S.FLOW_MAX_DEPTH,
    toward: DataFrame | None = None, hub_links: int = HUB_LINKS,
) -> DataFrame:
    """Multi-source forward walk: rows (root, node, depth, rank, parent, line).

    All roots advance together. Within a root and depth ``rank`` grows in the
    order of discovery: by the parent's rank, then line, then name. ``parent``
    is the rank of the row one level up through which the node was first found,
    ``line`` that of the call. ``roots`` has ``root``; ``calls`` has ``source``,
    ``target``, ``line``. ``toward`` (node, left) keeps the walk on nodes that
    have a goal at most ``left`` hops away, as far as hops are left.
    """
    spark = calls.sparkSession
    steps = calls.groupBy("source", "target").agg(F.min("line").alias("line"))
    if toward is not None:
        steps = steps.join(toward.select(F.col("node").alias("target"), "left"), "target")
    links = StagedLinks(steps, "steps", hub_links)
    levels = Levels(spark, "trace")
    frontier = levels.add(
        roots.select("root").distinct().select(
            "root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("rank"),
            F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("int").alias("line"),
        )
    )
    for depth in range(1, max_depth + 1):
        met = links.follow(frontier.select("root", "node", F.col("rank").alias("parent")), "node")
        if toward is not None:
            met = met.where(F.col("left") <= max_depth - depth)
        found = (
            met.groupBy("root", F.col("target").alias("node"))
            .agg(F.min(F.struct("parent", "line")).alias("first"))
            .join(levels.all().select("root", "node"), ["root", "node"], "left_anti")
            .select("root", "node", F.lit(depth).alias("depth"), "first.parent", "first.line")
        )
        frontier = levels.add(
            ranked(found, "root", "parent", "line", "node").select("root", "node", "depth", "rank", "parent", "line")
        )
        if levels.last_rows == 0:
            break
    links.drop()
    return levels.all()


def paths(members: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (root, node, depth, path): the names from root to node, both included.

    Pointers to the row before are doubled, so a chain of n names takes log2(n)
    joins. ``wanted`` (root, node) asks for some members only.
    """
    rows = members
    if wanted is not None:
        rows = members.join(wanted.select("root").distinct(), "root", "left_semi")
    top = rows.agg(F.max("depth").alias("d")).first()["d"] or 0
    chains = rows.select(
        "root", "node", "depth", "rank",
        (F.col("depth") - 1).alias("up_depth"), F.col("parent").alias("up"), F.array("node").alias("path"),
    )
    for _ in range(top.bit_length()):
        above = chains.select(
            "root", F.col("depth").alias("up_depth"), F.col("rank").alias("up"),
            F.col("up_depth").alias("next_depth"), F.col("up").alias("next_up"), F.col("path").alias("head"),
        )
        joined = chains.join(above, ["root", "up_depth", "up"], "left")
        chains = stage(joined.select(
            "root", "node", "depth", "rank",
            F.col("next_depth").alias("up_depth"), F.col("next_up").alias("up"),
            F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"),
        ), "chains")
    out = chains.select("root", "node", "depth", "path")
    return out if wanted is None else out.join(wanted.select("root", "node").distinct(), ["root", "node"], "left_semi")


def file_links(g: CodeGraph) -> DataFrame:
    """File-level dependencies, used file → using file."""
    links = g.edges_of("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS")
    owner = g.nodes.select(F.col("qualified_name").alias("target"), F.col("file_path").alias("used"))
    by_node = links.select("target", "file_path").join(owner, "target").select("used", "file_path")
    by_file = g.edges_of("IMPORTS_FROM").select(F.col("target").alias("used"), "file_path")
    return (
        by_node.unionByName(by_file).where(F.col("used") != F.col("file_path")).distinct()
        .select(F.col("used").alias("source"), F.col("file_path").alias("target"))
    )


def dependent_files(g: CodeGraph, files: DataFrame, max_hops: int = 2, cap: int | None = None) -> DataFrame:
    """Files within ``max_hops`` reverse dependencies of the given files.

    ``cap`` shows only the first paths of the complete result.
    """
    seeds = files.select(F.col("file_path").alias("qualified_name"))
    found = reach(seeds, file_links(g), max_hops)
    out = found.where(F.col("depth") > 0).select(F.col("qualified_name").alias("file_path"), F.col("depth").alias("hops"))
    return out if cap is None else out.orderBy("hops", "file_path").limit(cap)


def call_path(g: CodeGraph, start: str, goal: str, max_depth: int = 8) -> DataFrame:
    """Shortest call chain to a target that equals or contains ``goal``.

    The start text is matched as a substring of callers; later steps follow
    exact names. No row means no path.
    """
    links = StagedLinks(g.edges_of("CALLS").select("source", "target").distinct(), "calls")
    levels = Levels(g.spark, "path")
    first = links.rows.where((F.col("source") == start) | F.lower("source").contains(start.lower()))
    found = first.select(F.col("target").alias("node")).distinct().withColumn("parent", F.lit(0).cast("bigint"))
    kept = []
    for hop in range(1, max_depth + 1):
        level = found.where(F.col("node") != start)
        kept.append(levels.add(ranked(level, "parent", "node").select("node", "rank", "parent")))
        hits = kept[-1].where(F.col("node").contains(goal))
        if levels.last_rows == 0 or hop == max_depth or not hits.isEmpty():
            break
        found = (
            links.follow(kept[-1].select("node", F.col("rank").alias("parent")), "node")
            .groupBy(F.col("target").alias("node")).agg(F.min("parent").alias("parent"))
            .join(levels.all().select("node"), "node", "left_anti")
        )
    links.drop()
    chain = hits.orderBy("rank").limit(1).select("parent", F.array("node").alias("path"))
    for level in reversed(kept[:-1]):  # one row, followed back through its pointers
        above = level.select(F.col("rank").alias("parent"), F.col("parent").alias("up"), "node")
        chain = chain.join(above, "parent").select(
            F.col("up").alias("parent"), F.concat(F.array("node"), "path").alias("path"))
    return chain.select(F.concat(F.array(F.lit(start)), "path").alias("path"), F.size("path").alias("hops"))


def neighborhood(g: CodeGraph, root: str, depth: int = 1, fan: int | None = None) -> DataFrame:
    """Edges around a node; with ``fan`` at most so many per frontier node and direction."""
    exact = g.nodes.where(F.col("qualified_name") == root)
    loose = g.nodes.where(F.lower("qualified_name") == root.lower()).orderBy("qualified_name").limit(1)
    start = exact if not exact.isEmpty() else loose
    frontier = cut(start.select("qualified_name"))
    seen, kept = [frontier], []
    for hop in range(1, depth + 1):
        out = g.edges.join(frontier.withColumnRenamed("qualified_name", "source"), "source", "left_semi")
        into = g.edges.join(frontier.withColumnRenamed("qualified_name", "target"), "target", "left_semi")
        order = [F.col(c) for c in S.EDGE_KEY]
        if fan is not None:
            out, into = top_per_key(out, ["source"], order, fan), top_per_key(into, ["target"], order, fan)
        level = cut(out.select(*S.EDGE_KEY).unionByName(into.select(*S.EDGE_KEY)).distinct())
        kept.append(level)
        ends = level.select(F.col("source").alias("qualified_name")).unionByName(
            level.select(F.col("target").alias("qualified_name"))
        )
        frontier = cut(
            ends.distinct().join(_union(seen), "qualified_name", "left_anti")
            .join(g.nodes.select("qualified_name"), "qualified_name", "left_semi")
        )
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return _union(kept).distinct()
