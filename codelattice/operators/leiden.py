"""Communities by modularity: local moves, refinement inside communities, contraction, until nothing gains.

One level works on a weighted graph of nodes and undirected links.

- *Moves.* Nodes lie in two halves (by a hash of their name). In turn all nodes of one half choose the neighbouring
  community with the largest gain in modularity, ties the smallest name. The half's moves are kept together if
  modularity rises. Else only moves are made that cannot disturb each other: each community names the best move
  that leaves or enters it, and a move named by both of its communities is made; these gains add up. Rounds end when
  no node of either half has a move that gains.
- *Refinement.* Every community is taken apart into single nodes, which join groups inside their community under the
  same rule; a node that has joined others stays.
- *Contraction.* Refined groups become the nodes of the next level, which starts from the communities. The last
  level is the one in which no group forms.

Modularity is kept as an exact integer, so every kept round raises it and every level has fewer nodes: both
loops end by themselves, without a limit on rounds. One job takes a labelling, measures it and finds the best move of
every node of both halves: links meet the labels of their far ends and are summed per (node, community) before the
shuffle, so a hub costs one row per community next to it. A kept round is one job, a round without moves none, a round
whose moves disturb each other two. Nodes are numbers in the order of their names. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codelattice.model import CodeGraph
from codelattice.operators.communities import file_members, weighted_pairs
from codelattice.session import FEW_ROWS, shuffled, stage

WIDE = "decimal(38,0)"


def half_of(node: str) -> Column:
    """0 or 1 by the last digit of the name's digest."""
    return F.ascii(F.right(F.md5(F.col(node)), F.lit(1))) % 2


def whole_weights(pairs: DataFrame) -> DataFrame:
    """Links (node, via, w) in both directions; weights in tenths, so that sums are exact."""
    w = F.round(F.col("w") * 10).cast("bigint").alias("w")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("via"), w).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("via"), w))


class _Measured:
    """A labelling as rows (node, k, half, label, to, gain, goes), its modularity times the square of the total, and the nodes of each half that want to move."""

    def __init__(self, rows: DataFrame, value: int, moved: tuple[int, int]):
        self.rows, self.value, self.moved = rows, value, moved

    def together(self, half: int) -> DataFrame:
        """Labels after all wanted moves of a half."""
        return self._after(self.rows, F.col("goes") & (F.col("half") == half))

    def apart(self, half: int) -> DataFrame:
        """Labels after those moves of a half that are the best of both communities they touch."""
        touched = self.rows.where(F.col("goes") & (F.col("half") == half)).select("node", "gain", F.explode(F.array("label", "to")).alias("community"))
        named = touched.groupBy("community").agg(F.min_by("node", F.struct(-F.col("gain"), F.col("node"))).alias("node"))
        made = named.groupBy("node").agg((F.count(F.lit(1)) == 2).alias("made"))
        return self._after(self.rows.join(made, "node", "left"), F.coalesce(F.col("made"), F.lit(False)))

    @staticmethod
    def _after(rows: DataFrame, moves: Column) -> DataFrame:
        return rows.select("node", "k", "half", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label"))


class _Level:
    """Nodes (node, k, half) and links (node, k, via, w) of one level; ``total`` is the sum of all degrees of the graph."""

    def __init__(self, nodes: DataFrame, links: DataFrame, total: int, size: int):
        self.nodes, self.links, self.total, self.size = nodes, links, total, size

    @staticmethod
    def of(nodes: DataFrame, links: DataFrame, total: int, size: int) -> _Level:
        """A level of links (node, via, w), which get the degree of their node."""
        return _Level(nodes, stage(links.join(nodes.select("node", "k"), "node"), "links"), total, size)

    def _sized(self, rows: DataFrame) -> DataFrame:
        return rows if self.size <= FEW_ROWS else shuffled(rows)

    def measure(self, labels: DataFrame, single: bool) -> _Measured:
        """Modularity of labels (node, k, half, label) and every node's best move from there."""
        sizes = labels.groupBy("label").agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("n"))
        known = labels.join(self._sized(sizes), "label")
        far = self.links.join(self._sized(known.select(F.col("node").alias("via"), "label", "t")), "via")
        none = F.lit(None)
        rows = far.select("node", "k", "label", "t", "w", none.cast("int").alias("half"), none.cast("bigint").alias("n")).unionByName(
            known.select("node", "k", "label", "t", F.lit(0).cast("bigint").alias("w"), F.col("half").cast("int").alias("half"), "n"))
        near = rows.groupBy("node", "k", "label").agg(F.sum("w").alias("s"), F.first("t").alias("t"), F.max("half").alias("half"), F.max("n").alias("n"))
        total, k, own = F.lit(self.total).cast(WIDE), F.col("k").cast(WIDE), F.col("half").isNotNull()
        # Each node's best move beside what it has.
        near = near.withColumn("g", F.when(~own, F.col("s").cast(WIDE) * total - k * F.col("t").cast(WIDE)))
        mine = lambda c: F.max(F.when(own, F.col(c)))
        best = near.groupBy("node", "k").agg(
            F.min_by("label", F.when(~own, F.struct(-F.col("g"), F.col("label")))).alias("to"), F.max("g").alias("g"),
            mine("label").alias("label"), mine("s").alias("inner"), mine("t").alias("t"), F.max("half").alias("half"), F.max("n").alias("n"))
        gain = F.col("g") - (F.col("inner").cast(WIDE) * total - k * (F.col("t") - F.col("k")).cast(WIDE))
        goes = F.coalesce(gain > 0, F.lit(False))
        if single:
            goes = goes & (F.col("n") == 1)
        seen, moved = Observation(), lambda half: F.count_if(F.col("goes") & (F.col("half") == half))
        found = best.select("node", "k", "half", "label", "to", gain.alias("gain"), goes.alias("goes"), "inner", "t").observe(
            seen, moved(0).alias("even"), moved(1).alias("odd"), F.sum("inner").alias("inside"), F.sum(k * F.col("t").cast(WIDE)).alias("square"))
        kept = stage(found, "labels").drop("inner", "t")
        counts = seen.get
        return _Measured(kept, int(counts["inside"] or 0) * self.total - int(counts["square"] or 0), (counts["even"], counts["odd"]))

    def settle(self, start: DataFrame, single: bool = False) -> DataFrame:
        """(node, label) when no node has a move that raises modularity; ``start`` is (node, label)."""
        now = self.measure(self.nodes.join(start, "node"), single)
        turn = quiet = 0
        while quiet < 2:
            half = turn % 2
            turn += 1
            quiet += 1
            if not now.moved[half]:
                continue
            for moves in (now.together, now.apart):
                new = self.measure(moves(half), single)
                if new.value > now.value:
                    now, quiet = new, 0
                    break
        return now.rows.select("node", "label")

    def inside(self, labels: DataFrame) -> _Level:
        """The same nodes with only the links inside communities."""
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
        kept = self.links.join(self._sized(of("node")), "node").join(self._sized(of("via")), "via").where("_node = _via").select("node", "k", "via", "w")
        return _Level(self.nodes, stage(kept, "links"), self.total, self.size)

    def contracted(self, groups: DataFrame, size: int) -> _Level:
        """Groups (node, label) as nodes; links between them are summed."""
        to = groups.select("node", "label")
        sums = self.nodes.join(self._sized(to), "node").groupBy(F.col("label").alias("node")).agg(F.sum("k").alias("k"))
        nodes = stage(sums.join(self._sized(self.nodes.select("node", "half")), "node"), "nodes")
        ends = self.links.join(self._sized(to), "node").select(F.col("label").alias("a"), "via", "w").join(
            self._sized(to.select(F.col("node").alias("via"), F.col("label").alias("b"))), "via")
        links = ends.where("a <> b").groupBy(F.col("a").alias("node"), F.col("b").alias("via")).agg(F.sum("w").alias("w"))
        return _Level.of(nodes, links, self.total, size)


def communities(pairs: DataFrame) -> DataFrame:
    """(node, label) for every node of the weighted pairs (a, b, w); a label is the smallest node name of its community."""
    ends = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    names = stage(ends.repartitionByRange("name").sortWithinPartitions("name").select("name", F.monotonically_increasing_id().alias("id"), half_of("name").alias("half")), "names")
    of = lambda name, number: shuffled(names.select(F.col("name").alias(name), F.col("id").alias(number)))
    numbered = stage(pairs.join(of("a", "ia"), "a").join(of("b", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "w"), "numbered")
    links = whole_weights(numbered)
    nodes = stage(links.groupBy("node").agg(F.sum("w").alias("k")).join(shuffled(names.select(F.col("id").alias("node"), "half")), "node"), "nodes")
    about = nodes.agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size")).first()
    total, size = int(about["total"] or 0), about["size"]
    level, start = _Level.of(nodes, links, total, size), nodes.select("node", F.col("node").alias("label"))
    members = nodes.select(F.col("node").alias("member"), "node")
    while size:
        labels = level.settle(start)
        groups = level.inside(labels).settle(level.nodes.select("node", F.col("node").alias("label")), single=True)
        smaller = groups.select("label").distinct().count()
        if smaller == size:
            members = members.join(shuffled(labels), "node")
            break
        size = smaller
        both = labels.select("node", F.col("label").alias("community")).join(groups.select("node", F.col("label").alias("group")), "node")
        named = both.groupBy("community").agg(F.min("group").alias("label"))
        start = stage(both.join(named, "community").select(F.col("group").alias("node"), "label").distinct(), "start")
        members = stage(members.join(groups.select("node", F.col("label").alias("group")), "node").select("member", F.col("group").alias("node")), "members")
        level = level.contracted(groups, size)
    else:
        return names.select(F.col("name").alias("node"), F.col("name").alias("label"))
    first = members.groupBy("label").agg(F.min("member").alias("first"))
    named = lambda number, name: shuffled(names.select(F.col("id").alias(number), F.col("name").alias(name)))
    found = members.join(shuffled(first), "label").join(named("member", "node_name"), "member").join(named("first", "first_name"), "first")
    return found.select(F.col("node_name").alias("node"), F.col("first_name").alias("label"))


def leiden_members(g: CodeGraph, min_size: int = 2, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Communities with at least ``min_size`` nodes over all edges, or those of some kinds; file grouping where none joins two nodes."""
    pairs = stage(weighted_pairs(g if kinds is None else CodeGraph(g.nodes, g.edges_of(*kinds))), "pairs")
    if pairs.isEmpty():
        return file_members(g, min_size)
    members = stage(communities(pairs).select(F.col("label").alias("community_id"), F.col("node").alias("qualified_name")), "communities")
    keep = members.groupBy("community_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return members.join(keep, "community_id", "left_semi")
