"""Filter interaction audit: what each filter removes under every order, by decision diagrams.

Each document gets one failure bit per filter. Per part the documents collapse into counts per failure
mask (at most 32 cells), and from these a count-weighted decision diagram is built: one level per filter in
the order in which filters are applied, equal sub-diagrams shared, every node with the number of documents
under it, those with the label good and those with the label toxic. The path that passes at every level
gives the steps of an order: a node's fail child is what the filter removes there, its pass child what goes
on. All orders are visited by exchanging two neighbouring filters at a time; such an exchange rebuilds only the
nodes of two levels.

Masks and text digests are computed where texts are read; only slim rows are shuffled. The duplicate filter
takes the smallest key of each text's digest (128 bits, combined in the task first, single texts dropped) and joins it
back, so that a group of copies is only the many side of a join with a unique key; so are labels, reduced to a
row per key before. Cells are combined before the shuffle, and a task works on one row per part.

Defined results. Null text counts as empty. Words are maximal runs of characters other than ASCII white space.
A row fails E if its key is above the smallest key with that text, so the same key twice is no duplicate of itself,
and null keys neither fail E nor make others fail. Null parts count as the empty string. Labels with several rows
per key count if any row has the label; keys without labels have none. Repeated rows count as often as
they occur. Empty tables give no parts, thus no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import batch_of, staged

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


# ---------------------------------------------------------------- failure masks

def text_masks(text: Column) -> Column:
    """Bits of the filters that look at one text: A 1, B 2, C 4, D 8."""
    words = F.array_remove(F.split(text, SPACE), "")
    few = F.size(words) < 50
    same = 100 * F.size(F.array_distinct(words)) < 65 * F.size(words)
    capitals = 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 5 * F.length(text)
    signs = text.rlike("[#$%&*|]")
    return sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate((few, same, capitals, signs))), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and failure mask, and those with either label."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    rows = staged(plain.select("key", "part", text_masks(F.col("body")).cast("int").alias("mask"), F.unhex(F.md5("body")).alias("digest")), "failure_masks")
    firsts = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    seen = rows.join(firsts, "digest", "left").join(marks, "key", "left")
    copy = F.when(F.col("key") > F.col("first"), 16).otherwise(0)
    return seen.groupBy("part", (F.col("mask") + copy).cast("int").alias("mask")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic")
    )


# ---------------------------------------------------------------- decision diagram

class Diagram:
    """A shared, count-weighted decision diagram over failure bits; level ``i`` asks filter ``order[i]``.

    Nodes are numbers. ``children`` holds (pass child, fail child), ``weight`` the counts under a node; a terminal
    has no children. Every path asks every filter, so weights add up without factors.
    """

    def __init__(self, cells: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self.children: list[tuple[int, int] | None] = []
        self.weight: list[tuple[int, ...]] = []
        self.known: dict = {}
        zero = (0,) * len(next(iter(cells.values()), (0,)))

        def build(level: int, mask: int) -> int:
            if level == filters:
                return self.terminal(cells.get(mask, zero))
            return self.node(build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _add(self, mark, children, weight) -> int:
        if mark not in self.known:
            self.known[mark] = len(self.weight)
            self.children.append(children)
            self.weight.append(weight)
        return self.known[mark]

    def terminal(self, weight: tuple[int, ...]) -> int:
        return self._add(("end", weight), None, weight)

    def node(self, passed: int, failed: int) -> int:
        total = tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed], strict=True))
        return self._add((passed, failed), (passed, failed), total)

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below; nodes further down stay as they are."""
        done: dict[tuple[int, int], int] = {}

        def lifted(node: int, depth: int) -> int:
            if (node, depth) not in done:
                passed, failed = self.children[node]
                if depth < level:
                    done[node, depth] = self.node(lifted(passed, depth + 1), lifted(failed, depth + 1))
                else:
                    (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
                    done[node, depth] = self.node(self.node(pp, fp), self.node(pf, ff))
            return done[node, depth]

        self.root = lifted(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the path that passes everywhere."""
        out, at = [], self.root
        for one in self.order:
            passed, failed = self.children[at]
            out.append((one, self.weight[passed], self.weight[failed]))
            at = passed
        return out

    def all_passed_but(self, level: int) -> tuple[int, ...]:
        """Counts of what fails the filter of ``level`` and no other."""
        at = self.root
        for depth in range(len(self.order)):
            at = self.children[at][depth == level]
        return self.weight[at]


def neighbour_swaps(n: int) -> list[int]:
    """Positions to exchange with their successor so that all orders of ``n`` things are met once (plain changes)."""
    if n < 2:
        return []
    inner, out, down = neighbour_swaps(n - 1), [], True
    for i in range(len(inner) + 1):
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if i < len(inner):
            out.append(inner[i] + down)
        down = not down
    return out


def audit_part(cells: dict[int, tuple[int, int, int]], names: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of a part."""
    diagram = Diagram(cells, len(names))
    total, only, share, met = {}, {}, dict.fromkeys(range(len(names)), 0), []
    for level in [None, *neighbour_swaps(len(names))]:
        if level is not None:
            diagram.swap(level)
        steps = diagram.steps()
        first = steps[0]
        total[first[0]] = first[2][0]
        only[first[0]] = diagram.all_passed_but(0)[0]
        for one, _, removed in steps:
            share[one] += removed[0]
        met.append((list(diagram.order), steps))
    return [
        ("".join(names[i] for i in order), at + 1, kept[0], gone[0], total[one] - gone[0], only[one], gone[1], gone[2], share[one])
        for order, steps in met for at, (one, kept, gone) in enumerate(steps)
    ]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with document counts (see ``audit_part``)."""
    cells = failures(docs, labels, key, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = audit_part({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in row["cells"]})
                columns = dict(zip(schema.names[1:], map(list, zip(*found, strict=True)), strict=True))
                yield batch_of(schema, part=[row["part"]] * len(found), **columns)

    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def brute_force(rows: list[tuple[int | None, str | None, str | None]], marks: dict[int, tuple[int, int]], names: str = FILTERS) -> list[tuple]:
    """The audit of a few (key, text, part) rows by applying the filters in each order, one after the other (for tests)."""
    import itertools
    import re

    failed = []
    for key, text, part in rows:
        body = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 5 * len(body), "D": bool(re.search(r"[#$%&*|]", body))}
        own["E"] = any(k is not None and key is not None and k < key and (t or "") == body for k, t, _ in rows)
        failed.append((part or "", own, marks.get(key, (0, 0))))
    out, shares = [], {}
    for part in {p for p, _, _ in failed}:
        inside = [(own, mark) for p, own, mark in failed if p == part]
        for order in map("".join, itertools.permutations(names)):
            left = inside
            for step, one in enumerate(order, 1):
                gone, left = [x for x in left if x[0][one]], [x for x in left if not x[0][one]]
                failing = [own for own, _ in inside if own[one]]
                shares[part, one] = shares.get((part, one), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), len(failing) - len(gone), sum(sum(own.values()) == 1 for own in failing), sum(m[0] for _, m in gone), sum(m[1] for _, m in gone)])
    return [(*x, shares[x[0], x[1][x[2] - 1]]) for x in out]
