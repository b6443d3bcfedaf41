"""The conversation trie: whole results against sequences, sharding, long conversations, the queue."""

import random

import pytest
from pyspark.sql import functions as F

from codelattice.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def talks(seed=7, convs=160):
    random.seed(seed)
    openings = [("system", "be kind and short"), ("user", "hello there"), ("assistant", "hello  to\tyou"), ("user", ""), (None, None)]
    rows = []
    for c in random.sample(range(-40, 400), convs):
        for turn in range(random.choice([1, 1, 2, 3, 4, 6, 9])):
            role, text = openings[turn % 5] if random.random() < 0.7 else (random.choice(["user", "tool"]), f"word {random.randrange(3)}")
            rows.append((c, random.choice([turn, turn, turn, None, 1]), role, text))
    copied = [r for r in rows if r[0] == rows[0][0]]
    rows += [(1000 + i, *r[1:]) for i in range(40) for r in copied]
    rows += rows[:7] + [(None, 1, "user", "nobody's"), (5000, None, None, None), (5001, 0, "user", "x " * 20_000), (5020, 0, "a:", "b"), (5040, 0, "a", ":b"), (5060, 0, "r" * 50 + "b", "t"), (5060, 0, "r" * 50 + "a", "u")]
    return rows


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("conv", "depth", "n0", "k0", "words", "h", "block", "part"):
        df = df.withColumn(name, F.lit("x"))
    return df


def same(df, rows):
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, prefix_trie.brute_force(rows)))


@pytest.mark.parametrize(("least", "queue"), [(1024, 1 << 18), (3, 2), (1, 1)])
def test_trie_equals_brute_force(spark, least, queue):
    rows = talks()
    same(prefix_trie.build(table(spark, rows), least_members=least, queue=queue), rows)


def test_long_conversations_are_spread(spark, monkeypatch):
    """A conversation with most of the turns, and a copy of it, over many partitions and blocks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(c, t, "user", f"turn {t % 11}") for c in (40, 41, 47, 60) for t in range(150)] + [(c, t, "user", f"turn {t % 11}") for c in (42, 43, 44, 45) for t in range(4)]
    same(prefix_trie.build(table(spark, rows), least_members=2), rows)
    parts = prefix_trie._numbered(table(spark, rows)).groupBy("conv").agg(F.max("position").alias("p"), F.count_distinct("position").alias("n")).collect()
    assert all(r["p"] + 1 == r["n"] for r in parts)


def test_trie_of_little(spark):
    assert prefix_trie.build(table(spark, [])).count() == 0
    for rows in ([(7, 0, "user", "a b")], [(20, None, None, None)], [(1, 0, "u", "x"), (2, 0, "u", "x")]):
        same(prefix_trie.build(table(spark, rows)), rows)


def test_queue_spills():
    random.seed(1)
    queue, want = prefix_trie.SpillingQueue(limit=8, read=3), {}
    for _ in range(400):
        key = (random.randrange(-5, 0), random.randrange(4), random.randrange(3))
        queue.push((*key, 1, 10))
        want[key] = want.get(key, 0) + 1
    assert queue.spills > 10
    assert all(queue.take(key) == (n, 10 * n) for key, n in sorted(want.items())) and not queue.heap and not queue.runs
    assert queue.take((0, 0, 0)) == (0, 0)
