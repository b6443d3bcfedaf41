"""The commerce graph from numbered edges, and shuffle files that go with the write that made them."""

import glob

from pyspark.sql import functions as F

from codelattice import session
from codelattice.sources import commerce


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def graph(spark, folder):
    write(spark, folder, "part", [(1, "red bolt", "Brand#1", "PROMO", 5, 9.0), (1, "red bolt", "Brand#1", "PROMO", 5, 9.0), (2, "old ring", "Brand#2", "PROMO", 11, 9.0)],
          "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    write(spark, folder, "supplier", [(7, "S7"), (8, None)], "s_suppkey bigint, s_name string")
    lines = [
        (2, 1, 7, 1, 48.0, "R"), (2, 1, 7, 1, 48.0, "R"), (1, 2, 7, 2, 47.0, "R"), (1, 2, 8, 3, 47.0, "R"), (1, 2, None, 3, 47.0, "R"), (1, 9, 7, 3, 47.0, "R"),
        (1, 2, 7, 4, 46.0, "R"), (1, 2, 7, 5, 45.0, "R"), (1, 2, 7, 6, None, "N"), (1, 2, 7, 7, 2.0, None), (1, None, 7, 7, 3.0, "N"), (2, 2, 7, 1, 4.0, "N"),
    ]
    write(spark, folder, "lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string")
    return commerce.build_graph(spark, str(folder))


def test_numbered_edges(spark, tmp_path):
    """Equal rows of a part or a line make one edge; nothing leads to a name that is none."""
    one, two, at = "src/promo/m0.py::red_bolt_1", "src/promo/m0.py::test_old_ring_2", "src/promo/m0.py"
    got = sorted(map(tuple, graph(spark, tmp_path).edges.where("kind <> 'CONTAINS'").select("kind", "source", "target", "line").collect()))
    assert got == sorted([
        ("CALLS", two, one, 122), ("TESTED_BY", one, two, 122), ("CALLS", one, "S7", 63), ("CALLS", one, "test_old_ring_2", 65),
        ("IMPORTS_FROM", at, two, 67), ("IMPLEMENTS", one, "test_old_ring_2", 68),
    ])


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """The next job of this session finds the shuffle files of a stored table gone, not only when garbage is collected."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {x for d in folders for x in glob.glob(f"{d}/*/shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(key)
    kept = session.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not files() - before and spark.conf.get(key) == setting
    assert kept.count() == 7
