"""Staged tables and their removal."""

import os

import pytest

from codelattice.session import Levels, drop_table, stage, stage_bucketed, stage_root


def test_stage_and_levels(spark):
    df = spark.range(10).selectExpr("id", "cast(id % 3 AS string) AS k")
    assert stage(df, "t", ("k",)).where("k = '1'").count() == 3
    levels = Levels(spark, "l")
    levels.add(df)
    assert levels.last_rows == 10
    levels.add(df.limit(0))
    assert levels.last_rows == 0 and levels.all().count() == 10
    table, name = stage_bucketed(df, "b", "k")
    plan = table.join(table.groupBy("k").count(), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0
    drop_table(spark, name)
    assert os.path.isdir(stage_root(spark).removeprefix("file:"))


def test_cluster_needs_a_shared_folder(monkeypatch):
    from codelattice import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
