"""Values that flow from sources into the arguments of sinks, by joins over extracted links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.operators.rules import contains_join
from codelattice.operators.traversal import reach
from codelattice.session import stage

NO_LIMIT = 2**31 - 1


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\.|::"), -1)


def call_arguments(flows: DataFrame) -> DataFrame:
    """One row per argument of a call, with its shape."""
    return flows.where(F.col("rec") == "arg").select(
        "func", "line", F.col("name").alias("callee"), "position", "keyword", "shape", "concatenated", "parameterised")


def _functions_by_name(flows: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` (id, callee, file_path) with the function called: of the same file, else the only one of that name."""
    short = last_part(F.col("func"))
    functions = flows.where(F.col("rec").isin("def", "return")).select("func", "file_path", short.alias("short")).distinct()
    one = lambda keys: functions.groupBy(*keys).agg(
        F.min("func").alias("func"), F.count("*").alias("n")).where("n = 1").drop("n")
    asked = named.withColumn("short", last_part(F.col("callee")))
    here = one(["file_path", "short"]).withColumnRenamed("func", "near")
    return asked.join(here, ["file_path", "short"], "left").join(one(["short"]), "short", "left").select(
        "id", F.coalesce("near", "func").alias("func")).where(F.col("func").isNotNull())


def flow_links(flows: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Rows (source, target) of ids: reads of definitions, arguments to parameters, returns to their calls.

    A value that goes through a call with a sanitizer's pattern (``pattern``) is not passed on.
    """
    reads = flows.where(F.col("rec").isin("link", "origin"))
    names = reads.select(F.explode("through").alias("call")).distinct()
    clean = contains_join(names, "call", sanitizers, "pattern").select("call").distinct()
    wrapped = reads.withColumn("call", F.explode("through")).join(clean, "call", "left_semi").select(
        "rec", "id", "name", "through").distinct()
    free = stage(reads.join(wrapped, ["rec", "id", "name", "through"], "left_anti"), "free_reads")
    own = free.where("rec = 'link'").select(F.col("name").alias("source"), F.col("id").alias("target"))
    given = flows.where("rec = 'arg'").select("id", F.col("name").alias("callee"), "file_path", "position", "keyword")
    called = _functions_by_name(flows, given.select("id", "callee", "file_path")).join(
        given.select("id", "position", "keyword"), "id")
    parameters = flows.where("rec = 'def' AND shape = 'parameter'").select(
        "func", F.col("id").alias("target"), F.col("position").alias("at"), F.col("keyword").alias("word"))
    passed = called.join(parameters, "func").where(
        (F.col("position") == F.col("at")) | (F.col("keyword") == F.col("word"))
    ).select(F.col("id").alias("source"), "target")
    asked = free.where("rec = 'origin'").select("id", F.col("name").alias("callee"), "file_path")
    results = flows.where("rec = 'return'").select("func", F.col("id").alias("source"))
    returned = _functions_by_name(flows, asked).join(results, "func").select("source", F.col("id").alias("target"))
    return own.unionByName(passed).unionByName(returned).distinct()


def argument_taint(flows: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame) -> DataFrame:
    """Arguments of sinks that a source's value reaches (patterns in ``pattern``).

    Parameter lists of parameterised calls are harmless. ``hops`` counts the
    links from the first definition or argument that holds the value;
    ``concatenated`` says that the value was put into a text on the way.
    """
    flows = stage(flows, "value_flow")
    links = stage(flow_links(flows, sanitizers), "flow_links")
    names = flows.where("rec IN ('arg', 'origin')").select("name").distinct()
    match = lambda p: contains_join(names, "name", p, "pattern").select("name").distinct()
    clean = contains_join(
        flows.select(F.explode("through").alias("call")).distinct(), "call", sanitizers, "pattern").select("call").distinct()
    origins = flows.where("rec = 'origin'").join(match(sources), "name", "left_semi")
    shut = origins.withColumn("call", F.explode("through")).join(clean, "call", "left_semi").select("id", "name", "through").distinct()
    seeds = origins.join(shut, ["id", "name", "through"], "left_anti").select(F.col("id").alias("qualified_name"))
    held = stage(reach(seeds, links, NO_LIMIT), "held")
    put = flows.where("concatenated").select(F.col("id").alias("qualified_name")).join(held, "qualified_name", "left_semi")
    built = reach(put, links, NO_LIMIT).select(F.col("qualified_name").alias("id"), F.lit(True).alias("built"))
    return (
        flows.where("rec = 'arg' AND NOT parameterised").join(match(sinks), "name", "left_semi")
        .join(held.select(F.col("qualified_name").alias("id"), F.col("depth").alias("hops")), "id")
        .join(built, "id", "left")
        .select("func", "line", F.col("name").alias("callee"), "position", "keyword", "shape",
                F.coalesce("built", F.lit(False)).alias("concatenated"), "hops")
    )
