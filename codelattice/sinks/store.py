"""Stored graphs: upserts, replace-by-file, metadata and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.model import CodeGraph
from codelattice.session import stage
from codelattice.sinks.versions import VersionedTables

KEPT_ON_UPSERT = ("signature", "community_id")


def upsert_nodes(stored: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Incoming rows replace stored ones of the same qualified name; the last arrival wins.

    Derived columns a parser does not produce survive the replacement.
    """
    rest = [c for c in incoming.columns if c not in ("qualified_name", order)]
    new = incoming.groupBy("qualified_name").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_new"))
    joined = stored.join(new, "qualified_name", "full")
    given = F.col("_new").isNotNull()
    return joined.select(*[
        F.when(given, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in rest and c not in KEPT_ON_UPSERT else F.col(c)
        for c in stored.columns
    ])


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges are a set on (kind, source, target, file, line)."""
    return stored.select(*S.EDGE_KEY).unionByName(incoming.select(*S.EDGE_KEY)).distinct()


def replace_files(g: CodeGraph, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> CodeGraph:
    """All rows of the given files replaced by new ones; no new rows means deletion."""
    gone = files.select("file_path").distinct()
    fresh = nodes.groupBy("qualified_name").agg(
        F.max_by(F.struct(*[c for c in nodes.columns if c != "qualified_name"]), F.col("line_start")).alias("_r")
    ).select("qualified_name", "_r.*").select(*nodes.columns)
    kept = g.nodes.join(gone, "file_path", "left_anti")
    return CodeGraph(
        kept.unionByName(fresh, allowMissingColumns=True),
        g.edges.join(gone, "file_path", "left_anti").select(*S.EDGE_KEY).unionByName(edges.select(*S.EDGE_KEY).distinct()),
    )


def write_graph(g: CodeGraph, path: str, buckets: int | None = None, hashes: DataFrame | None = None) -> int:
    """A new version of the stored graph: nodes, edges and, where given, the hash of every file."""
    tables = {"nodes": g.nodes, "edges": g.edges.select(*S.EDGE_KEY)}
    if hashes is not None:
        tables["files"] = hashes.select("file_path", "file_hash")
    return VersionedTables(g.spark, path).replace_all(tables, buckets=buckets)


def read_graph(spark: SparkSession, path: str, version: int | None = None) -> CodeGraph:
    stored = VersionedTables(spark, path)
    about = stored.manifest(version)
    if not about["tables"]:
        raise FileNotFoundError(f"no graph at {path}")
    return CodeGraph(*[stored.read(name, manifest=about).drop("bucket") for name in ("nodes", "edges")])


def stored_hashes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file_path, file_hash) as of a version."""
    return VersionedTables(spark, path).read("files", version).drop("bucket")


def _one_row(name: str, rows: DataFrame) -> DataFrame:
    """A name is one node (its last definition), an edge is one row, a file has one hash."""
    if name != "nodes":
        return rows.distinct()
    keep = [c for c in rows.columns if c != "qualified_name"]
    return rows.groupBy("qualified_name").agg(F.max_by(F.struct(*keep), F.col("line_start")).alias("_r")).select("qualified_name", "_r.*").select(*rows.columns)


def replace_files_at(
    spark: SparkSession, path: str, files: DataFrame, nodes: DataFrame, edges: DataFrame,
    hashes: DataFrame | None = None, batch: tuple[str, int] | None = None,
) -> int:
    """All rows of the given files replaced in one commit; returns the version that holds them.

    Readers see the old or the new graph, never one table of each. A batch (stream name, id) that was
    committed before changes nothing.
    """
    stored = VersionedTables(spark, path)
    if stored.seen(batch):
        return stored.manifest()["version"]
    # Staged: each input is read twice, and may itself be read from this graph.
    fresh = {"nodes": stage(nodes, "fresh_nodes"), "edges": stage(edges.select(*S.EDGE_KEY), "fresh_edges")}
    if hashes is not None:
        fresh["files"] = stage(hashes.select("file_path", "file_hash"), "fresh_hashes")
    return stored.replace_files(stage(files.select("file_path").distinct(), "replaced_files"), fresh, _one_row, batch=batch)


def save_metadata(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Key-value rows; a later value of a key replaces the earlier one."""
    known = load_metadata(spark, path, missing_ok=True)
    rows = list({**known, **values}.items())
    ready = spark.createDataFrame(rows, "key string, value string").coalesce(1)
    ready.write.mode("overwrite").json(f"{path}/metadata")


def load_metadata(spark: SparkSession, path: str, missing_ok: bool = False) -> dict[str, str]:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        if missing_ok:
            return {}
        raise FileNotFoundError(f"{path}/metadata")
    rows = spark.read.schema("key string, value string").json(f"{path}/metadata").collect()
    return {r["key"]: r["value"] for r in rows}


def upgrade(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Older layouts gain the missing columns as NULL; a second run changes nothing."""
    missing = [F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns]
    return df.select("*", *missing) if missing else df


def assign_communities(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with their community; the later community wins on overlap."""
    one = members.groupBy("qualified_name").agg(F.max("community_id").alias("community_id"))
    return nodes.drop("community_id").join(one, "qualified_name", "left")


PATH_CHUNK = 10_000


def flow_paths(positioned: DataFrame) -> DataFrame:
    """Path column of flows: node names in discovery order.

    A path longer than a chunk goes on in further rows, so no row and no task
    holds more than one chunk of a flow.
    """
    chunk = F.floor(F.col("position") / PATH_CHUNK).cast("bigint")
    return positioned.groupBy("root", chunk.alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "node"))), lambda x: x["node"]).alias("path")
    )
