"""Watch mode: file events keep a stored graph current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelattice.functions.paths import language_of
from codelattice.plans.pipelines import build_from_files
from codelattice.session import stage
from codelattice.sinks.search_index import refresh_graph_index
from codelattice.sinks.store import read_graph, replace_files_at
from codelattice.sinks.versions import VersionedTables

EVENTS = "file_path string, event string, ts timestamp, text string"
DEBOUNCE = "300 milliseconds"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """File events as JSON lines dropped into a folder by a notifier."""
    return spark.readStream.schema(EVENTS).json(folder)


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each path; earlier ones of the same batch are settled by it."""
    return events.groupBy("file_path").agg(
        F.max_by(F.struct("event", "text"), F.col("ts")).alias("last")
    ).select("file_path", "last.event", "last.text", language_of(F.col("file_path")).alias("language"))


def apply_events(spark: SparkSession, graph_path: str, events: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """One batch: changed files are read again, deleted ones removed, in one commit.

    A batch (stream name, id) that was committed before is skipped. Imports may lead to any stored file.
    """
    stored = VersionedTables(spark, graph_path)
    version = stored.manifest()["version"]
    if stored.seen(batch):
        return version
    last = stage(latest_events(events).where(F.col("language").isNotNull()), "file_events")
    if last.isEmpty():
        return version
    gone = (F.col("event") == "deleted") | F.col("text").isNull()
    files = read_graph(spark, graph_path).nodes_of("File").select("file_path").join(last.where(gone), "file_path", "left_anti")
    fresh = build_from_files(last.where(~gone).select("file_path", "text", "language"), files)
    nodes = stage(fresh.nodes, "event_nodes")
    # The index first: a batch that fails in between is replayed, and the index knows what it has seen.
    refresh_graph_index(spark, graph_path, last.select("file_path"), nodes, batch)
    return replace_files_at(spark, graph_path, last.select("file_path"), nodes, fresh.edges, batch=batch)


def watch(events: DataFrame, graph_path: str, checkpoint: str, once: bool = False, name: str = "watch") -> StreamingQuery:
    """Keep the graph at ``graph_path`` current; the trigger interval is the debounce.

    ``name`` is the stream's name in the store's ledger of batches; a new checkpoint needs a new name.
    """
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: apply_events(batch.sparkSession, graph_path, batch, (name, number)) and None
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
