"""Versioned tables: immutable bucket files, one manifest per version, one rename as commit.

A table is cut into buckets by a hash of its file path. A write puts the new content of the buckets it
touches into a folder of its own; nothing that a reader may hold is changed. The version exists from the moment
its manifest gets its final name, in one rename that fails if the name is taken, so all tables change together,
a job that dies leaves the old version and an unread folder, and of two writers that started from one version the
second is refused. The manifest says for every table which folder holds which bucket, so a read is a plain
Parquet scan with partition filters, and a bucket is always whole in one folder.

A manifest also keeps the last batch id of every stream: a batch that was committed once is not applied
again. Buckets are as many as the bytes ask for, and double when the tables have grown; Spark's rebalancing
splits a bucket that one file makes large and joins small ones, so a bucket is no limit on task size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.session import dropping_shuffles, stage_root

BUCKET_BYTES = 64 << 20
EXTRA = T.StructType([T.StructField("ver", T.StringType()), T.StructField("bucket", T.IntegerType())])


class VersionConflict(RuntimeError):
    """Another writer committed the next version first."""


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class VersionedTables:
    """Tables below ``path``, each with a ``file_path`` column that decides its bucket.

    ``LEVELS`` names a column of a table that makes folders inside its buckets, and the order of rows in a file.
    """

    LEVELS: dict[str, tuple[str, str]] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    # --- files -----------------------------------------------------------------

    def _at(self, tail: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tail}" if tail else self.path)

    def bytes_in(self, tail: str) -> int:
        place = self._at(tail)
        return self._fs.getContentSummary(place).getLength() if self._fs.exists(place) else 0

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._at("manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; an empty one before the first commit."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": 0, "bytes": 0, "tables": {}, "batches": {}}
        stream = self._fs.open(self._at(f"manifests/{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        draft = self._at(f"manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, final = self.spark.sparkContext._jvm, self._at(f"manifests/{manifest['version']:012d}.json")
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, final, how)
        except Exception as problem:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise VersionConflict(f"version {manifest['version']} of {self.path} was committed by another writer") from problem
            raise

    # --- reading ---------------------------------------------------------------

    def read(self, name: str, version: int | None = None, manifest: dict | None = None) -> DataFrame:
        """One table of a version, with its ``bucket`` column (filters on it prune folders)."""
        about = (manifest or self.manifest(version))["tables"][name]
        schema = T.StructType.fromJson(about["schema"])
        moved: dict[str, list[int]] = {}
        for bucket, ver in about["moved"].items():
            moved.setdefault(ver, []).append(int(bucket))
        root = f"{self.path}/data/{name}"
        folders = [f"{root}/ver={v}" for v in [about["base"], *sorted(moved)]]
        stored = self.spark.read.schema(T.StructType([*schema.fields, *EXTRA.fields])).option("basePath", root).parquet(*folders)
        live = F.col("ver") == about["base"]
        if moved:
            live = live & ~F.col("bucket").isin([int(b) for b in about["moved"]])
        for ver, buckets in sorted(moved.items()):
            live = live | ((F.col("ver") == ver) & F.col("bucket").isin(buckets))
        return stored.where(live).drop("ver")

    # --- writing ---------------------------------------------------------------

    def seen(self, batch: tuple[str, int] | None, manifest: dict | None = None) -> bool:
        """True where this stream committed that batch, or a later one, before."""
        return batch is not None and (manifest or self.manifest())["batches"].get(batch[0], -1) >= batch[1]

    def _spread(self, name: str, placed: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of a table dealt to the tasks that write them."""
        return placed.hint("rebalance", *keys)

    def _write(self, name: str, rows: DataFrame, buckets: int) -> tuple[str, int]:
        tag = uuid.uuid4().hex[:16]
        placed = rows.drop("bucket").withColumn("bucket", bucket_of(F.col("file_path"), buckets))
        keys = ["bucket", *self.LEVELS.get(name, ())[:1]]
        placed = self._spread(name, placed, keys)
        if name in self.LEVELS:
            placed = placed.sortWithinPartitions(*keys, self.LEVELS[name][1])
        with dropping_shuffles(self.spark):
            placed.write.option("compression", "zstd").partitionBy(*keys).parquet(f"{self.path}/data/{name}/ver={tag}")
        return tag, self.bytes_in(f"data/{name}/ver={tag}")

    def replace_all(self, tables: dict[str, DataFrame], bucket_bytes: int = BUCKET_BYTES, buckets: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """A new version made of whole tables; buckets by bytes unless given."""
        before = self.manifest()
        if self.seen(batch, before):
            return before["version"]
        if buckets is None:
            # Staged first: the bytes on disk decide the number of buckets.
            held = VersionedTables(self.spark, f"{stage_root(self.spark)}/{uuid.uuid4().hex}")
            for name, rows in tables.items():
                with dropping_shuffles(self.spark):
                    rows.drop("bucket").write.parquet(f"{held.path}/{name}")
            tables = {name: self.spark.read.schema(rows.drop("bucket").schema).parquet(f"{held.path}/{name}") for name, rows in tables.items()}
            buckets = max(1, -(-held.bytes_in("") // bucket_bytes))
        after = {"version": before["version"] + 1, "buckets": buckets, "bytes": 0, "tables": {}, "batches": dict(before["batches"])}
        for name, rows in tables.items():
            tag, size = self._write(name, rows, buckets)
            after["tables"][name] = {"schema": rows.drop("bucket").schema.jsonValue(), "base": tag, "moved": {}}
            after["bytes"] += size
        self._settle(after, batch)
        return after["version"]

    def replace_files(self, files: DataFrame, fresh: dict[str, DataFrame], merge=None, bucket_bytes: int = BUCKET_BYTES, batch: tuple[str, int] | None = None) -> int:
        """A new version in which all rows of ``files`` (file_path) are those of ``fresh``; other files stay.

        Only buckets that hold one of the files are read and written. ``merge`` may work on a table's rows before
        they are written (name, rows). Inputs must not change while the job runs; staged ones do not.
        """
        before = self.manifest()
        if self.seen(batch, before):
            return before["version"]
        buckets = before["buckets"]
        gone = files.select("file_path").distinct().withColumn("bucket", bucket_of(F.col("file_path"), buckets))
        # At most one number per bucket reaches the driver; the manifest has as many entries.
        touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())
        if not touched:
            return before["version"]
        after = {**before, "version": before["version"] + 1, "tables": dict(before["tables"]), "batches": dict(before["batches"])}
        for name, rows in fresh.items():
            about = before["tables"][name]
            schema = T.StructType.fromJson(about["schema"])
            stored = self.read(name, manifest=before).where(F.col("bucket").isin(touched)).drop("bucket")
            known = [c for c in schema.names if c in rows.columns]
            kept = stored.join(gone.select("file_path"), "file_path", "left_anti").select(*schema.names).unionByName(rows.select(*known), allowMissingColumns=True)
            tag, size = self._write(name, merge(name, kept) if merge else kept, buckets)
            after["tables"][name] = {**about, "moved": {**about["moved"], **{str(b): tag for b in touched}}}
            after["bytes"] += size // 2  # about half replaces what was there
        self._settle(after, batch)
        if after["bytes"] > 2 * bucket_bytes * buckets:
            return self.compact(2 * buckets)
        return after["version"]

    def _settle(self, manifest: dict, batch: tuple[str, int] | None) -> None:
        if batch is not None:
            manifest["batches"][batch[0]] = batch[1]
        self._publish(manifest)

    # --- upkeep ----------------------------------------------------------------

    def compact(self, buckets: int | None = None) -> int:
        """The same rows in one folder per table, with as many buckets as asked for."""
        now = self.manifest()
        return self.replace_all({name: self.read(name, manifest=now) for name in now["tables"]}, buckets=buckets or now["buckets"])

    def drop_before(self, version: int) -> None:
        """Forget versions before ``version`` and delete folders that no kept version reads."""
        kept = [self.manifest(v) for v in self.versions() if v >= version]
        for old in self.versions():
            if old < version:
                self._fs.delete(self._at(f"manifests/{old:012d}.json"), False)
        for name in {n for m in kept for n in m["tables"]}:
            used = {tag for m in kept if name in m["tables"] for tag in (m["tables"][name]["base"], *m["tables"][name]["moved"].values())}
            for found in self._fs.listStatus(self._at(f"data/{name}")):
                if found.getPath().getName().removeprefix("ver=") not in used:
                    self._fs.delete(found.getPath(), True)
