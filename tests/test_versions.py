"""Versioned tables: one commit for all tables, old versions, replayed batches, growth."""

import pytest

from codelattice.sinks.versions import VersionConflict, VersionedTables


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "file_path string, value long")


def content(df):
    return sorted((r["file_path"], r["value"]) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "store"))
    base = [(f"f{i}", i) for i in range(12)]
    tables.replace_all({"left": rows(spark, base), "right": rows(spark, base)}, buckets=4)
    return tables


def test_versions_and_readers(spark, store):
    old = store.read("left")
    files = spark.createDataFrame([("f1",), ("f2",), ("new",)], "file_path string")
    fresh = rows(spark, [("f1", 100), ("new", 5)])
    assert store.replace_files(files, {"left": fresh, "right": fresh}) == 2
    want = sorted([(f"f{i}", i) for i in range(12) if i not in (1, 2)] + [("f1", 100), ("new", 5)])
    assert content(store.read("left")) == content(store.read("right")) == want
    before = sorted((f"f{i}", i) for i in range(12))
    assert content(old) == content(store.read("left", 1)) == before  # a reader that was open, and the old version
    assert store.replace_files(files.limit(0), {"left": fresh}) == 2
    assert store.compact(2) == 3 and content(store.read("left")) == want and content(store.read("right", 2)) == want
    store.drop_before(3)
    assert store.versions() == [3] and content(store.read("right")) == want


def test_failure_between_tables_leaves_the_old_version(spark, store, monkeypatch):
    files, fresh = spark.createDataFrame([("f1",)], "file_path string"), rows(spark, [("f1", 7)])
    write = VersionedTables._write

    def fail(self, name, *rest):
        if name == "right":
            raise OSError("lost")
        return write(self, name, *rest)

    monkeypatch.setattr(VersionedTables, "_write", fail)
    with pytest.raises(OSError):
        store.replace_files(files, {"left": fresh, "right": fresh})
    before = sorted((f"f{i}", i) for i in range(12))
    assert store.versions() == [1] and content(store.read("left")) == content(store.read("right")) == before
    monkeypatch.setattr(VersionedTables, "_write", write)
    assert store.replace_files(files, {"left": fresh, "right": fresh}) == 2
    assert ("f1", 7) in content(store.read("left")) and ("f1", 7) in content(store.read("right"))


def test_second_writer_is_refused(spark, store, monkeypatch):
    files = spark.createDataFrame([("f1",)], "file_path string")
    stale = store.manifest()
    store.replace_files(files, {"left": rows(spark, [("f1", 7)])})
    other = VersionedTables(spark, store.path)
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(VersionConflict):
        other.replace_files(files, {"left": rows(spark, [("f1", 8)])})
    assert ("f1", 7) in content(store.read("left"))


def test_replayed_batches_change_nothing(spark, store):
    files = spark.createDataFrame([("f1",)], "file_path string")
    put = lambda value, batch: store.replace_files(files, {"left": rows(spark, [("f1", value)])}, batch=batch)
    assert [put(7, ("s", 0)), put(8, ("s", 0)), put(9, ("s", 1)), put(1, ("s", 0)), put(2, ("t", 0))] == [2, 2, 3, 3, 4]
    assert ("f1", 2) in content(store.read("left")) and ("f1", 9) in content(store.read("left", 3))


def test_buckets_follow_the_bytes(spark, tmp_path):
    few, many = VersionedTables(spark, str(tmp_path / "a")), VersionedTables(spark, str(tmp_path / "b"))
    data = spark.range(4000).selectExpr("'f' || id % 500 as file_path", "id as value")
    few.replace_all({"t": data}, bucket_bytes=1 << 30)
    many.replace_all({"t": data}, bucket_bytes=4 << 10)
    assert few.manifest()["buckets"] == 1 and many.manifest()["buckets"] > 4
    grown = spark.range(40_000).selectExpr("'g' || id % 500 as file_path", "id as value")
    several = few.manifest()["buckets"]
    few.replace_files(grown.select("file_path"), {"t": grown}, bucket_bytes=16 << 10)
    assert few.manifest()["buckets"] == 2 * several and few.read("t").count() == 44_000
    assert many.read("t").where("bucket = 0").count() < 2000
