import json

import pytest

from tidemill.operators import changelog, refresh
from tidemill.sources import offsets, versions

LOG = "op string, source_table string, event_ts_ms long, lsn long, key string, before_json string, after_json string, kafka_partition int, kafka_offset long, ingested_at_ms long"


def event(user, name, lsn, op="u", table="users", partition=0):
    body = json.dumps({"user_id": user, "name": name})
    return (op, table, 1704067200000, lsn, json.dumps({"user_id": user}), body if op == "d" else None, None if op == "d" else body, partition, lsn, 0)


def land(spark, path, *rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").partitionBy("source_table").parquet(path)


def users(spark, *rows):
    return spark.createDataFrame(rows, "user_id long, name string")


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}"


def chosen(zones, marks, table="users"):
    return sorted((r.n_rows, r.straddles) for r in offsets.files_after(zones.where(f"source_table = '{table}'"), marks).collect())


def test_bookmarks_choose_files(spark, place):
    log, root = f"{place}/log", f"{place}/zones"
    land(spark, log, *[event(k, "a", k) for k in range(1, 11)])
    land(spark, log, *[event(k, "b", k) for k in range(11, 14)], *[event(k, "b", k, partition=1) for k in range(1, 3)])
    land(spark, log, event(1, "other", 1, table="orders"))
    zones = offsets.update_map(spark, log, root)
    assert versions.newest(spark, root) == 1 and offsets.update_map(spark, log, root).count() == zones.count() == 4
    assert versions.newest(spark, root) == 1  # nothing new, nothing written
    assert chosen(zones, {}) == [(5, False), (10, False)]
    assert chosen(zones, {0: 10}) == [(5, False)]  # the first file was read whole
    assert chosen(zones, {0: 12, 1: 2}) == [(5, True)]  # one straddles its bookmark and is read again
    assert chosen(zones, {0: 13}) == [(5, True)]  # each source partition has its own
    assert chosen(zones, {0: 13, 1: 2}) == []
    assert offsets.bookmarks_after(zones.where("source_table = 'users'"), {0: 3, 7: 9}) == {0: 13, 1: 2, 7: 9}
    land(spark, log, event(99, "late", 4), event(99, "late", 14))  # of an old day, with old and new offsets
    zones = offsets.update_map(spark, log, root)
    assert chosen(zones, {0: 13, 1: 2}) == [(2, True)]


def test_a_compacted_log_gets_a_new_map(spark, place):
    log, root = f"{place}/log", f"{place}/zones"
    for k in range(3):
        land(spark, log, event(k, "a", k))
    assert offsets.update_map(spark, log, root).count() == 3
    offsets.read_files(spark, log, spark.read.parquet(log).inputFiles()).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_table").parquet(log)
    zones = offsets.update_map(spark, log, root)
    assert [(r.first_offset, r.last_offset, r.n_rows) for r in zones.collect()] == [(0, 2, 3)]


@pytest.mark.parametrize("raw", [None, "", "{broken", "[1]", '{"a":"b"}', "7"])
def test_an_unreadable_bookmark_reads_everything(raw):
    assert offsets.decode_bookmarks(raw) == {}


def test_bookmarks_survive_being_written():
    assert offsets.decode_bookmarks(offsets.encode_bookmarks({3: 9, 0: 12})) == {0: 12, 3: 9}


def rows_of(spark, root):
    return {(r.user_id, r.name, r.is_deleted) for r in versions.read_version(spark, f"{root}/users").collect()}


def test_increments_equal_a_rebuild_and_reruns_skip(spark, place):
    log, root = f"{place}/log", f"{place}/tables"
    base = users(spark, (1, "a"), (2, "b"), (3, "c"))
    own = lambda run="r1", position=10, rows=base: [refresh.Export("users", "user_id", rows, run, position)]
    run = lambda exports, **more: refresh.refresh(spark, root, exports, log, **more).first()
    land(spark, log, event(1, "before the export", 9), event(1, "A", 11))
    first = run(own())
    assert (first.mode, first.n_rows, first.version) == ("bootstrap", 3, 1)
    land(spark, log, event(2, "gone", 12, "d"), event(4, "new", 13), event(4, "newer", 14), event(1, "late and old", 8))
    second = run(own())
    assert (second.mode, second.merged, second.inserted, second.updated, second.deleted, second.n_rows) == ("incremental", 2, 1, 0, 1, 4)
    want = {(1, "A", False), (2, "gone", True), (3, "c", False), (4, "newer", False)}
    assert rows_of(spark, root) == want
    third = run(own())
    assert (third.mode, third.version, third.n_rows) == ("skip", 2, 4)
    # Lost bookmarks open every file again; positions keep what was applied from being applied twice.
    versions.publish(versions.read_version(spark, f"{root}/users"), f"{root}/users", note={"run_id": "r1", "offsets": "{broken"})
    again = run(own())
    assert (again.mode, again.files, again.merged) == ("incremental", 2, 0) and rows_of(spark, root) == want
    assert run(own(), forced=("users",)).mode == "rebuild" and rows_of(spark, root) == want
    moved = run(own("r2", 12, users(spark, (1, "A"), (3, "c"))))
    assert (moved.mode, moved.reason) == ("rebuild", "snapshot export changed: r1 -> r2")
    assert rows_of(spark, root) == {(1, "A", False), (3, "c", False), (4, "newer", False)}


def test_append_only_tables_follow_their_export(spark, place):
    log, root = f"{place}/log", f"{place}/tables"
    land(spark, log, event(1, "x", 1, table="other"))
    export = lambda run, rows: [refresh.Export("users", "user_id", rows, run, 0, append_only=True)]
    modes = [refresh.refresh(spark, root, export(*x), log).first().mode for x in (("r1", users(spark, (1, "a"))), ("r1", users(spark, (1, "a"))), ("r2", users(spark, (1, "a"), (2, "b"))))]
    assert modes == ["bootstrap", "skip", "rebuild"] and len(rows_of(spark, root)) == 2


def test_an_operation_without_a_name_is_not_dropped(spark):
    log = spark.createDataFrame([event(1, "x", 1, op=None)], LOG)
    assert changelog.collapse_changes(log, "user_id", users(spark, (1, "a")).schema).count() == 1
