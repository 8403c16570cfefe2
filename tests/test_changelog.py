import json

import pytest
from pyspark.sql import types as T

from tidemill.operators import changelog as C
from tidemill.operators import merge
from tidemill.sources import versions

TARGET = T.StructType(
    [
        T.StructField("campaign_id", T.StringType(), False),
        T.StructField("campaign_name", T.StringType()),
        T.StructField("campaign_budget", T.DecimalType(14, 4)),
        T.StructField("start_date", T.DateType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def payload(key, name, budget="10.0000"):
    return json.dumps({"campaign_id": key, "campaign_name": name, "campaign_budget": budget, "start_date": 20468, "updated_at": 1768435200000})


def event(op, key, lsn, offset, name="n", before=None):
    return (
        op, "public", "campaigns", None if op == "t" else 1768435200000 + offset, lsn, None, json.dumps({"campaign_id": key}),
        payload(key, before or name) if op == "d" else None, payload(key, name) if op in "cur" else None, "cdc.public.campaigns", 0, offset, 1768435200000 + offset,
    )


@pytest.fixture
def log(spark):
    return lambda *rows: spark.createDataFrame(list(rows), C.CHANGE_SCHEMA)


def by_key(df):
    return {r.campaign_id: r for r in df.collect()}


def test_newest_position_wins_whatever_the_arrival_order(log):
    got = by_key(C.collapse_changes(log(event("u", "a", 30, 1, "new"), event("u", "a", 20, 2, "old")), "campaign_id", TARGET))
    assert got["a"].campaign_name == "new" and got["a"]._lsn == 30


def test_offset_breaks_ties_and_nulls_come_last(log):
    got = by_key(C.collapse_changes(log(event("u", "a", 5, 1, "x"), event("u", "a", 5, 2, "y"), event("u", "a", None, 9, "z")), "campaign_id", TARGET))
    assert got["a"].campaign_name == "y"


def test_delete_keeps_values_and_tombstone_is_ignored(log):
    got = by_key(C.collapse_changes(log(event("c", "a", 1, 1), event("d", "a", 2, 2, before="last"), event("t", "a", None, 3)), "campaign_id", TARGET))
    assert got["a"].is_deleted and got["a"].deleted_at is not None and got["a"].campaign_name == "last"
    assert C.collapse_changes(log(event("t", "b", None, 1)), "campaign_id", TARGET).count() == 0


def test_reinsert_clears_the_flag(log):
    got = by_key(C.collapse_changes(log(event("d", "a", 2, 2), event("c", "a", 3, 3, "again")), "campaign_id", TARGET))
    assert not got["a"].is_deleted and got["a"].deleted_at is None


def test_types_are_restored(log):
    row = by_key(C.collapse_changes(log(event("c", "a", 1, 1)), "campaign_id", TARGET))["a"]
    assert str(row.campaign_budget) == "10.0000" and row.start_date.isoformat() == "2026-01-15"


def test_reconcile_keeps_untouched_rows_and_boundary(spark, log):
    snapshot = spark.createDataFrame([("a", "snap", None, None, None), ("b", "snap", None, None, None)], TARGET)
    events = log(event("u", "a", 5, 1, "below"), event("u", "b", 11, 2, "above"), event("c", "z", 12, 3, "insert"))
    got = by_key(C.reconcile_table(snapshot, events, "campaign_id", 10))
    assert (got["a"].campaign_name, got["b"].campaign_name, got["z"].campaign_name) == ("snap", "above", "insert")
    assert got["a"]._lsn is None and got["a"]._op is None
    assert C.reconcile_table(snapshot, None, "campaign_id").count() == 2


def test_merge_inserts_unseen_deletes_flagged_and_is_idempotent(log):
    target = C.collapse_changes(log(event("c", "a", 1, 1)), "campaign_id", TARGET)
    changes = C.collapse_changes(log(event("u", "a", 2, 2, "two"), event("d", "q", 3, 3)), "campaign_id", TARGET)
    once = merge.merge_upsert(target, changes, "campaign_id")
    twice = merge.merge_upsert(once, changes, "campaign_id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    got = by_key(once)
    assert got["a"].campaign_name == "two" and got["q"].is_deleted
    report = merge.merge_report(target, changes, "campaign_id").first()
    assert (report.merged, report.inserted, report.updated, report.deleted, report.rows_after) == (2, 1, 1, 0, 2)


def test_compaction_keeps_recent_records(log):
    rows = [event("u", "a", n, n) for n in range(1, 6)]
    kept = C.compact_log(log(*rows), 1768435200000 + 4)
    assert sorted(r.kafka_offset for r in kept.collect()) == [3, 4, 5]


def test_bookmarks_and_status(spark, log):
    events = log(*[event("u", "a", n, n) for n in range(1, 6)])
    marks = C.offset_bookmarks(events.where("kafka_offset <= 3"))
    assert sorted(r.kafka_offset for r in C.pending(events, marks).collect()) == [4, 5]
    tables = spark.createDataFrame([("campaigns", 3), ("others", None)], "source_table string, applied_lsn long")
    got = {r.source_table: (r.mode, r.pending_events) for r in C.refresh_status(events, marks, tables).collect()}
    assert got == {"campaigns": ("incremental", 2), "others": ("bootstrap", 0)}


def test_publish_and_time_travel(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    versions.publish(spark.range(3).toDF("k"), root, note={"lsn": 1})
    versions.publish(spark.range(5).toDF("k"), root)
    assert versions.read_version(spark, root).count() == 5 and versions.read_version(spark, root, 1).count() == 3
    assert [r.n_rows for r in versions.versions(spark, root).orderBy("number").collect()] == [3, 5]
    with pytest.raises(ValueError):
        versions.read_version(spark, root, 9)


def test_partition_overwrite_and_floor(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    days = spark.createDataFrame([(1, 10), (2, 20)], "date_key int, v int")
    merge.overwrite_days(days, path)
    merge.overwrite_days(spark.createDataFrame([(2, 99)], "date_key int, v int"), path)
    assert sorted((r.date_key, r.v) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 99)]
    keep, merged = merge.merge_partitions(days, spark.createDataFrame([(2, 7)], "date_key int, v int"), "date_key", "date_key", 2)
    assert [tuple(r) for r in keep.collect()] == [(1, 10)] and [tuple(r) for r in merged.collect()] == [(2, 7)]


def test_pending_reaches_the_files(spark, tmp_path):
    rows = [("t", p, o) for p in range(3) for o in range(50)]
    log = spark.createDataFrame(rows, "kafka_topic string, kafka_partition int, kafka_offset long")
    log.write.parquet(f"{tmp_path}/log")
    marks = spark.createDataFrame([("t", 0, 40), ("t", 1, 100)], "kafka_topic string, kafka_partition int, seen_offset long")
    left = C.pending(spark.read.parquet(f"{tmp_path}/log"), marks)
    assert left.groupBy("kafka_partition").count().collect() and {(r[0], r[1]) for r in left.groupBy("kafka_partition").count().collect()} == {(0, 9), (2, 50)}
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(kafka_offset,40)" in plan.split("PushedFilters", 1)[1]
    many = marks.unionByName(spark.range(300).selectExpr("'u' as kafka_topic", "cast(id as int) as kafka_partition", "1L as seen_offset"))
    assert C.pending(log, many).count() == left.count()
    assert C.pending(log, marks.limit(0)).count() == log.count()


def test_compaction_keeps_young_tombstones(spark):
    rows = [("a", "c", 10, 1), ("a", "t", None, 2), ("b", "c", 10, 3), ("b", "t", None, 4), ("c", "c", 95, 5)]
    log = spark.createDataFrame(rows, "key string, op string, event_ts_ms long, kafka_offset long").selectExpr(
        "*", "'x' as source_table", "case when key = 'a' then 20L else 60L end as ingested_at_ms"
    )
    kept = {(r.key, r.op) for r in C.compact_log(log, 90, 50).collect()}
    assert kept == {("b", "t"), ("c", "c")}
    assert len(C.compact_log(log, 90).collect()) == 3
