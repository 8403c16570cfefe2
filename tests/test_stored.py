import datetime
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators import merge, stored
from tidemill.plans import catalog
from tidemill.sources import versions

SCHEMA = "k long, day date, v string, at timestamp"


def day(n):
    return None if n is None else datetime.date(2024, 1, n)


def rows(spark, *given):
    made = [(k, day(n), v, None if n is None else datetime.datetime(2024, 1, n, h)) for k, n, v, h in given]
    return spark.createDataFrame(made, SCHEMA)


def held(spark, path, like):
    return sorted((r.k, r.day.day if r.day else None, r.v) for r in stored.read_stored(spark, path, like).collect())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


BASE = [(1, 1, "a", 0), (2, 1, "b", 0), (3, 2, "c", 0), (4, None, "d", 0), (5, 3, "e", 0)]


def test_merge_keeps_every_row(spark, path):
    base = rows(spark, *BASE)
    assert stored.merge_stored(base, path, "k", "day").inserted == 5
    first = held(spark, path, base)
    nothing = stored.merge_stored(base.where("false"), path, "k", "day", floor=None)
    assert nothing == stored.Merged() and held(spark, path, base) == first
    batch = rows(spark, (3, 2, "C", 1), (4, None, "D", 1), (6, None, "f", 1), (7, 9, "g", 1))
    for want in ((2, 2), (0, 4)):  # a rerun inserts nothing
        done = stored.merge_stored(batch, path, "k", "day", floor=day(2))
        assert (done.inserted, done.updated) == want
        assert held(spark, path, base) == [(1, 1, "a"), (2, 1, "b"), (3, 2, "C"), (4, None, "D"), (5, 3, "e"), (6, None, "f"), (7, 9, "g")]


def test_rows_move_between_partitions(spark, path):
    base = rows(spark, *BASE)
    stored.merge_stored(base, path, "k", "day")
    done = stored.merge_stored(rows(spark, (3, 1, "moved", 1), (4, 3, "dated", 1), (5, None, "undated", 1)), path, "k", "day")
    assert (done.inserted, done.updated) == (0, 3)
    assert held(spark, path, base) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "moved"), (4, 3, "dated"), (5, None, "undated")]
    assert sorted({r[0] for r in spark.read.schema(base.schema).parquet(path).select("day").collect()}, key=str) == [day(1), day(3), None]


def test_ties_and_repeats_in_a_batch(spark, path):
    base = rows(spark, *BASE)
    stored.merge_stored(base, path, "k", "day")
    batch = rows(spark, (1, 1, "old", 1), (1, 1, "new", 5), (1, 1, "new", 5), (2, 1, "y", 1), (2, 1, "x", 1))
    assert stored.merge_stored(batch, path, "k", "day", order=("at",)).merged == 2
    assert held(spark, path, base)[:2] == [(1, 1, "new"), (2, 1, "y")]
    with pytest.raises(ValueError):
        stored.merge_stored(rows(spark, (None, 1, "x", 0)), path, "k", "day")


def test_only_touched_partitions_are_read(spark, path):
    base = rows(spark, *BASE)
    stored.merge_stored(base, path, "k", "day")
    target = stored.read_stored(spark, path, base)
    plan = lambda df: re.search(r"PartitionFilters: \[(.*?)\], ", df._jdf.queryExecution().executedPlan().toString())[1]
    assert "IN" in plan(stored.rows_of(target, "day", [day(1), day(2)])) and "isnull" in plan(stored.rows_of(target, "day", [None]))
    assert stored.rows_of(target, "day", [day(1), None]).count() == 3
    assert "2024" in plan(target.where(stored.from_floor("day", day(2))).select("k", "day")) or "19724" in plan(target.where(stored.from_floor("day", day(2))))
    done = stored.merge_stored(rows(spark, (5, 3, "E", 1)), path, "k", "day", floor=day(3))
    assert (done.rows_read, done.partitions) == (1, 1)


def test_increments_by_the_newest_time(spark, path):
    early = rows(spark, (1, 1, "a", 0), (2, 2, "b", 6), (3, None, "no time", 0))
    later = early.unionByName(rows(spark, (4, 2, "tie", 6), (5, 4, "new", 1), (6, 1, "too late", 1)))
    assert stored.load_increment(early, path, "k", "at", "day").inserted == 3
    for want in (2, 0):
        assert stored.load_increment(later, path, "k", "at", "day").inserted == want
    assert [k for k, _, _ in held(spark, path, early)] == [1, 2, 3, 4, 5]


def test_split_merge_loses_nothing(spark):
    target = rows(spark, *BASE)
    for changes, floor in ((rows(spark, (3, 2, "C", 1), (4, None, "D", 1)), day(2)), (target.where("false"), None)):
        untouched, merged = merge.merge_partitions(target, changes, "k", "day", floor)
        assert untouched.count() + merged.count() == 5


def test_report_scans_the_target_once(spark):
    target = rows(spark, *BASE)
    changes = rows(spark, (1, 1, "A", 1), (2, 1, "gone", 1), (9, 1, "n", 1)).withColumn("is_deleted", F.col("v") == "gone")
    got = merge.merge_report(target, changes, "k").first()
    assert tuple(got) == (3, 1, 1, 1, 5, 6)
    merged, _ = stored.observed_merge(target.withColumn("is_deleted", F.lit(False)), changes, "k", "is_deleted")
    assert merged._jdf.queryExecution().analyzed().toString().count("CollectMetrics") == 1
    assert merged.count() == 6


def test_a_reader_keeps_its_version_and_one_of_two_writers_loses(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    assert versions.newest(spark, root) == 0 and versions.versions(spark, root) is None
    assert versions.publish(spark.range(3).toDF("k"), root) == 1
    reader = versions.read_version(spark, root)
    start = versions.newest(spark, root)
    assert versions.publish(spark.range(7).toDF("k"), root, based_on=start) == 2
    assert reader.count() == 3 and versions.read_version(spark, root).count() == 7
    with pytest.raises(versions.Conflict):
        versions.publish(spark.range(9).toDF("k"), root, based_on=start)
    assert versions.read_version(spark, root).count() == 7
    assert len(list((tmp_path / "v" / "data").iterdir())) == 2  # the loser's files are gone
    assert versions.publish(spark.range(4).toDF("k"), root, note={"x": 1}) == 3
    assert versions.manifest(spark, root)["note"] == {"x": 1} and versions.manifest(spark, root, 8) is None
    assert versions.expire(spark, root, keep=2) == 1 and versions.newest(spark, root) == 3
    assert sorted(r.number for r in versions.versions(spark, root).collect()) == [2, 3]


def test_the_runs_of_an_increment_read_rows_that_were_derived_once(spark, sf_dir, monkeypatch):
    said = []
    load = stored.load_increment

    def seen(source, *more):
        said.append(source._jdf.queryExecution().optimizedPlan().toString())
        return load(source, *more)

    monkeypatch.setattr(stored, "load_increment", seen)
    catalog.QUERIES["fact_increment"](spark, sf_dir)
    assert len(said) == 3 and not any("row_number" in plan for plan in said)
