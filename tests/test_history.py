import datetime
import random
import time

from pyspark.sql import functions as F

from tidemill.operators import dims, facts, history
from tidemill.plans import catalog, standins

DIM = dims.Dimension("x", "x_id", {"p_key": "p_id"}, ("name",), {})
CHECKED = ("name", "p_id", "is_deleted")
CAPTURE = "x_id string, p_id string, name string, is_deleted boolean, created_at timestamp, updated_at timestamp, deleted_at timestamp, captured_at timestamp"


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def captures(spark, *rows):
    return spark.createDataFrame(rows, CAPTURE)


def capture(member, day, name, updated=None, parent="p", deleted=None, created=0):
    return (member, parent, name, deleted is not None, at(created), at(day if updated is None else updated), None if deleted is None else at(deleted), at(day))


def shaped(versions):
    return sorted(map(str, history.shape_history(versions, DIM, CHECKED).collect()))


def grown(spark, days, log, **more):
    now = None
    for day in days:
        snapshot = log.where(F.col("captured_at") == F.lit(at(day)))
        for _ in range(2):  # the same snapshot again changes nothing
            now = history.grow_versions(now, snapshot, DIM, F.lit(at(day)), CHECKED, **more)
        now = spark.createDataFrame(now.collect(), now.schema)
    return now


def test_growth_equals_the_whole_log(spark):
    rng = random.Random(6)
    rows = []
    for member in range(12):
        for day in range(1, 7):
            if day < 1 + member % 3:
                continue  # members that come later
            rows.append(capture(f"m{member}", day, rng.choice("ab"), updated=rng.randrange(7), parent=rng.choice(["p", None]), deleted=5 if member == 4 and day >= 5 else None, created=rng.randrange(4)))
    log = captures(spark, *rows)
    assert shaped(grown(spark, range(1, 7), log)) == shaped(history.member_versions(log, DIM, CHECKED))


def test_absent_members_are_closed_and_come_back(spark):
    log = captures(spark, capture("a", 1, "x"), capture("b", 1, "x"), capture("b", 2, "x"), capture("a", 4, "x", updated=3), capture("b", 4, "y", updated=4))
    log = log.unionByName(captures(spark, capture("c", 3, "z")))
    rows = {(r.x_id, r.valid_from, r.valid_to.year if r.valid_to.year > 2024 else r.valid_to, r.is_current) for r in grown(spark, [1, 2, 3, 4], log).collect()}
    assert rows == {
        ("a", at(0), at(2), False), ("a", at(3), 9999, True),  # gone on day 2, back with an update of day 3
        ("b", at(0), at(3), False), ("b", at(4), 9999, True), ("c", at(0), at(4), False),
    }
    kept = grown(spark, [1, 2], log, close_absent=False)
    assert kept.where("is_current").count() == 2


def test_growth_interprets_no_expression(spark):
    """The pairs of a member's last version and its capture become rows in compiled code."""
    log = captures(spark, capture("a", 1, "x"), capture("a", 2, "y"), capture("b", 2, "z"))
    before = history.member_versions(log.where(F.col("captured_at") == F.lit(at(1))), DIM, CHECKED)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        now = history.grow_versions(before, log.where(F.col("captured_at") == F.lit(at(2))), DIM, F.lit(at(2)), CHECKED)
        stages = now._jdf.queryExecution().debug().codegenToSeq()
        made = [(stages.apply(i)._1(), stages.apply(i)._2()) for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    pairs = [code for tree, code in made if "Generate" in tree and "FullOuter" in tree]
    assert len(pairs) == 1 and ").eval(" not in pairs[0]
    assert sorted((r.x_id, r.name, r.is_current) for r in now.collect()) == [("a", "x", False), ("a", "y", True), ("b", "z", True)]


FACT = "id long, k string, ts timestamp"


def test_merge_equals_join_on_ties_gaps_and_nulls(spark):
    versions = [("a", at(1), at(3), "v1"), ("a", at(3), at(3), "none"), ("a", at(3), at(5), "v2"), ("a", at(7), at(9), "after a gap"), ("b", at(2), at(4), "b1"), (None, at(0), at(9), "no key")]
    h = spark.createDataFrame(versions, "k string, valid_from timestamp, valid_to timestamp, v string")
    facts = spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate([(k, t) for k in ("a", "b", "c", None) for t in [*[at(d, x) for d in range(10) for x in (0, 5)], None]])], FACT)
    facts = facts.unionByName(facts)  # repeated rows
    want = sorted(map(str, history.as_of_join(facts, h, "k", "ts", "v", "out").collect()))
    assert sorted(map(str, history.as_of_merge(facts, h, "k", "ts", "v", "out").collect())) == want
    hot = history.hot_keys(facts, "k")
    assert {r.k for r in hot.collect()} == {"a", "b", "c"} and hot.agg(F.min("salts")).first()[0] > 30
    assert sorted(map(str, history.as_of_merge(facts, h, "k", "ts", "v", "out", hot).collect())) == want


def test_merge_beats_join_on_a_key_with_very_many_versions(spark):
    n = 100_000
    h = spark.range(n).selectExpr("'a' AS k", "timestamp_seconds(id) AS valid_from", "timestamp_seconds(id + 1) AS valid_to", "cast(id AS string) AS v")
    facts = spark.range(20_000).selectExpr("id", "'a' AS k", "timestamp_millis((id * 7919 * 31) % 100000000) AS ts")
    took = []
    for join in (history.as_of_join, history.as_of_merge):
        start = time.perf_counter()
        took.append((join(facts, h, "k", "ts", "v", "out").agg(F.sum(F.hash("id", "out")), F.count_if(F.col("out") == "UNKNOWN")).first(), time.perf_counter() - start))
    assert took[0][0] == took[1][0] and took[0][0][1] == 0
    assert took[1][1] < took[0][1]


def test_members_move_once_for_their_captures_and_facts_keep_their_place(spark, sf_dir):
    """Line items: their rows alone. Impressions: delivery (two tables), campaigns, line items, and events by line item."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = {}
        for name in ("history_line_item", "fact_impressions"):
            said = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            moved[name] = said.count("Exchange hashpartitioning")
        assert moved == {"history_line_item": 1, "fact_impressions": 5}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_made_after_the_joins_are_the_histories_keys(spark, sf_dir):
    t = standins.tables(spark, sf_dir)
    events = t["clicks"].limit(500).withColumn("campaign_id", F.when(F.col("click_id").endswith("7"), F.lit(None)).otherwise(F.col("campaign_id")))
    events = events.localCheckpoint()
    captures = t["campaigns_log"]
    late = facts.clicks(events, {"campaign": history.member_versions(captures, dims.DIMENSIONS["campaign"])})
    keyed = facts.clicks(events, {"campaign": history.entity_history(captures, dims.DIMENSIONS["campaign"])})
    assert late.columns == keyed.columns
    assert sorted(map(tuple, late.collect()), key=str) == sorted(map(tuple, keyed.collect()), key=str)
    assert late.where("campaign_version_key = 'UNKNOWN'").count() > 0 and late.where("campaign_version_key <> 'UNKNOWN'").count() > 0


def test_a_null_that_moves_between_columns_makes_a_version(spark):
    rows = [("m", 1, "a", None), ("m", 2, None, "a"), ("m", 3, None, "a")]
    log = spark.createDataFrame(rows, "id string, at int, x string, y string")
    assert sorted(r["at"] for r in history.capture_versions(log, "id", ["at"], ["x", "y"]).collect()) == [1, 2]
