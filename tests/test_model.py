import datetime as dt
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import dims, facts, history, marts, quality
from tidemill.plans import catalog, checks, standins
from tidemill.session import cut

T = dt.datetime


def versions(spark, rows):
    return spark.createDataFrame(rows, "k string, at timestamp_ntz, tie int, status string, created timestamp_ntz")


def test_capture_keeps_changes_only(spark):
    log = versions(spark, [("a", T(2024, 1, d), d, s, T(2023, 1, 1)) for d, s in ((1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, "x"))])
    got = history.capture_versions(log, "k", ["at", "tie"], ["status"]).orderBy("at").collect()
    assert [r.at.day for r in got] == [1, 3, 4, 6]


def test_type2_clamps_backdates_and_closes(spark):
    rows = [("a", T(2024, 1, 5), 1, "x", T(2024, 1, 1)), ("a", T(2024, 1, 5), 2, "y", T(2024, 1, 1)), ("a", T(2024, 1, 9), 3, "z", T(2024, 1, 1))]
    h = history.type2(versions(spark, rows), "k", "at", "created", "tie").orderBy("tie").collect()
    assert [r.valid_from.day for r in h] == [1, 5, 9] and [r.is_current for r in h] == [False, False, True]
    assert h[0].valid_to == h[1].valid_from and h[2].valid_to.year == 9999
    assert len({r.entity_version_key for r in h}) == 3


def test_as_of_join_is_half_open_and_unknown_before_the_first(spark):
    h = history.type2(versions(spark, [("a", T(2024, 1, 5), 1, "x", T(2024, 1, 3)), ("a", T(2024, 1, 9), 2, "y", T(2024, 1, 3))]), "k", "at", "created", "tie")
    facts = spark.createDataFrame([("a", T(2024, 1, d)) for d in (2, 3, 8, 9)] + [("b", T(2024, 1, 9))], "k string, ts timestamp_ntz")
    got = {(r.k, r.ts.day): r.v for r in history.as_of_join(facts, h, "k", "ts", "status", "v").collect()}
    assert got == {("a", 2): "UNKNOWN", ("a", 3): "x", ("a", 8): "x", ("a", 9): "y", ("b", 9): "UNKNOWN"}
    assert history.not_contiguous(h, "k").count() == 0 and history.not_one_current(h, "k").count() == 0


def test_dimension_has_one_unknown_member(spark):
    members = spark.createDataFrame([("1", "9", "A", 5), ("2", None, "B", None)], "x_id string, p_id string, name string, age int")
    dim = dims.Dimension("x", "x_id", {"p_key": "p_id"}, ("name", "age"), {"age": 13})
    rows = {r.x_id: r for r in dims.type1(members, dim).collect()}
    assert rows["UNKNOWN"].age == 13 and rows["UNKNOWN"].p_key == "UNKNOWN" and rows["2"].p_key == "UNKNOWN"
    assert quality.has_unknown_member(dims.type1(members, dim), "x_key").count() == 0


def test_mart_never_multiplies_facts(spark):
    i = spark.createDataFrame([(1, "USD")] * 3 + [(2, "EUR")], "k int, currency string")
    s = spark.createDataFrame([(1, "USD", 5)] * 4 + [(3, "USD", 7)], "k int, currency string, amount int")
    mart = marts.build([marts.Part(i, {"impressions": F.lit(1)}, {"seen": "k"}), marts.Part(s, {"spend": F.col("amount")})], ["k", "currency"])
    assert {(r.k, r.seen) for r in mart.collect()} == {(1, 1), (2, 1), (3, 0)}
    mart = mart.drop("seen")
    assert {tuple(r) for r in mart.collect()} == {(1, "USD", 3, 20), (2, "EUR", 1, 0), (3, "USD", 0, 7)}
    rates = {r.k: r.effective_cpm for r in marts.with_rates(mart).collect()}
    assert rates[3] is None and rates[2] == 0.0
    drift = marts.drift(mart, {"spend": (s, F.sum("amount"))}).first()
    assert drift.mart_total == drift.fact_total == 27


def test_checks_pass_warn_fail_and_gate(spark):
    bases = {"b": spark.range(5).toDF("n")}
    specs = [
        quality.Check("ok", "row", "b", "n > 10"), quality.Check("bad", "row", "b", "n > 3"),
        quality.Check("soft", "row", "b", "n > 3", quality.WARNING), quality.Check("some", "row", "b", "n > 3", expect="nonzero"),
        quality.Check("absent", "row", "missing", "true"),
    ]
    got = {r.name: r.status for r in quality.observe(specs, bases).collect()}
    assert got == {"ok": "PASS", "bad": "FAIL", "soft": "WARN", "some": "PASS"}
    with pytest.raises(quality.QualityError, match="bad"):
        quality.gate(quality.observe(specs, bases))
    quality.gate(quality.observe(specs[2:], bases))
    with pytest.raises(ValueError):
        quality.validate(specs + specs[:1])


def test_catalogue_is_complete():
    families = [
        checks.REFERENTIAL, checks.TEMPORAL, checks.BUSINESS, checks.UNIQUENESS, checks.JOINS, checks.INTEGRITY, checks.LINEAGE,
        checks.RECONCILIATION,
    ]
    assert [len(f) for f in families] == [16, 13, 13, 7, 13, 6, 6, 8]
    quality.validate(checks.ADVERTISING + checks.INTEGRITY + checks.LINEAGE + checks.RECONCILIATION)


#: For each table, changes that are each made to some of its rows; ``+`` repeats rows.
SPOILS = {
    "advertisers": ["advertiser_name = ' '", "billing_currency = '12!'", "created_at = updated_at + INTERVAL '1' DAY", "account_status = 'NO'", "advertiser_name = NULL", "+"],
    "campaigns": [
        "advertiser_id = 'none'", "created_at = created_at - INTERVAL '9000' DAY", "created_at = start_date + INTERVAL '5' DAY", "start_date = end_date + INTERVAL '1' DAY",
        "daily_budget = campaign_budget + 1", "campaign_status = 'DRAFT'", "bid_strategy = 'TARGET_CPC'", "campaign_budget = -1",
    ],
    "line_items": [
        "campaign_id = 'none'", "start_date = end_date + INTERVAL '1' DAY", "created_at = end_date + INTERVAL '1' DAY", "line_item_status = 'NO'", "frequency_cap = 0",
        "optimization_goal = 'NO'",
    ],
    "creatives": ["landing_page_url = 'http://x'", "created_at = TIMESTAMP '1990-01-01 00:00:00'", "created_at = TIMESTAMP '2090-01-01 00:00:00'", "creative_type = 'NO'"],
    "publishers": ["created_at = updated_at + INTERVAL '1' DAY", "publisher_status = 'NO'", "publisher_type = 'WEB'", "domain = 'one'", "domain = 'one'"],
    "placements": ["publisher_id = 'none'", "device_type = 'NO'", "created_at = TIMESTAMP '1990-01-01 00:00:00'", "floor_price = -1", "placement_type = 'NO'"],
    "audiences": ["max_age = 120", "min_age = max_age", "gender = 'NO'", "audience_type = 'NO'"],
    "impressions": [
        "line_item_id = 'none'", "line_item_id = (SELECT max(line_item_id) FROM {line_items})", "advertiser_id = 'none'", "placement_id = (SELECT max(placement_id) FROM {placements})",
        "impression_timestamp = TIMESTAMP '2030-01-01 00:00:00'", "impression_timestamp = TIMESTAMP '1980-01-01 00:00:00'", "viewability_score = 2", "bid_price = 0", "city = NULL",
        "country = 'none'", "currency = 'usd'", "device_type = 'NO'", "+",
    ],
    "clicks": [
        "impression_id = 'none'", "campaign_id = 'none'", "click_timestamp = TIMESTAMP '1980-01-01 00:00:00'", "country = 'none'", "created_at = click_timestamp - INTERVAL '1' DAY", "+",
    ],
    "conversions": ["click_id = 'none'", "campaign_id = 'none'", "conversion_timestamp = TIMESTAMP '1980-01-01 00:00:00'", "conversion_type = 'NO'", "+"],
    "spend_transactions": [
        "campaign_id = 'none'", "line_item_id = (SELECT max(line_item_id) FROM {line_items})", "impression_id = 'none'", "billing_type = 'CPM'", "billing_type = 'NO'", "spend_amount = -1",
    ],
}


def test_every_check_sees_its_planted_violation(spark, sf_dir):
    given = standins.tables(spark, sf_dir, ("delivery",))
    spoiled = dict(given)
    for table, changes in SPOILS.items():
        key = standins.COLUMNS[table].split()[0]
        numbered = given[table].withColumn("_n", F.pmod(F.dense_rank().over(Window.orderBy(key)), F.lit(3 * len(changes)))).cache()
        parts = [numbered.drop("_n")]
        for n, change in enumerate(changes):
            column, _, value = change.partition(" = ")
            some = numbered.where(F.col("_n") == n).drop("_n")
            if value:
                kind = dict(some.dtypes)[column]
                for other in ("line_items", "placements"):
                    if "{" + other + "}" in value:
                        value = "'" + given[other].agg(F.max(f"{other[:-1]}_id")).first()[0] + "'"
                some = some.withColumn(column, F.expr(value).cast(kind))
                parts[0] = parts[0].join(numbered.where(F.col("_n") == n).select(key), key, "left_anti")
            parts.append(some)
        spoiled[table] = cut(reduce(DataFrame.unionByName, parts), f"spoiled-{table}")
    # Places where the tables are too small for the planted differences of the reconciliation.
    spoiled["publishers_log"] = given["placements_log"].selectExpr("placement_id as publisher_id", "'x' as publisher_status", "is_deleted", "capture", "publisher_id as _p").drop("_p")
    family = [c for c in checks.ADVERTISING + checks.RECONCILIATION if c.expect == "zero"]
    others = {c.base for c in family} - set(checks.RELATIONS) - set(checks.EACH)
    rows = quality.observe_scans(family, spoiled, checks.RELATIONS, checks.EACH, catalog.bases(spoiled, others)).collect()
    assert {r.name for r in rows if r.observed == 0} == set() and len(rows) == len(family)


def test_checks_read_each_table_twice_at_most():
    for family in (checks.BUSINESS, checks.TEMPORAL, checks.ROW_RULES):
        found = quality.scans(family, checks.RELATIONS, checks.EACH)
        assert max(Counter(table for table, _, _ in found).values()) <= 2
    found = quality.scans(checks.BUSINESS, checks.RELATIONS, checks.EACH)
    read = Counter(t for table, parents, _ in found for t in (table, *(p.table for p in parents)))
    assert max(read.values()) == 2 and len(read) == 11  # once for all its predicates, once joined
    assert {p.table for table, parents, _ in found for p in parents} == {"campaigns", "placements", "audiences"}


def test_current_state_checks_see_planted_violations(spark):
    rows = [(1, True, None, None, None, None, 5), (None, False, T(2024, 1, 1), 9, "x", None, 5), (2, False, None, 3, "d", None, 5), (2, True, None, None, "c", None, 5)]
    state = spark.createDataFrame(rows, "user_id long, is_deleted boolean, deleted_at timestamp, _lsn long, _op string, _event_ts timestamp, boundary long")
    events = spark.createDataFrame([(True, None), (False, 4)], "is_deleted boolean, _lsn long")
    own = {
        "s_state": state, "s_keys": state.groupBy("user_id").agg(F.count("*").alias("n")), "s_events": events,
        "b_impression_ids": spark.createDataFrame([("i", 2)], "impression_id string, n long"),
    }
    got = quality.observe(checks.INTEGRITY + checks.LINEAGE, own).collect()
    assert {r.name for r in got if r.observed == 0} == set() and len(got) == 12


def test_histories_follow_captures(spark):
    rows = [
        # name, updated, deleted, is_deleted, captured; the third capture only touches the update, the fourth runs backwards
        ("1", "A", T(2024, 1, 2), None, False, T(2024, 1, 3)), ("1", "B", T(2024, 1, 5), None, False, T(2024, 1, 6)),
        ("1", "B", T(2024, 1, 8), None, False, T(2024, 1, 9)), ("1", "C", T(2024, 1, 4), None, False, T(2024, 1, 10)),
        ("1", "C", T(2024, 1, 4), T(2024, 1, 12), True, T(2024, 1, 13)),
    ]
    captures = spark.createDataFrame(rows, "x_id string, name string, updated_at timestamp_ntz, deleted_at timestamp_ntz, is_deleted boolean, captured_at timestamp_ntz")
    captures = captures.withColumn("created_at", F.lit(T(2024, 1, 1)).cast("timestamp_ntz"))
    dim = dims.Dimension("x", "x_id", {}, ("name",))
    h = history.entity_history(captures, dim, ("name", "is_deleted")).orderBy("captured_at").collect()
    assert [(r.name, r.valid_from.day, r.is_current) for r in h if r.x_id] == [("A", 1, False), ("B", 5, False), ("C", 5, False), ("C", 12, True)]
    unknown = [r for r in h if not r.x_id]
    assert len(unknown) == 1 and unknown[0].x_version_key == "UNKNOWN" and unknown[0].valid_from.year == 1900
    assert len({r.x_version_key for r in h}) == 5
    assert history.entity_history(captures.limit(0), dim, ("name", "is_deleted")).count() == 1


def test_mart_rules_see_planted_faults(spark):
    names = "impressions long, measured_impressions long, viewable_impressions long, clicks long, spend double, cpm_spend double, cpc_spend double, cpa_spend double"
    good, bad = (4, 3, 2, 0, 3.0, 1.0, 1.0, 1.0), (1, 3, 4, 0, 9.0, 1.0, 1.0, 1.0)
    mart = marts.with_rates(spark.createDataFrame([good], names))
    assert set(marts.broken_invariants(mart).first()) == {0}
    faulty = marts.with_rates(spark.createDataFrame([bad], names)).withColumn("cost_per_click", F.lit(1.0))
    found = marts.broken_invariants(faulty).first().asDict()
    assert {k for k, v in found.items() if v} == {"spend_not_sum_of_types", "viewable_above_measured", "measured_above_impressions", "cost_per_click_without_denominator"}


def test_checks_of_several_tables_see_every_table(spark, sf_dir):
    given = standins.tables(spark, sf_dir)
    clean = {n: given[n].limit(20).cache() for n in (*checks.MASTERS, "impressions", "clicks", "conversions", "spend_transactions")}

    def seen(name, t):
        family = [c for c in checks.ALL_TABLES if c.name == name]
        return quality.observe(family, catalog.bases(t, {family[0].base})).first()["observed"]

    for name, table, column, value in (
        ("invalid_enum_values", "creatives", "creative_status", "'NO'"),
        ("unexpected_nulls", "clicks", "country", "CAST(NULL AS STRING)"),
        ("negative_money", "placements", "floor_price", "-1"),
        ("currency_not_iso_format", "advertisers", "billing_currency", "'123'"),
        ("event_created_before_it_happened", "spend_transactions", "created_at", "spend_timestamp - INTERVAL '1' HOUR"),
        ("updated_before_created", "advertisers", "updated_at", "created_at - INTERVAL '1' HOUR"),
        ("duplicate_primary_keys", "audiences", "audience_id", "'1'"),
    ):
        rows = clean[table].count()
        spoiled = clean | {table: clean[table].withColumn(column, F.expr(value))}
        assert seen(name, spoiled) - seen(name, clean) == (1 if column == "audience_id" else rows) and rows > 1


def test_generic_tests_and_comparison(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "q")], "k int, v string")
    assert quality.unique(a, "k").count() == 1 and quality.not_null(a, "v").count() == 1
    assert quality.accepted_values(a, "v", ["x"]).count() == 1 and quality.expression_is_true(a, "v = 'x'").count() == 2
    assert quality.relationships(a, "k", b.where("k = 1"), "k").count() == 2
    assert quality.compare_systems(a.where("v is null or k = 1"), b, "k", ["v"]).first()[:] == (0, 1, 0)
    spark.range(3).createOrReplaceTempView("present_view")
    found = quality.sql_checks(spark, {"n": ("SELECT count(*) FROM present_view", ["present_view"]), "m": ("SELECT 1 FROM gone", ["gone"])})
    assert [tuple(r) for r in found.collect()] == [("n", 3)]


def test_every_query_has_a_name_and_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 70


def one_exchange(df):
    """Of a plan that has not run yet."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_gathered_marts_equal_plain_ones(spark):
    """Sums and two distinct counts with nulls, repeats and a null key, from rows exchanged once."""
    rows = [(1, "a", "p", "x", 1), (1, "a", "p", "y", 2), (1, "a", "q", "x", 3), (1, "a", None, "z", 4), (1, None, "p", None, 5), (2, "a", "p", "x", 6), (1, "a", "p", "x", 7)]
    f = spark.createDataFrame(rows, "day int, k string, p string, c string, amount int")
    g = f.where("day = 1").select("day", "k", F.lit(1).alias("other"))
    parts = [marts.Part(f, {"amount": F.col("amount")}, {"n_p": "p", "n_c": "c"}), marts.Part(g, {"other": F.col("other")})]
    plain = marts.build(parts, ["day", "k"])
    want = sorted(map(str, plain.collect()))
    for given in ({}, {"rows_expected": 1_200_000}):
        got = marts.build(parts, ["day", "k"], ["day", "k"], **given)
        assert one_exchange(got) and got.schema.simpleString() == plain.schema.simpleString()
        assert sorted(map(str, got.collect())) == want
    alone = [marts.Part(f, {}, {"n_p": "p", "n_c": "c"})]
    assert sorted(map(str, marts.build(alone, ["day", "k"], ["k"]).collect())) == sorted(map(str, marts.build(alone, ["day", "k"]).collect()))
    assert marts.build(alone, ["day", "k"], ["k"], 1_200_000).rdd.getNumPartitions() == 3


def test_rows_by_member_inherit_as_the_facts_do(spark, sf_dir):
    """Clicks and conversions in one join, orphans and nulls among them, against the facts resolved one by one."""
    t = standins.tables(spark, sf_dir)
    broken = F.when(F.crc32("click_id") % 5 != 0, F.col("impression_id"))
    clicks, conversions = t["clicks"].withColumn("impression_id", broken), t["conversions"].withColumn("impression_id", broken)
    impressions = t["impressions"].withColumn("audience_id", F.when(F.crc32("impression_id") % 3 != 0, F.col("audience_id")))
    f = facts.impressions(impressions)
    want = {"click": facts.resolve_clicks(facts.clicks(clicks), f), "conversion": facts.resolve_conversions(facts.conversions(conversions), f)}
    rows = facts.by_member(impressions, clicks, conversions, t["spend_transactions"])["responses"]
    for kind, df in want.items():
        names = [n for n in ("campaign", "advertiser", "line_item", "creative", "publisher", "placement", "audience") if f"{n}_key" in df.columns]
        own = rows.where(F.col("kind") == kind).select(
            F.col("event_id").alias(f"{kind}_id"), "date_key", "currency", *facts.hashed_keys(*names)
        )
        assert own.count() > 100 and own.exceptAll(df.select(*own.columns)).count() == 0 == df.select(*own.columns).exceptAll(own).count()


def test_key_stability_reads_no_fixed_number_of_parts(spark, sf_dir, monkeypatch):
    """The rebuilt copy is dealt by its id over as many parts as the session has, not over seven by city."""
    seen = []
    monkeypatch.setattr(catalog, "cut", lambda df, name="step": seen.append(df) or df)
    assert catalog.QUERIES["key_stability"](spark, sf_dir).first().unchanged
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(city" not in plan


def test_growing_orders_are_not_held_whole_by_each_task(spark, sf_dir):
    """Two rows of one order, two orders of one key and a line item without one."""
    t = standins.tables(spark, sf_dir)
    t.made["lineitem"] = t["lineitem"].where("l_orderkey < 4")
    t.made["orders"] = t["orders"].where("o_orderkey = 1").select("*").union(t["orders"].where("o_orderkey = 1"))
    joined = t["delivery"].select("l_orderkey", "rn")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    lines = {r.l_orderkey: r["count"] for r in t.made["lineitem"].groupBy("l_orderkey").count().collect()}
    assert {r.l_orderkey: r["count"] for r in joined.groupBy("l_orderkey").count().collect()} == {k: n * (1 + (k == 1)) for k, n in lines.items()}


def test_shuffles_begin_with_partitions_by_input(spark, sf_dir):
    before = spark.conf.get(standins.INITIAL, None)
    standins.deal_by_size(spark, 100 * standins.PART_BYTES)
    assert spark.conf.get(standins.INITIAL) == "100"
    standins.tables(spark, sf_dir)
    assert spark.conf.get(standins.INITIAL, None) == before


def test_parents_are_met_by_candidates_alone(spark, sf_dir):
    """Impressions later than every parent's creation are not moved to their parents; the count is that of the whole base."""
    given = standins.tables(spark, sf_dir)
    seen = given["impressions"].limit(400).localCheckpoint()
    parts = F.pmod(F.col("impression_id").cast("long") / 100, F.lit(4)).cast("int")
    early = F.when(parts == 0, F.lit(None)).when(parts == 1, F.to_timestamp(F.lit("1980-01-01"))).otherwise(F.to_timestamp(F.lit("2030-01-01")))
    late = {n: F.when(F.pmod(F.col(k).cast("long"), F.lit(5)) == 0, F.lit(None)).otherwise(F.col("created_at")) for n, k in (("creatives", "creative_id"), ("placements", "placement_id"))}
    t = {n: given[n].withColumn("created_at", F.expr("CAST(created_at AS TIMESTAMP)") if n not in late else late[n]) for n in ("line_items", *late)}
    t["impressions"] = seen.withColumn("impression_timestamp", early)
    check = next(c for c in checks.TEMPORAL if c.base == "m_parents")
    whole = spark.sql(checks.BASES["m_parents"], **t)
    some = catalog.bases(t, {"m_parents"})["m_parents"]
    assert 0 < some.where(check.predicate).count() == whole.where(check.predicate).count()
    assert some.count() < whole.count()
    nothing = t | {"creatives": t["creatives"].where("false")}
    assert catalog.bases(nothing, {"m_parents"})["m_parents"].count() == 0


def test_temporal_checks_group_line_items_in_their_place(spark, sf_dir):
    """Every grouping of line items reads rows that were dealt by the key that they are joined by."""
    said = catalog.QUERIES["checks_temporal"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(line_item_id" in said and "Exchange hashpartitioning(l_orderkey" not in said


def pointing_tables(spark):
    """Small tables of all that the referential checks read, without a key, with keys that meet nothing and with keys that several parents have."""
    ids = lambda k: [str(n) for n in range(k)]
    some = lambda n, k, names: names[(n * 5 + k) % len(names)]
    t = {
        "advertisers": [(i,) for i in [*ids(4), "2"]],
        "campaigns": [(i, some(n, 1, [*ids(4), "none", None])) for n, i in enumerate([*ids(9), "5", "5"])],
        "line_items": [(i, some(n, 2, [*ids(9), "none", None])) for n, i in enumerate([*ids(12), "7", None])],
        "creatives": [(i, some(n, 3, [*ids(4), "none", None])) for n, i in enumerate([*ids(6), "3"])],
        "publishers": [(i,) for i in [*ids(5), "4", "4"]],
        "placements": [(i, some(n, 4, [*ids(5), "none", None])) for n, i in enumerate(ids(8))],
        "audiences": [(i, "N") for i in ids(3)],
    }
    key = lambda n, k, size: None if (n + k) % 11 == 0 else "none" if (n + k) % 13 == 0 else str((n * 5 + k) % size)
    t["impressions"] = [(str(n % 110), key(n, 1, 9), key(n, 2, 12), key(n, 3, 4), key(n, 4, 6), key(n, 5, 5), key(n, 6, 8), key(n, 7, 3)) for n in range(120)]
    t["clicks"] = [(f"c{n % 55}", key(n, 8, 130), *(row := t["impressions"][n])[1:3], None if n % 9 == 0 else row[3], row[4]) for n in range(60)]
    t["conversions"] = [(f"v{n}", None if n % 7 == 0 else f"c{n * 3}", key(n, 9, 130), *t["clicks"][n][2:3], t["clicks"][n][4]) for n in range(30)]
    t["spend_transactions"] = [(f"s{n}", key(n, 1, 9), key(n, 2, 12), key(n, 5, 5), key(n, 3, 130) if n % 3 == 0 else None) for n in range(90)]
    columns = {
        "impressions": "impression_id campaign_id line_item_id advertiser_id creative_id publisher_id placement_id audience_id",
        "clicks": "click_id impression_id campaign_id line_item_id advertiser_id creative_id", "conversions": "conversion_id click_id impression_id campaign_id advertiser_id",
        "spend_transactions": "spend_transaction_id campaign_id line_item_id publisher_id impression_id", "audiences": "audience_id country",
        "campaigns": "campaign_id advertiser_id", "line_items": "line_item_id campaign_id", "creatives": "creative_id advertiser_id", "placements": "placement_id publisher_id",
    }
    lent = {"campaigns": ("created_at", "start_date", "end_date", "campaign_status"), "line_items": ("start_date", "end_date"), "placements": ("floor_price",)}
    lent |= {"advertisers": ("created_at",), "publishers": ("created_at",), "impressions": ("impression_timestamp", "device_type", "country"), "clicks": ("click_timestamp",)}
    made = {n: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.get(n, f"{n[:-1]}_id").split())) for n, rows in t.items()}
    return {n: df.withColumns({c: F.lit("x") for c in lent.get(n, ())}).coalesce(1).cache() for n, df in made.items()}


def observed(df):
    return {r.name: r.observed for r in df.collect()}


def test_parents_met_apart_count_as_joined_rows(spark):
    """Every parent is met once, by keys alone, and the counts are those of the whole joins, which SQL makes."""
    t = pointing_tables(spark)
    single = {n: df.dropDuplicates(df.columns[:1]) for n, df in t.items()}
    for tables in (t, single | {n: t[n].where("false") for n in ("audiences", "clicks")}):
        sql = spark.sql(checks.as_sql(checks.REFERENTIAL, checks.BASES), **tables)
        got = observed(quality.observe_apart(checks.REFERENTIAL, tables, checks.RELATIONS, checks.EACH, {}))
        assert got == observed(sql) and len(got) == 16 and (tables is not t or min(got.values()) > 0)


def test_whole_joins_where_columns_of_several_parents_are_compared(spark):
    t = pointing_tables(spark)
    both = quality.Check("both", "join", "b_conversions", "k_imp <> i_id OR i_id IS NULL")
    nothing = quality.Check("nothing", "join", "b_spend", "spend_transaction_id <> 's1'")
    for family in ([both], [nothing], [both, nothing, *checks.REFERENTIAL]):
        got, want = (observed(f(family, t, checks.RELATIONS, checks.EACH, {})) for f in (quality.observe_apart, quality.observe_scans))
        assert got == want


def test_referential_checks_move_keys_once_to_each_parent(spark, sf_dir, monkeypatch):
    """What is moved to a parent are keys and the columns that are compared with it, not what other parents lend."""
    met = {}
    monkeypatch.setattr(quality, "cut", lambda df, name: met.setdefault(name, df))
    got = observed(catalog.QUERIES["checks_referential"](spark, sf_dir))
    assert len(got) == 16 and len(met) == 9
    moved = met["met-creatives"]._jdf.queryExecution().optimizedPlan().toString()
    assert "placement_id" not in moved and "campaign_id" not in moved
