import json

import pytest

from tidemill.sources import tables as S
from tidemill.streaming import landing


def message(n, op="u", table="users", value=True, ts=1704067200000):
    body = {"op": op, "ts_ms": ts, "source": {"schema": "public", "lsn": n, "txId": "x"}, "before": None, "after": {"id": n}}
    return (json.dumps({"id": n}), json.dumps(body) if value else None, f"cdc.public.{table}", n % 2, n, 1704153600000)


def write(spark, path, rows):
    spark.createDataFrame(rows, landing.MESSAGE).write.mode("append").parquet(path)


def test_flatten_tombstones_tables_and_days(spark):
    rows = landing.with_day(landing.flatten(spark.createDataFrame([message(1), message(2, value=False)], landing.MESSAGE))).orderBy("kafka_offset").collect()
    assert (rows[0].op, rows[0].source_table, rows[0].lsn, rows[0].tx_id, rows[0].after_json) == ("u", "users", 1, None, '{"id":1}')
    assert rows[0].dt.isoformat() == "2024-01-01"
    assert (rows[1].op, rows[1].lsn, rows[1].dt.isoformat()) == ("t", None, "2024-01-02")


def test_flatten_keeps_odd_envelopes(spark):
    source = {"schema": "public", "table": "users", "lsn": "7", "txId": 9}
    values = [
        json.dumps({"source": source, "after": {"b": 1, "a": {"d": 2, "c": 3}}}),
        json.dumps({"op": "", "source": {"lsn": "x"}, "transaction": {"id": "12:34"}, "before": {"k": None}}),
        json.dumps({"op": "u", "source": None, "after": None}),
        "{not json", "[1]", "null", '"text"', '{"a":1,"a":2}', "", None,
    ]
    given = [(None, v, "cdc.public.orders" if n % 2 else "orders", 0, n, 5) for n, v in enumerate(values)]
    rows = landing.flatten(spark.createDataFrame(given, landing.MESSAGE)).orderBy("kafka_offset").collect()
    assert len(rows[0]) == 13
    assert (rows[0].op, rows[0].source_table, rows[0].lsn, rows[0].tx_id, rows[0].after_json) == ("?", "users", 7, 9, '{"a":{"c":3,"d":2},"b":1}')
    assert (rows[1].op, rows[1].source_table, rows[1].lsn, rows[1].tx_id, rows[1].before_json) == ("?", "orders", None, 12, '{"k":null}')
    assert (rows[2].op, rows[2].source_table, rows[2].after_json) == ("u", "orders", None)
    for r, v in zip(rows[3:9], values[3:9], strict=True):
        assert (r.op, r.source_table, r.after_json, r.lsn) == ("!", "dead_letters", v, None)
    assert (rows[9].op, rows[9].source_table, rows[9].after_json) == ("t", "orders", None)


def test_payloads_that_are_equal_land_alike(spark):
    given = [(None, v, "a.b.c", 0, n, 5) for n, v in enumerate(['{"op":"c","after":{"y":[1, 2],"x":"\\u00e9"}}', '{"after" : {"x":"é","y":[1,2]},"op":"c"}'])]
    found = landing.flatten(spark.createDataFrame(given, landing.MESSAGE)).select("after_json").distinct().collect()
    assert [r.after_json for r in found] == ['{"x":"é","y":[1,2]}']


def test_no_message_is_lost_on_the_way(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    odd = [(None, v, "cdc.public.users", 0, 90 + n, 1704067200000) for n, v in enumerate(["oops", '{"after":{"id":1}}', None])]
    write(spark, source, [message(1), *odd])
    landing.land(landing.file_messages(spark, source), out, mark).awaitTermination()
    landed = spark.read.parquet(out)
    assert {(r.source_table, r.op) for r in landed.collect()} == {("users", "u"), ("users", "?"), ("users", "t"), ("dead_letters", "!")}
    dead = landed.where("source_table = 'dead_letters'")
    assert dead.first().after_json == "oops" and "PartitionFilters: [isnotnull(source_table" in dead._jdf.queryExecution().executedPlan().toString()


def test_landing_adds_nothing_twice(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    write(spark, source, [message(n) for n in range(6)])
    for _ in range(2):
        landing.land(landing.file_messages(spark, source), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 6
    write(spark, source, [message(n, ts=1704067200000 - 86400000 * 3) for n in range(6, 9)])
    landing.land(landing.file_messages(spark, source), out, mark).awaitTermination()
    landed = spark.read.parquet(out)
    batch = landing.with_day(landing.flatten(spark.read.parquet(source)))
    assert sorted(map(str, landed.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_compaction_listing_and_peek(spark, tmp_path):
    source, out, mark, packed = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark", "packed"))
    for n in range(4):
        write(spark, source, [message(n * 10 + k) for k in range(5)])
    landing.land(landing.file_messages(spark, source, 1), out, mark).awaitTermination()
    landed = spark.read.parquet(out)
    assert S.compact_files(landed, packed) == 20
    before, after = (S.table_size(spark, p).first() for p in (out, packed))
    assert before.n_rows == after.n_rows == 20 and after.n_files <= before.n_files
    assert S.table_size(spark, out, "source_table", "dt").first().n_rows == 20
    assert [r.kafka_offset for r in S.peek(landed, 2).collect()] == [34, 33]


def test_rows_come_from_footers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(n, None if n == 7 else n % 3) for n in range(10)], "id long, part int")
    rows.repartition(2).write.partitionBy("part").parquet(path)
    for keys in ((), ("part",)):
        plan = S.footer_counts(spark, path, *keys)._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)]" in plan and "id" not in plan.split("ReadSchema")[-1].split("\n")[0]
    assert {r.part: r.n_rows for r in S.table_size(spark, path, "part").collect()} == {0: 4, 1: 2, 2: 3, None: 1}
    whole = S.table_size(spark, path).first()
    files = list((tmp_path / "t").glob("part=*/*.parquet"))
    assert (whole.n_rows, whole.n_files, whole.n_bytes) == (10, len(files), sum(f.stat().st_size for f in files))
    empty = f"file://{tmp_path}/e"
    rows.limit(0).write.parquet(empty)
    assert S.table_size(spark, empty).first().n_rows == 0


def test_snapshot_runs_and_manifests(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    S.export_snapshot({"a": spark.range(3)}, root, "run1", 10)
    S.export_snapshot({"a": spark.range(4), "b": spark.range(0)}, root, "run2", 20)
    assert S.pick_run(spark, root).first().wal_lsn == 20 and S.pick_run(spark, root, "run1").first().wal_lsn == 10
    assert spark.read.parquet(f"{root}/run2/b").count() == 0


def test_export_keeps_partitions(spark, tmp_path):
    many = {"a": spark.range(300).repartition(3)}
    for files, want in ((None, 3), (2, 2)):
        S.publish_export(many, f"file://{tmp_path}/{want}", files=files)
        assert len(list((tmp_path / str(want) / "a").glob("*.parquet"))) == want


def test_export_and_load_checks(spark, tmp_path):
    root = f"file://{tmp_path}/exp"
    manifest = S.publish_export({"a": spark.range(3).toDF("k"), "gone": None}, root)
    a = spark.read.parquet(f"{root}/a")
    assert S.count_mismatches({"a": a}, manifest).count() == 0
    assert S.count_mismatches({"a": a.limit(1)}, manifest).count() == 1
    odd = spark.sql("SELECT DATE '1970-01-01' AS d, TIMESTAMP '2024-01-01 00:00:00' AS t, 1 AS n")
    assert {r.column_name: r.implausible for r in S.implausible_times(odd).collect()} == {"d": 1, "t": 0}
    S.write_keyed(odd, f"{root}/keyed", "t")
    S.write_csv(a, f"{root}/csv")
    assert spark.read.parquet(f"{root}/keyed").where("day = DATE '2024-01-01'").count() == 1
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == 3
    assert S.footer_schema(spark, f"{root}/a").fieldNames() == ["k"] and S.file_count(2_500_000) == 3


def test_event_counts_stream(spark, tmp_path):
    path = f"file://{tmp_path}/ev"
    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS kind UNION ALL SELECT TIMESTAMP '2024-01-05 00:00:00', 'b'").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, kind string").parquet(path)
    query = landing.event_counts(stream, "ts", "kind").writeStream.format("memory").queryName("event_counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("event_counts").count() == 2


def test_a_named_run_that_is_absent_is_an_error(spark, tmp_path):
    root = f"{tmp_path}/exports"
    S.export_snapshot({"n": spark.range(3)}, root, "r1", 5)
    assert S.pick_run(spark, root, "r1").first()["wal_lsn"] == 5
    with pytest.raises(ValueError):
        S.pick_run(spark, root, "r2")


def test_billing_follows_the_strategy(spark):
    from pyspark.sql import functions as F

    from tidemill.operators import billing

    strategies = ["CPM", "CPC", "CPA", "TARGET_ROAS", "MAX_CONVERSIONS", "OTHER", None]
    campaigns = spark.createDataFrame(list(enumerate(strategies)), "campaign_id int, bid_strategy string")
    kinds = {r[0]: r[1] for r in campaigns.select("bid_strategy", billing.billing_type(F.col("bid_strategy"))).collect()}
    assert kinds == {"CPM": "CPM", "CPC": "CPC", "CPA": "CPA", "TARGET_ROAS": "CPA", "MAX_CONVERSIONS": "CPA", "OTHER": None, None: None}
    impressions = campaigns.selectExpr("campaign_id", "campaign_id as line_item_id", "1 as publisher_id", "'USD' as currency", "campaign_id as impression_id",
                                       "TIMESTAMP_NTZ '2024-01-01 10:20:00' as impression_timestamp", "CAST(2000 AS DECIMAL(12,6)) as clearing_price")
    lines = billing.hourly_cpm(impressions, campaigns, F.lit("2024-01-01 10:30:00").cast("timestamp_ntz")).collect()
    assert [(r.campaign_id, float(r.spend_amount), r.created_at.minute) for r in lines] == [(0, 2.0, 30)]
    assert [r.campaign_id for r in billing.per_impression(impressions, campaigns).collect()] == [0]
    items = campaigns.selectExpr("campaign_id as line_item_id", "CAST(3 AS DECIMAL(12,4)) as bid_amount", "'USD' as bid_currency")
    for kind, want in (("CPC", {1}), ("CPA", {2, 3, 4})):
        assert {r.campaign_id for r in billing.per_event(impressions, campaigns, items, kind, "impression_id").collect()} == want
