"""Registered queries of the table operators, each with its SQL form where one exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions import scalars as S
from tidemill.operators import billing, changelog, dims, facts, history, marts, merge, quality, refresh, reports, stored
from tidemill.plans import checks
from tidemill.plans.standins import COLUMNS, DERIVED, LOGS, oracle, tables
from tidemill.session import brief_shuffles, cut, scratch_dir
from tidemill.sources import jdbc, offsets
from tidemill.sources import tables as sources
from tidemill.sources import versions
from tidemill.streaming import landing

Tables = dict[str, DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, written: tuple[str, ...] = (), dealt: tuple[str, ...] = ()):
    """Registers a function of the tables under its name, with its SQL; ``written`` names derived tables that are
    computed once, since the query reads them often, ``dealt`` member tables that it joins by their key."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir, written, dealt))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return wrap


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, for a result that engines print alike."""
    kinds = {"date": "string"}
    return df.select(
        *[F.col(n).cast("double" if k.startswith("decimal") else kinds.get(k, k)).alias(n) for n, k in df.dtypes]
    )


def d(expression: str, name: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {name}"


# ---------------------------------------------------------------- change log and current state

STATE = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("amount", T.DecimalType(14, 4)),
        T.StructField("kind", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def change_events(t: Tables) -> DataFrame:
    """The events table as change records: JSON payloads in wire types, a tombstone after each deletion."""
    c = t["changes"].withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    payload = F.to_json(
        F.struct("user_id", F.col("amount").cast("string").alias("amount"), "kind", F.unix_date("day").alias("day"), F.col("ms").alias("updated_at"))
    )
    gone = F.col("op") == "d"
    made = c.select(
        F.explode(F.when(gone, F.array(F.lit("d"), F.lit("t"))).otherwise(F.array("op"))).alias("o"),
        F.col("user_id"), F.col("lsn"), F.col("ms"), payload.alias("payload"),
    )
    dead = F.col("o") == "t"
    return made.select(
        F.col("o").alias("op"),
        F.lit("public").alias("source_schema"),
        F.lit("users").alias("source_table"),
        F.when(~dead, F.col("ms")).alias("event_ts_ms"),
        F.when(~dead, F.col("lsn")).alias("lsn"),
        F.lit(None).cast("long").alias("tx_id"),
        F.to_json(F.struct("user_id")).alias("key"),
        F.when(F.col("o") == "d", F.col("payload")).alias("before_json"),
        F.when(~F.col("o").isin("d", "t"), F.col("payload")).alias("after_json"),
        F.lit("cdc.public.users").alias("kafka_topic"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("kafka_partition"),
        (F.col("lsn") * 2 + dead.cast("int")).alias("kafka_offset"),
        (F.col("ms") + 1000).alias("ingested_at_ms"),
    )


def boundary(t: Tables) -> int:
    """The snapshot's position: half of the log."""
    return (t["changes"].agg(F.max("lsn")).first()[0] or 0) // 2


def snapshot(t: Tables, at: int) -> DataFrame:
    """Rows alive at a position, typed as the source table."""
    state = changelog.collapse_changes(change_events(t).where(F.col("lsn") <= at), "user_id", STATE)
    return changelog.source_columns(state.where(~F.col("is_deleted")))


def current(t: Tables) -> DataFrame:
    at = boundary(t)
    return changelog.reconcile_table(snapshot(t, at), change_events(t), "user_id", at)


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone, decimals as doubles."""
    return doubles(df.select(*[F.col(n).cast("timestamp_ntz").alias(n) if k == "timestamp" else F.col(n) for n, k in df.dtypes]))


SQL_MS = "date_trunc('millisecond', ts)"
SQL_HALF = "(SELECT CAST(floor(max(lsn) / 2) AS BIGINT) FROM {changes})"


def sql_newest(where: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS n FROM {{changes}} WHERE {where}) x WHERE n = 1"


SQL_VALUES = f"user_id, CAST(amount AS DOUBLE) AS amount, kind, CAST(day AS VARCHAR) AS day, {SQL_MS} AS updated_at"
SQL_CHANGED = f"""{SQL_VALUES}, op = 'd' AS is_deleted, CASE WHEN op = 'd' THEN {SQL_MS} END AS deleted_at,
    lsn AS _lsn, op AS _op, {SQL_MS} AS _event_ts"""
SQL_CURRENT = f"""
    SELECT {SQL_VALUES}, false AS is_deleted, CAST(NULL AS TIMESTAMP) AS deleted_at, CAST(NULL AS BIGINT) AS _lsn,
      CAST(NULL AS VARCHAR) AS _op, CAST(NULL AS TIMESTAMP) AS _event_ts
    FROM ({sql_newest("lsn <= " + SQL_HALF)}) s
    WHERE op <> 'd' AND user_id NOT IN (SELECT user_id FROM {{changes}} WHERE lsn > {SQL_HALF})
    UNION ALL SELECT {SQL_CHANGED} FROM ({sql_newest("lsn > " + SQL_HALF)}) c"""


@query(f"SELECT {SQL_CHANGED} FROM ({sql_newest('true')}) c")
def changelog_collapse(t: Tables) -> DataFrame:
    return plain(changelog.collapse_changes(change_events(t), "user_id", STATE))


@query(SQL_CURRENT)
def changelog_reconcile(t: Tables) -> DataFrame:
    return plain(current(t))


@query(f"""SELECT {SQL_VALUES}, false AS is_deleted FROM ({sql_newest("lsn <= " + SQL_HALF)}) s WHERE op <> 'd'""")
def changelog_snapshot(t: Tables) -> DataFrame:
    return plain(changelog.from_snapshot(snapshot(t, boundary(t))).drop("deleted_at", "_lsn", "_op", "_event_ts"))


@query(f"SELECT {SQL_CHANGED} FROM ({sql_newest('true')}) c")
def merge_upsert(t: Tables) -> DataFrame:
    """Two increments merged one after the other give the state of the whole log."""
    at, log = boundary(t), change_events(t)
    first = changelog.collapse_changes(log.where(F.col("lsn") <= at), "user_id", STATE)
    return plain(merge.merge_upsert(first, changelog.collapse_changes(log, "user_id", STATE, at), "user_id"))


@query(f"""WITH s AS (SELECT user_id FROM ({sql_newest("lsn <= " + SQL_HALF)}) s WHERE op <> 'd'),
    c AS (SELECT user_id, op = 'd' AS gone FROM ({sql_newest("lsn > " + SQL_HALF)}) c)
    SELECT (SELECT count(*) FROM {{changes}}) AS n_events, (SELECT count(*) FROM {{changes}} WHERE op = 'd') AS n_tombstones,
      (SELECT count(*) FROM c) AS merged, (SELECT count(*) FROM c WHERE user_id NOT IN (SELECT user_id FROM s)) AS inserted,
      (SELECT count(*) FROM c WHERE NOT gone AND user_id IN (SELECT user_id FROM s)) AS updated,
      (SELECT count(*) FROM c WHERE gone AND user_id IN (SELECT user_id FROM s)) AS deleted,
      (SELECT count(*) FROM s) AS rows_before,
      (SELECT count(*) FROM s) + (SELECT count(*) FROM c WHERE user_id NOT IN (SELECT user_id FROM s)) AS rows_after""")
def merge_report(t: Tables) -> DataFrame:
    at = boundary(t)
    changes = changelog.collapse_changes(change_events(t), "user_id", STATE, at)
    return merge.merge_report(snapshot(t, at), changes, "user_id", change_events(t))


@query(f"""SELECT count(*) AS total_rows, count(CASE WHEN NOT is_deleted THEN 1 END) AS live_rows,
    count(CASE WHEN is_deleted THEN 1 END) AS deleted_rows FROM ({SQL_CURRENT}) x""")
def current_counts(t: Tables) -> DataFrame:
    return merge.live_counts(current(t))


@query("""SELECT false AS is_tombstone, count(*) AS n_events FROM {changes}
    UNION ALL SELECT true, count(*) FROM {changes} WHERE op = 'd'""")
def changelog_counts(t: Tables) -> DataFrame:
    return changelog.change_counts(change_events(t))


@query(f"SELECT max(_lsn) AS high_water FROM ({SQL_CURRENT}) x")
def high_water_mark(t: Tables) -> DataFrame:
    return changelog.high_water(current(t))


@query(f"""SELECT user_id % 4 AS kafka_partition, count(*) AS n_pending, min(lsn) AS first_lsn FROM {{changes}}
    WHERE lsn > {SQL_HALF} GROUP BY user_id % 4""")
def pending_events(t: Tables) -> DataFrame:
    """What a bookmark per source partition leaves to read."""
    log, at = change_events(t).where(F.col("op") != "t"), boundary(t)
    marks = changelog.offset_bookmarks(log.where(F.col("lsn") <= at))
    return changelog.pending(log, marks).groupBy("kafka_partition").agg(F.count("*").alias("n_pending"), F.min("lsn").alias("first_lsn"))


@query(f"""WITH e AS (SELECT 'users_' || CAST(user_id % 6 AS VARCHAR) AS source_table, count(*) AS n_all, count(CASE WHEN lsn > {SQL_HALF} THEN 1 END) AS n FROM {{changes}} GROUP BY 1),
    x(source_table, run_id, built_on) AS (VALUES ('users_0', 'r2', 'r2'), ('users_1', 'r2', NULL), ('users_2', 'r2', 'r1'), ('users_3', 'r2', 'r2'), ('users_5', 'r2', 'r2'), ('quiet', 'r2', 'r2'))
    SELECT x.source_table, CASE WHEN built_on IS NOT NULL THEN {SQL_HALF} END AS applied_lsn,
      CAST(CASE x.source_table WHEN 'users_0' THEN n WHEN 'users_1' THEN n_all WHEN 'users_2' THEN n_all WHEN 'users_5' THEN n_all ELSE 0 END AS BIGINT) AS pending_events,
      CASE x.source_table WHEN 'users_0' THEN 'incremental' WHEN 'users_1' THEN 'bootstrap' WHEN 'users_2' THEN 'rebuild' WHEN 'users_5' THEN 'rebuild' ELSE 'skip' END AS mode,
      CASE x.source_table WHEN 'users_0' THEN CAST(n AS VARCHAR) || ' new change events' WHEN 'users_1' THEN 'no table yet' WHEN 'users_2' THEN 'snapshot export changed: r1 -> r2'
        WHEN 'users_3' THEN 'append-only, export unchanged' WHEN 'users_5' THEN 'forced' ELSE 'no new change events' END AS reason
    FROM x LEFT JOIN e ON x.source_table = e.source_table""")
def refresh_status(t: Tables) -> DataFrame:
    """Six tables, one for each thing that a refresh can find."""
    spark, at = t["changes"].sparkSession, boundary(t)
    log = change_events(t).where(F.col("op") != "t")
    log = log.withColumn("source_table", F.concat(F.lit("users_"), F.get_json_object("key", "$.user_id").cast("long") % 6))
    marks = changelog.offset_bookmarks(log.where(F.col("lsn") <= at))
    built = [("users_0", "r2"), ("users_2", "r1"), ("users_3", "r2"), ("users_5", "r2"), ("quiet", "r2")]
    known = spark.createDataFrame([(n, at, r) for n, r in built], "source_table string, applied_lsn long, run_id string")
    exports = spark.createDataFrame([(n, "r2") for n in ("users_1", *(n for n, _ in built))], "source_table string, run_id string")
    return changelog.refresh_status(log, marks, known, exports, append_only=("users_3",), forced=("users_5",))


@query(f"""WITH b AS (SELECT epoch_ms(min(ts)) AS lo FROM {{changes}}),
    r AS (SELECT user_id, lsn, op, lsn * 2 AS place, epoch_ms(ts) AS moment FROM {{changes}}
      UNION ALL SELECT user_id, NULL, 't', lsn * 2 + 1, epoch_ms(ts) + 1000 FROM {{changes}} WHERE op = 'd'),
    old AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place DESC) AS n FROM r WHERE moment < (SELECT lo FROM b) + 7 * 86400000)
    SELECT user_id, lsn, op FROM old WHERE n = 1 AND NOT (op = 't' AND moment < (SELECT lo FROM b) + 6 * 86400000)
    UNION ALL SELECT user_id, lsn, op FROM r WHERE moment >= (SELECT lo FROM b) + 7 * 86400000""")
def log_compaction(t: Tables) -> DataFrame:
    """The newest record of each key among those older than a week; old tombstones go, a day's worth stays."""
    log = change_events(t)
    first = log.agg(F.min("event_ts_ms")).first()[0] or 0
    kept = changelog.compact_log(log, first + 7 * 86_400_000, first + 6 * 86_400_000)
    return kept.select(F.get_json_object("key", "$.user_id").cast("long").alias("user_id"), "lsn", "op")


def land_log(rows: DataFrame, path: str) -> None:
    """Change records as a landed log has them, one more batch of files."""
    landing.with_day(rows).hint("rebalance", "source_table", "dt").write.mode("append").partitionBy("source_table", "dt").parquet(path)


@query(f"""WITH r AS (SELECT user_id % 4 AS kafka_partition, lsn, lsn * 2 AS place FROM {{changes}}
      UNION ALL SELECT user_id % 4, lsn, lsn * 2 + 1 FROM {{changes}} WHERE op = 'd'),
    m AS (SELECT kafka_partition, max(place) AS seen FROM r WHERE lsn <= {SQL_HALF} GROUP BY kafka_partition)
    SELECT r.kafka_partition, count(CASE WHEN seen IS NULL OR place > seen THEN 1 END) AS n_pending, count(*) AS n_all, true AS fewer_files, true AS straddled
    FROM r LEFT JOIN m ON r.kafka_partition = m.kafka_partition GROUP BY r.kafka_partition""")
def log_files(t: Tables) -> DataFrame:
    """What bookmarks leave of a log that landed in three batches, read from the files that its zone map chooses:
    the first lies before the bookmarks, the second straddles them, the third came late. An unreadable bookmark reads all."""
    spark, root = t["changes"].sparkSession, scratch(t, "log")
    log, at = change_events(t), boundary(t)
    lsn = F.coalesce("lsn", F.floor(F.col("kafka_offset") / 2))
    late = F.pmod(F.xxhash64("kafka_offset"), F.lit(50)) == 0
    for batch in (log.where((lsn <= at * 0.9) & ~late), log.where((lsn > at * 0.9) & ~late), log.where(late)):
        land_log(batch, f"{root}/log")
        zones = offsets.update_map(spark, f"{root}/log", f"{root}/zones")
    marks = {r.kafka_partition: r.seen_offset for r in changelog.offset_bookmarks(log.where(lsn <= at)).collect()}
    chosen = offsets.files_after(zones, offsets.decode_bookmarks(offsets.encode_bookmarks(marks))).collect()
    everything = offsets.files_after(zones, offsets.decode_bookmarks("{broken"))
    some = offsets.read_files(spark, f"{root}/log", [r.file for r in chosen])
    bookmarks = spark.createDataFrame([("cdc.public.users", k, v) for k, v in marks.items()], "kafka_topic string, kafka_partition int, seen_offset long")
    pending = changelog.pending(some, bookmarks).groupBy("kafka_partition").agg(F.count("*").alias("n_pending"))
    whole = offsets.read_files(spark, f"{root}/log", [r.file for r in everything.collect()]).groupBy("kafka_partition").agg(F.count("*").alias("n_all"))
    fewer, straddled = len(chosen) < everything.count(), any(r.straddles for r in chosen)
    out = whole.join(pending, "kafka_partition", "left").withColumn("n_pending", F.coalesce("n_pending", F.lit(0)).cast("long"))
    return out.select("kafka_partition", "n_pending", "n_all", F.lit(fewer).alias("fewer_files"), F.lit(straddled).alias("straddled"))


SQL_LATE = "(SELECT CAST(floor(max(lsn) / 4) AS BIGINT) * 3 FROM {changes})"


@query(f"""WITH s AS (SELECT user_id % 3 AS k, count(*) AS n_rows, count(CASE WHEN is_deleted THEN 1 END) AS n_deleted, sum(_lsn) AS sum_lsn, sum(amount) AS amount
      FROM ({SQL_CURRENT}) c WHERE user_id % 3 <> 2 GROUP BY user_id % 3
      UNION ALL SELECT 2, count(*), 0, NULL, sum(CAST(amount AS DOUBLE)) FROM ({sql_newest("lsn <= " + SQL_HALF)}) o WHERE op <> 'd' AND user_id % 3 = 2),
    m AS (SELECT user_id % 3 AS k, count(DISTINCT user_id) AS merged FROM {{changes}} WHERE lsn > {SQL_LATE} GROUP BY user_id % 3)
    SELECT 'users_' || CAST(s.k AS VARCHAR) AS source_table, CASE WHEN s.k = 2 THEN 'bootstrap,skip,skip,rebuild' ELSE 'bootstrap,incremental,skip,skip' END AS modes,
      CASE WHEN s.k = 2 THEN 0 ELSE merged END AS merged, s.n_rows, n_deleted, CAST(sum_lsn AS BIGINT) AS sum_lsn, round(amount, 2) AS amount
    FROM s LEFT JOIN m ON s.k = m.k""")
def refresh_runs(t: Tables) -> DataFrame:
    """Three tables refreshed: with three quarters of the log, with all of it, again, and with one of them forced. The last
    is append-only and has an export alone."""
    spark, root = t["changes"].sparkSession, scratch(t, "refresh")
    at, late = boundary(t), (t["changes"].agg(F.max("lsn")).first()[0] or 0) // 4 * 3
    log = change_events(t).withColumn("source_table", F.concat(F.lit("users_"), F.get_json_object("key", "$.user_id").cast("long") % 3))
    log, place = log.where("source_table <> 'users_2'"), F.floor(F.col("kafka_offset") / 2)
    state = cut(snapshot(t, at))
    exports = [refresh.Export(f"users_{k}", "user_id", state.where(F.col("user_id") % 3 == k), "r1", at, append_only=k == 2) for k in range(3)]
    runs = []
    for n, batch in enumerate((log.where(place <= late), log.where(place > late), None, None)):
        if batch is not None:
            land_log(batch, f"{root}/log")
        done = refresh.refresh(spark, f"{root}/tables", exports, f"{root}/log", forced=("users_2",) if n == 3 else ())
        runs.append(done.withColumn("run", F.lit(n)))
    report = reduce(DataFrame.unionByName, runs).groupBy("source_table").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("run", "mode"))), lambda x: x["mode"])).alias("modes"), F.sum("merged").alias("merged")
    )
    tables_ = [versions.read_version(spark, f"{root}/tables/users_{k}").withColumn("source_table", F.lit(f"users_{k}")) for k in range(3)]
    counts = reduce(DataFrame.unionByName, tables_).groupBy("source_table").agg(
        F.count("*").alias("n_rows"), F.count_if("is_deleted").alias("n_deleted"), F.sum("_lsn").alias("sum_lsn"), F.round(F.sum("amount").cast("double"), 2).alias("amount")
    )
    return report.join(counts, "source_table")


@query("""SELECT lag, newest, round((epoch_us(newest + lag * INTERVAL '1' HOUR) - epoch_us(newest)) / 3.6e9, 3) AS age_hours,
    CASE WHEN lag > 48 THEN 'error' WHEN lag > 12 THEN 'warn' ELSE 'pass' END AS status
    FROM (SELECT max(ts) AS newest FROM {events}) e CROSS JOIN (VALUES (0), (12), (13), (48), (60)) v(lag)""")
def source_freshness(t: Tables) -> DataFrame:
    """The events' age as of some hours after the newest."""
    newest = t["events"].agg(F.max("ts")).first()[0]
    parts = []
    for lag in (0, 12, 13, 48, 60):
        as_of = F.lit(newest).cast("timestamp") + F.expr(f"interval {lag} hours")
        parts.append(merge.freshness(t["events"], "ts", as_of).withColumn("lag", F.lit(lag)))
    return plain(reduce(DataFrame.unionByName, parts))


def topic(t: Tables) -> DataFrame:
    """The change log as the messages of a topic."""
    c = change_events(t)
    image = lambda column: F.from_json(column, changelog.wire_schema(STATE))
    body = F.struct(
        "op", F.col("event_ts_ms").alias("ts_ms"), F.struct(F.col("source_schema").alias("schema"), "lsn").alias("source"),
        image("before_json").alias("before"), image("after_json").alias("after"),
    )
    return c.select(
        "key", F.when(F.col("op") != "t", F.to_json(body)).alias("value"), F.col("kafka_topic").alias("topic"),
        F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), "ingested_at_ms",
    )


SQL_LANDED = """SELECT 'users' AS source_table, op, CAST(day AS VARCHAR) AS dt, count(*) AS n, max(lsn) AS last_lsn FROM {changes} GROUP BY op, day"""


@query(SQL_LANDED)
def landed_records(t: Tables) -> DataFrame:
    """Messages flattened to change records and dated by the event."""
    messages = topic(t).where(F.col("value").isNotNull())
    flat = landing.with_day(landing.flatten(messages))
    return plain(flat.groupBy("source_table", "op", "dt").agg(F.count("*").alias("n"), F.max("lsn").alias("last_lsn")))


def positioned(text: str) -> str:
    """SQL for a text with ``%`` for the row's position."""
    parts = text.replace("%", "\0%\0").split("\0")
    return " || ".join("CAST(lsn AS STRING)" if p == "%" else f"'{p}'" for p in parts if p)


def envelope(*fields: str) -> str:
    return positioned("{" + ",".join(fields) + "}")


#: A message and the record that it becomes, by position: the operation, table, transaction, payloads.
SOURCE, AFTER, ROW = '"source":{"schema":"public","table":"users","lsn":%,"txId":%}', '"after":{"b": %, "a":{"d":"é","c":[2,{"z":1,"y":null}]}}', '{"a":{"c":[2,{"y":null,"z":1}],"d":"é"},"b":%}'
ENVELOPES = [
    (envelope('"op":"u"', '"ts_ms":%', SOURCE, '"before":null', AFTER), "'u'", "'users'", "nullif(lsn, 0)", "NULL", positioned(ROW)),
    (envelope('"ts_ms":%', SOURCE, AFTER), "'?'", "'users'", "nullif(lsn, 0)", "NULL", positioned(ROW)),
    (envelope('"op":""', '"ts_ms":%', SOURCE, '"before":{"y":1.50,"x":"1.50"}'), "'?'", "'users'", "nullif(lsn, 0)", """'{"x":"1.50","y":1.5}'""", "NULL"),
    (envelope('"op":"c"', '"ts_ms":%', '"source":{"lsn":"%"}', AFTER), "'c'", "'orders'", "NULL", "NULL", positioned(ROW)),
    (envelope('"op":"d"', '"ts_ms":%', '"source":{"table":"users","txId":0}', '"transaction":{"id":"%:99"}'), "'d'", "'users'", "nullif(lsn, 0)", "NULL", "NULL"),
    (positioned("no {json %"), "'!'", "'dead_letters'", "NULL", "NULL", positioned("no {json %")),
    ("NULL", "'t'", "'orders'", "NULL", "NULL", "NULL"),
    (envelope('"op":"r"', '"source":null', '"after":{"k":[]}'), "'r'", "'plain'", "NULL", "NULL", positioned('{"k":[]}')),
]


def by_position(k: int) -> str:
    return "CASE lsn % 8 " + " ".join(f"WHEN {n} THEN {e[k]}" for n, e in enumerate(ENVELOPES)) + " END"


def braced(sql: str) -> str:
    """Braces as ``oracle`` leaves them."""
    return sql.replace("{", "{{").replace("}", "}}")


@query(f"""SELECT lsn AS kafka_offset, {by_position(1)} AS op, {by_position(2)} AS source_table, CAST({by_position(3)} AS BIGINT) AS tx_id,
    {braced(by_position(4))} AS before_json, {braced(by_position(5))} AS after_json, CASE WHEN lsn % 8 < 5 THEN lsn END AS event_ts_ms,
    CASE WHEN lsn % 8 < 4 THEN lsn END AS lsn FROM {{changes}}""")
def landed_envelopes(t: Tables) -> DataFrame:
    """Odd envelopes flattened: nested keys out of order, no operation, tables and transactions named elsewhere, values
    that are no JSON, tombstones, short topics."""
    name = F.expr("CASE WHEN lsn % 8 = 7 THEN 'plain' ELSE 'cdc.public.orders' END")
    messages = t["changes"].select(
        F.lit(None).cast("string").alias("key"), F.expr(by_position(0)).alias("value"), name.alias("topic"), F.lit(0).alias("partition"),
        F.col("lsn").alias("offset"), F.lit(0).cast("long").alias("ingested_at_ms"),
    )
    flat = landing.flatten(messages)
    return flat.select("kafka_offset", "op", "source_table", "tx_id", "before_json", "after_json", "event_ts_ms", "lsn")


@query(SQL_LANDED)
def landing_stream(t: Tables) -> DataFrame:
    """The topic landed by a stream that drains it, stopped and started again, then compacted."""
    spark = t["changes"].sparkSession
    root = scratch_dir(spark, "landing")
    topic(t).write.parquet(f"{root}/topic")
    for _ in range(2):  # the second run finds nothing new
        landing.land(landing.file_messages(spark, f"{root}/topic"), f"{root}/landed", f"{root}/checkpoint").awaitTermination()
    sources.compact_files(spark.read.parquet(f"{root}/landed"), f"{root}/compacted")
    packed = spark.read.parquet(f"{root}/compacted").where("op <> 't'")
    return plain(packed.groupBy("source_table", "op", "dt").agg(F.count("*").alias("n"), F.max("lsn").alias("last_lsn")))


@query(f"""SELECT CAST(1 AS BIGINT) AS number, count(*) AS n_rows, count(DISTINCT kind) AS n_kinds FROM ({sql_newest("lsn <= " + SQL_HALF)}) a WHERE op <> 'd'
    UNION ALL SELECT CAST(2 AS BIGINT), count(*), count(DISTINCT kind) FROM ({SQL_CURRENT}) b""")
def published_versions(t: Tables) -> DataFrame:
    """A snapshot and the reconciled table published one after the other, each read back by its number."""
    spark = t["changes"].sparkSession
    root = scratch_dir(spark, "versions")
    versions.publish(changelog.from_snapshot(snapshot(t, boundary(t))), root, note={"boundary": boundary(t)})
    versions.publish(current(t), root)
    parts = [
        versions.read_version(spark, root, n).agg(F.lit(n).cast("long").alias("number"), F.count("*").alias("n_rows"), F.count_distinct("kind").alias("n_kinds"))
        for n in (1, 2)
    ]
    return parts[0].unionByName(parts[1])


@query(f"""SELECT CAST(1 AS BIGINT) AS number, 'create' AS operation, (SELECT count(*) FROM ({sql_newest("lsn <= " + SQL_HALF)}) a WHERE op <> 'd') AS n_rows,
      'r1' AS run_id, {SQL_HALF} AS applied_lsn, true AS timed
    UNION ALL SELECT CAST(2 AS BIGINT), 'overwrite', (SELECT count(*) FROM ({SQL_CURRENT}) b), 'r1', (SELECT max(lsn) FROM {{changes}}), true""")
def version_history(t: Tables) -> DataFrame:
    """The versions of a table, with the export and the position that each came from."""
    spark, at = t["changes"].sparkSession, boundary(t)
    root = scratch_dir(spark, "versions")
    for df, position in ((changelog.from_snapshot(snapshot(t, at)), at), (current(t), t["changes"].agg(F.max("lsn")).first()[0] or 0)):
        versions.publish(df, root, note={"run_id": "r1", "applied_lsn": position})
    note = lambda name: F.get_json_object("note", f"$.{name}")
    found = versions.versions(spark, root)
    return found.select("number", "operation", "n_rows", note("run_id").alias("run_id"), note("applied_lsn").cast("long").alias("applied_lsn"), F.col("committed_at").isNotNull().alias("timed"))


# ---------------------------------------------------------------- history and as-of joins


def customer_history(t: Tables) -> DataFrame:
    captured = history.capture_versions(t["customer_versions"], "entity_id", ["captured_at", "version_id"], ["status", "priority"])
    made = captured.withColumn("created_at", F.col("captured_at") - F.expr("interval 30 days"))
    return history.type2(made, "entity_id", "captured_at", "created_at", "version_id", "customer")


SQL_VERSIONS = """SELECT * FROM (SELECT *, lag(status) OVER w AS ps, lag(priority) OVER w AS pp FROM {customer_versions}
    WINDOW w AS (PARTITION BY entity_id ORDER BY captured_at, version_id)) x
    WHERE ps IS NULL OR ps <> status OR pp <> priority"""
SQL_FROM = f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity_id ORDER BY captured_at, version_id) = 1
    THEN captured_at - INTERVAL '30' DAY ELSE captured_at END AS valid_from FROM ({SQL_VERSIONS}) v"""
SQL_HISTORY = f"""SELECT *, coalesce(lead(valid_from) OVER w, TIMESTAMP '9999-12-31 00:00:00') AS valid_to, lead(valid_from) OVER w IS NULL AS is_current,
    md5(CAST(entity_id AS VARCHAR) || '|' || CAST(version_id AS VARCHAR) || '-' || strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f')) AS customer_version_key
    FROM ({SQL_FROM}) f WINDOW w AS (PARTITION BY entity_id ORDER BY captured_at, version_id)"""
HISTORY_COLUMNS = ["entity_id", "version_id", "status", "priority", "valid_from", "is_current", "customer_version_key"]


@query(f"SELECT entity_id, version_id, status, priority FROM ({SQL_VERSIONS}) v")
def version_capture(t: Tables) -> DataFrame:
    found = history.capture_versions(t["customer_versions"], "entity_id", ["captured_at", "version_id"], ["status", "priority"])
    return found.select("entity_id", "version_id", "status", "priority")


@query(f"SELECT {', '.join(HISTORY_COLUMNS)}, CASE WHEN NOT is_current THEN valid_to END AS ends FROM ({SQL_HISTORY}) h")
def history_type2(t: Tables) -> DataFrame:
    h = customer_history(t)
    return plain(h.select(*HISTORY_COLUMNS, F.when(~F.col("is_current"), F.col("valid_to")).alias("ends")))


@query(f"""SELECT i.impression_id, coalesce(h.customer_version_key, 'UNKNOWN') AS customer_version_key
    FROM {{impressions}} i LEFT JOIN ({SQL_HISTORY}) h ON i.advertiser_id = CAST(h.entity_id AS VARCHAR)
      AND i.impression_timestamp >= h.valid_from AND i.impression_timestamp < h.valid_to""")
def as_of_join(t: Tables) -> DataFrame:
    h = customer_history(t).withColumn("advertiser_id", F.col("entity_id").cast("string"))
    out = history.as_of_join(t["impressions"], h, "advertiser_id", "impression_timestamp", "customer_version_key", "customer_version_key")
    return out.select("impression_id", "customer_version_key")


SQL_SKEWED = "SELECT impression_id, CASE WHEN CAST(impression_id AS BIGINT) % 3 = 0 THEN '1' ELSE advertiser_id END AS advertiser_id, impression_timestamp FROM {impressions}"


@query(f"""SELECT i.impression_id, coalesce(h.customer_version_key, 'UNKNOWN') AS customer_version_key
    FROM ({SQL_SKEWED}) i LEFT JOIN ({SQL_HISTORY}) h ON i.advertiser_id = CAST(h.entity_id AS VARCHAR)
      AND i.impression_timestamp >= h.valid_from AND i.impression_timestamp < h.valid_to""")
def as_of_merge(t: Tables) -> DataFrame:
    """As-of versions in one sorted pass, with a third of all facts on one key."""
    h = customer_history(t).withColumn("advertiser_id", F.col("entity_id").cast("string"))
    skewed = F.when(F.col("impression_id").cast("long") % 3 == 0, "1").otherwise(F.col("advertiser_id"))
    f = t["impressions"].select("impression_id", skewed.alias("advertiser_id"), "impression_timestamp")
    hot = history.hot_keys(f, "advertiser_id")
    return history.as_of_merge(f, h, "advertiser_id", "impression_timestamp", "customer_version_key", "customer_version_key", hot).select("impression_id", "customer_version_key")


def sql_history_rules(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS history, count(*) AS versions, count(CASE WHEN is_current THEN 1 END) AS current_versions,
      count(CASE WHEN valid_from = valid_to THEN 1 END) AS without_length, count(CASE WHEN next_from IS NOT NULL AND next_from <> valid_to THEN 1 END) AS gaps,
      (SELECT count(*) FROM (SELECT entity_id FROM ({source}) c GROUP BY entity_id HAVING count(CASE WHEN is_current THEN 1 END) <> 1) e) AS not_one_current
      FROM (SELECT *, lead(valid_from) OVER (PARTITION BY entity_id ORDER BY valid_from, valid_to, version_id) AS next_from FROM ({source}) h) x"""


@query(sql_history_rules("whole", SQL_HISTORY) + " UNION ALL " + sql_history_rules("thinned", f"SELECT * FROM ({SQL_HISTORY}) w WHERE version_id % 10 <> 0"))
def history_invariants(t: Tables) -> DataFrame:
    """Rules of a history, and of one from which versions are missing."""
    parts = []
    for name, h in (("whole", customer_history(t)), ("thinned", customer_history(t).where("version_id % 10 <> 0"))):
        totals = h.agg(F.count("*").alias("versions"), F.count_if("is_current").alias("current_versions"), F.count_if(F.col("valid_from") == F.col("valid_to")).alias("without_length"))
        gaps = history.not_contiguous(h, "entity_id", "version_id").agg(F.count("*").alias("gaps"))
        lone = history.not_one_current(h, "entity_id").agg(F.count("*").alias("not_one_current"))
        parts.append(totals.crossJoin(gaps).crossJoin(lone).withColumn("history", F.lit(name)))
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- dimensions


SQL_DATES = {"start_date", "end_date"}
SQL_DECIMALS = {"campaign_budget", "daily_budget", "bid_amount", "floor_price", "target_cpm"}
SQL_NUMBERS = {"min_age": "13", "max_age": "99", "frequency_cap": "0"} | {c: "CAST(0 AS DOUBLE)" for c in SQL_DECIMALS}


def _shown(column: str) -> str:
    kind = "DOUBLE" if column in SQL_DECIMALS else "VARCHAR" if column in SQL_DATES else None
    return f"CAST({column} AS {kind}) AS {column}" if kind else column


def _blank(dim: dims.Dimension, column: str) -> str:
    """The unknown member's value."""
    value = SQL_NUMBERS.get(column, "CAST(NULL AS VARCHAR)" if column in SQL_DATES else f"'{dim.unknown.get(column, 'Unknown')}'")
    return f"{value} AS {column}"


def _dimension(name: str):
    dim = dims.DIMENSIONS[name]
    source = f"{name}s"
    parents = "".join(f", coalesce(md5({natural}), 'UNKNOWN') AS {out}" for out, natural in dim.parents.items())
    blanks = "".join(f", 'UNKNOWN' AS {out}" for out in dim.parents)
    shown = "".join(f", {_shown(a)}" for a in dim.attributes)
    unknown = "".join(f", {_blank(dim, a)}" for a in dim.attributes)
    sql = f"""SELECT md5({dim.natural_key}) AS {dim.key}, {dim.natural_key}{parents}{shown} FROM {{{source}}}
        UNION ALL SELECT 'UNKNOWN', 'UNKNOWN'{blanks}{unknown}"""

    def build(t: Tables) -> DataFrame:
        return doubles(dims.type1(t[source], dim))

    build.__name__ = f"dim_{name}"
    query(sql)(build)


for _name in dims.DIMENSIONS:
    _dimension(_name)


@query("""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM {orders}),
    s AS (SELECT CAST(unnest(generate_series(lo, hi - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS x FROM b)
    SELECT year(x) * 10000 + month(x) * 100 + day(x) AS date_key, CAST(x AS VARCHAR) AS date_day, year(x) AS year_number, quarter(x) AS quarter_number,
      month(x) AS month_number, day(x) AS day_of_month, strftime(x, '%b') AS month_name, strftime(x, '%a') AS day_name,
      isodow(x) AS iso_day_of_week, weekofyear(x) AS iso_week, isoyear(x) AS iso_year, isodow(x) >= 6 AS is_weekend,
      CAST(CAST(date_trunc('month', x) AS DATE) AS VARCHAR) AS month_start, CAST(CAST(date_trunc('quarter', x) AS DATE) AS VARCHAR) AS quarter_start,
      CAST(CAST(date_trunc('year', x) AS DATE) AS VARCHAR) AS year_start, CAST(last_day(x) AS VARCHAR) AS month_end FROM s""")
def dim_date(t: Tables) -> DataFrame:
    bounds = t["orders"].agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return plain(dims.date_dimension(dims.day_spine(bounds, "lo", "hi")))


# ---------------------------------------------------------------- histories of the member tables


def sql_history(name: str) -> str:
    """The versions of a member table, written out step by step."""
    dim, checked = dims.DIMENSIONS[name], history.CHECKED[name]
    pk = dim.natural_key
    state = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in checked)
    return f"""SELECT md5({pk} || '-' || strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f')) AS {name}_version_key, *,
        coalesce(next_at, TIMESTAMP '9999-12-31 00:00:00') AS valid_to, next_at IS NULL AS is_current
      FROM (SELECT *, CASE WHEN captured_at = min(captured_at) OVER (PARTITION BY {pk}) THEN least(created_at, version_at) ELSE version_at END AS valid_from,
          lead(version_at) OVER (PARTITION BY {pk} ORDER BY captured_at) AS next_at
        FROM (SELECT *, max(CASE WHEN deleted_at > updated_at THEN deleted_at ELSE updated_at END)
            OVER (PARTITION BY {pk} ORDER BY captured_at ROWS UNBOUNDED PRECEDING) AS version_at
          FROM (SELECT *, lag(state) OVER (PARTITION BY {pk} ORDER BY captured_at) AS state_before
            FROM (SELECT *, {state} AS state FROM {{{name}s_log}}) a) b
          WHERE state_before IS NULL OR state_before <> state) c) d"""


def entity_history(t: Tables, name: str) -> DataFrame:
    return history.entity_history(t[f"{name}s_log"], dims.DIMENSIONS[name])


def _history(name: str) -> None:
    dim, checked = dims.DIMENSIONS[name], history.CHECKED[name]
    pk = dim.natural_key
    parents = "".join(f", coalesce(md5({natural}), 'UNKNOWN') AS {out}" for out, natural in dim.parents.items())
    blanks = "".join(f", 'UNKNOWN' AS {out}" for out in dim.parents)
    shown = "".join(f", {_shown(c)}" for c in checked)
    unknown = "".join(f", {'false AS is_deleted' if c == 'is_deleted' else _blank(dim, c)}" for c in checked)
    sql = f"""SELECT {name}_version_key, md5({pk}) AS {dim.key}, {pk}{parents}{shown}, valid_from, next_at AS ends, is_current FROM ({sql_history(name)}) h
        UNION ALL SELECT 'UNKNOWN', 'UNKNOWN', CAST(NULL AS VARCHAR){blanks}{unknown}, TIMESTAMP '1900-01-01 00:00:00', CAST(NULL AS TIMESTAMP), true"""

    def build(t: Tables) -> DataFrame:
        h = entity_history(t, name)
        ends = F.when(~F.col("is_current"), F.col("valid_to")).alias("ends")
        return plain(h.select(f"{name}_version_key", dim.key, pk, *dim.parents, *checked, "valid_from", ends, "is_current"))

    build.__name__ = f"history_{name}"
    query(sql)(build)


for _name in history.CHECKED:
    _history(_name)


@query(f"""SELECT campaign_version_key, campaign_id, campaign_status, CAST(daily_budget AS DOUBLE) AS daily_budget, is_deleted, valid_from, next_at AS ends, is_current,
    CAST(5 AS BIGINT) AS published FROM ({sql_history("campaign")}) h""")
def history_growth(t: Tables) -> DataFrame:
    """The campaigns' history grown by one capture after the other, each a published version made from the one before."""
    log, root, dim = t["campaigns_log"], scratch(t, "history"), dims.DIMENSIONS["campaign"]
    spark, before, number = log.sparkSession, None, 0
    for n in range(5):
        now = log.where(F.col("capture") == n)
        number = versions.publish(history.grow_versions(before, now, dim, F.current_timestamp()), root, based_on=number)
        before = versions.read_version(spark, root, number)
    shaped = history.shape_history(before, dim).where(F.col("campaign_id").isNotNull())
    ends = F.when(~F.col("is_current"), F.col("valid_to")).alias("ends")
    return plain(shaped.select("campaign_version_key", "campaign_id", "campaign_status", "daily_budget", "is_deleted", "valid_from", ends, "is_current", F.lit(number).cast("long").alias("published")))


# ---------------------------------------------------------------- facts and marts

SQL_DAY = "year({0}) * 10000 + month({0}) * 100 + day({0})"


def fact_tables(t: Tables) -> Tables:
    return {
        "impressions": facts.impressions(t["impressions"]),
        "clicks": facts.clicks(t["clicks"]),
        "conversions": facts.conversions(t["conversions"]),
        "spend": facts.spend(t["spend_transactions"]),
    }


def sql_versions(fact: str, ts: str, *entities: str) -> tuple[str, str]:
    """The version keys of a fact's entities at its timestamp, and the joins that they come from."""
    keys = "".join(f", coalesce(v_{e}.{e}_version_key, 'UNKNOWN') AS {e}_version_key" for e in entities)
    joins = "".join(
        f" LEFT JOIN ({sql_history(e)}) v_{e} ON {fact}.{e}_id = v_{e}.{e}_id AND {fact}.{ts} >= v_{e}.valid_from AND {fact}.{ts} < v_{e}.valid_to"
        for e in entities
    )
    return keys, joins


def histories(t: Tables, *names: str) -> Tables:
    return {n: history.member_versions(t[f"{n}s_log"], dims.DIMENSIONS[n]) for n in names}


_KEYS, _JOINS = sql_versions("e", "impression_timestamp", "campaign", "line_item")


@query(f"""SELECT md5(e.impression_id) AS impression_key, {SQL_DAY.format("e.impression_timestamp")} AS date_key, md5(e.campaign_id) AS campaign_key,
    coalesce(md5(e.advertiser_id), 'UNKNOWN') AS advertiser_key{_KEYS}, e.operating_system, e.browser, e.city, CAST(e.clearing_price AS DOUBLE) AS clearing_price,
    CAST(CAST(e.clearing_price AS DECIMAL(18,9)) * 0.001 AS DOUBLE) AS impression_cost, CAST(e.viewability_score AS DOUBLE) AS viewability_score
    FROM {{impressions}} e{_JOINS}""")
def fact_impressions(t: Tables) -> DataFrame:
    out = facts.impressions(t["impressions"], histories(t, "campaign", "line_item"))
    return doubles(out.select(
        "impression_key", "date_key", "campaign_key", "advertiser_key", "campaign_version_key", "line_item_version_key",
        "operating_system", "browser", "city", "clearing_price", "impression_cost", "viewability_score",
    ))


_KEYS, _JOINS = sql_versions("e", "click_timestamp", "campaign", "line_item", "creative")


@query(f"""SELECT md5(e.click_id) AS click_key, {SQL_DAY.format("e.click_timestamp")} AS date_key, md5(e.creative_id) AS creative_key{_KEYS},
    e.impression_id, e.device_type, e.country FROM {{clicks}} e{_JOINS}""")
def fact_clicks(t: Tables) -> DataFrame:
    out = facts.clicks(t["clicks"], histories(t, "campaign", "line_item", "creative"))
    return out.select(
        "click_key", "date_key", "creative_key", "campaign_version_key", "line_item_version_key", "creative_version_key", "impression_id",
        "device_type", "country",
    )


_KEYS, _JOINS = sql_versions("e", "conversion_timestamp", "campaign")


@query(f"""SELECT md5(e.conversion_id) AS conversion_key, {SQL_DAY.format("e.conversion_timestamp")} AS date_key, md5(e.campaign_id) AS campaign_key{_KEYS},
    e.conversion_type, CAST(e.conversion_value AS DOUBLE) AS conversion_value, e.currency FROM {{conversions}} e{_JOINS}""")
def fact_conversions(t: Tables) -> DataFrame:
    out = facts.conversions(t["conversions"], histories(t, "campaign"))
    return doubles(out.select("conversion_key", "date_key", "campaign_key", "campaign_version_key", "conversion_type", "conversion_value", "currency"))


_KEYS, _JOINS = sql_versions("e", "spend_timestamp", "campaign", "line_item")


@query(f"""SELECT md5(e.spend_transaction_id) AS spend_key, {SQL_DAY.format("e.spend_timestamp")} AS date_key, md5(e.publisher_id) AS publisher_key{_KEYS},
    e.impression_id, e.billing_type, CAST(e.spend_amount AS DOUBLE) AS spend_amount FROM {{spend_transactions}} e{_JOINS}""")
def fact_spend(t: Tables) -> DataFrame:
    out = facts.spend(t["spend_transactions"], histories(t, "campaign", "line_item"))
    return doubles(out.select(
        "spend_key", "date_key", "publisher_key", "campaign_version_key", "line_item_version_key", "impression_id", "billing_type", "spend_amount",
    ))


@query(f"""SELECT campaign_version_key, count(*) AS n FROM (SELECT coalesce(h.campaign_version_key, 'UNKNOWN') AS campaign_version_key
      FROM {{clicks}} k LEFT JOIN (SELECT * FROM ({sql_history("campaign")}) w WHERE campaign_status <> 'DRAFT') h ON k.campaign_id = h.campaign_id AND k.click_timestamp >= h.valid_from
        AND k.click_timestamp < h.valid_to) x WHERE campaign_version_key = 'UNKNOWN' GROUP BY 1""")
def unresolved_versions(t: Tables) -> DataFrame:
    """Clicks that no version covers where versions in draft are left out of the history."""
    known = entity_history(t, "campaign").where("campaign_status <> 'DRAFT'")
    return facts.unresolved(facts.clicks(t["clicks"], {"campaign": known}), "campaign_version_key")


@query("""SELECT md5(k.click_id) AS click_key, coalesce(md5(i.publisher_id), 'UNKNOWN') AS publisher_key, coalesce(md5(i.audience_id), 'UNKNOWN') AS audience_key,
    i.currency, date_diff('second', i.impression_timestamp, k.click_timestamp) AS seconds_to_click
    FROM {clicks} k LEFT JOIN {impressions} i ON k.impression_id = i.impression_id""")
def resolved_clicks(t: Tables) -> DataFrame:
    f = fact_tables(t)
    out = facts.resolve_clicks(f["clicks"], f["impressions"])
    return out.select("click_key", "publisher_key", "audience_key", "currency", "seconds_to_click")


@query("""SELECT md5(v.conversion_id) AS conversion_key, coalesce(md5(i.line_item_id), 'UNKNOWN') AS line_item_key, coalesce(md5(i.creative_id), 'UNKNOWN') AS creative_key,
    coalesce(md5(i.placement_id), 'UNKNOWN') AS placement_key, CAST(floor(date_diff('minute', i.impression_timestamp, v.conversion_timestamp) / 60) AS BIGINT) AS hours_to_conversion
    FROM {conversions} v LEFT JOIN {impressions} i ON v.impression_id = i.impression_id""")
def resolved_conversions(t: Tables) -> DataFrame:
    f = fact_tables(t)
    out = facts.resolve_conversions(f["conversions"], f["impressions"])
    return out.select("conversion_key", "line_item_key", "creative_key", "placement_key", "hours_to_conversion")


def mart_rows(t: Tables) -> Tables:
    return facts.by_member(t["impressions"], t["clicks"], t["conversions"], t["spend_transactions"])


SQL_PARTS = {
    "impressions": ("impressions", "impression_timestamp", "count(*) AS impressions, count(viewability_score) AS measured_impressions, sum(CASE WHEN viewability_score >= 0.5 THEN 1 ELSE 0 END) AS viewable_impressions, sum(CAST(clearing_price AS DECIMAL(18,9)) * 0.001) AS clearing_cost"),
    "clicks": ("clicks", "click_timestamp", "count(*) AS clicks"),
    "conversions": ("conversions", "conversion_timestamp", "count(*) AS conversions, sum(conversion_value) AS conversion_value"),
    "spend": ("spend_transactions", "spend_timestamp", "sum(spend_amount) AS spend, sum(CASE WHEN billing_type = 'CPM' THEN spend_amount ELSE 0 END) AS cpm_spend, sum(CASE WHEN billing_type = 'CPC' THEN spend_amount ELSE 0 END) AS cpc_spend, sum(CASE WHEN billing_type = 'CPA' THEN spend_amount ELSE 0 END) AS cpa_spend"),
}
MEASURES = {
    "impressions": ["impressions", "measured_impressions", "viewable_impressions", "clearing_cost"],
    "clicks": ["clicks"],
    "conversions": ["conversions", "conversion_value"],
    "spend": ["spend", "cpm_spend", "cpc_spend", "cpa_spend"],
}


#: Distinct counts that a mart adds: name and the entity counted.
ACTIVES = {"publisher": {"active_placements": "placement"}, "audience": {"active_campaigns": "campaign"}}


def sql_mart(entity: str, parts: list[str]) -> str:
    """Facts aggregated one by one, a spine, left joins, rates."""
    actives = ACTIVES.get(entity, {})
    ctes, joins = [], ""
    for p in parts:
        table, ts, measures = SQL_PARTS[p]
        source = f"{{{table}}} f"
        column, currency = f"f.{entity}_id", "f.currency"
        if p in ("clicks", "conversions"):
            source += " LEFT JOIN {impressions} i ON f.impression_id = i.impression_id"
            column = f"i.{entity}_id"
            currency = "i.currency"
        if p == "impressions":
            measures += "".join(f", count(DISTINCT f.{e}_id) AS {name}" for name, e in actives.items())
        ctes.append(
            f"p_{p} AS (SELECT {SQL_DAY.format('f.' + ts)} AS date_key, md5({column}) AS {entity}_key, {currency} AS currency, {measures} FROM {source} GROUP BY 1, 2, 3)"
        )
        joins += f" LEFT JOIN p_{p} USING (date_key, {entity}_key, currency)"
    spine = " UNION ".join(f"SELECT date_key, {entity}_key, currency FROM p_{p}" for p in parts)
    names = [m for p in parts for m in MEASURES[p]]
    names += actives
    shown = ", ".join(f"CAST(coalesce({m}, 0) AS DOUBLE) AS {m}" for m in names)
    rates = "".join(
        f", CASE WHEN coalesce({b}, 0) <> 0 THEN round(CAST(coalesce({a}, 0) AS DOUBLE) / CAST({b} AS DOUBLE) * {factor}, 8) END AS {r}"
        for r, (a, b, factor) in marts.RATES.items()
        if a in names and b in names
    )
    return f"WITH {', '.join(ctes)}, spine AS ({spine}) SELECT date_key, {entity}_key, currency, {shown}{rates} FROM spine{joins}"


def rows_expected(t: Tables, n_facts: int) -> int:
    """At most so many rows do the facts of a mart have; the count comes from the files' footers."""
    return n_facts * t["lineitem"].count()


#: Members that see few events a day: their marts have almost as many keys as rows.
SPARSE = {"campaign", "publisher", "creative"}


def build_mart(t: Tables, entity: str, parts: list[str], found: Tables | None = None, gather: dict | None = None) -> DataFrame:
    """The mart of a member's days, added up by the member's own id; its key is made of what is left. ``gather`` names
    columns, functions of the keys, by which rows are brought together in place of the keys."""
    r = found or mart_rows(t)
    keys = ["date_key", f"{entity}_id", "currency", *(gather or {})]
    kinds = [k for k in ("click", "conversion") if f"{k}s" in parts]
    of = lambda kind: (F.col("kind") == kind).cast("long")
    counts = {"click": {"clicks": of("click")}, "conversion": {"conversions": of("conversion"), "conversion_value": F.col("conversion_value")}}
    actives = {name: f"{e}_id" for name, e in ACTIVES.get(entity, {}).items()}
    made = []
    if "impressions" in parts:
        made.append(marts.Part(r["impressions"], marts.impression_measures(), actives))
    if kinds:
        made.append(marts.Part(r["responses"].where(F.col("kind").isin(kinds)), reduce(lambda a, b: a | b, [counts[k] for k in kinds])))
    if "spend" in parts:
        made.append(marts.Part(r["spend"], marts.spend_measures()))
    if gather:
        made = [marts.Part(p.fact.withColumns(gather), p.measures, p.distinct) for p in made]
    together = [*(gather or keys)] if gather or entity in SPARSE else None
    mart = marts.build(made, keys, together, rows_expected(t, len(made)) if together else 0)
    key = S.or_unknown(dims.surrogate_key_or_null(f"{entity}_id")).alias(f"{entity}_key")
    return mart.select("date_key", key, "currency", *[c for c in mart.columns if c not in keys])


def all_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("double").alias(n) if k == "bigint" or k.startswith("decimal") else F.col(n) for n, k in df.dtypes])


ALL = ["impressions", "clicks", "conversions", "spend"]
MARTS = {"campaign": ALL, "publisher": ALL, "creative": ALL[:3], "audience": ALL[:3]}
#: Every fact derives from this one.
DELIVERY = ("delivery",)


@query(sql_mart("campaign", ALL), written=DELIVERY)
def mart_campaign_daily(t: Tables) -> DataFrame:
    return all_doubles(marts.with_rates(build_mart(t, "campaign", ALL)))


@query(sql_mart("publisher", ALL), written=DELIVERY)
def mart_publisher_daily(t: Tables) -> DataFrame:
    return all_doubles(marts.with_rates(build_mart(t, "publisher", ALL)))


@query(sql_mart("creative", ALL[:3]), written=DELIVERY)
def mart_creative_daily(t: Tables) -> DataFrame:
    return all_doubles(marts.with_rates(build_mart(t, "creative", ALL[:3])))


@query(sql_mart("audience", ALL[:3]), written=DELIVERY)
def mart_audience_daily(t: Tables) -> DataFrame:
    return all_doubles(marts.with_rates(build_mart(t, "audience", ALL[:3])))


@query(f"""SELECT {SQL_DAY.format("impression_timestamp")} AS date_key, md5(publisher_id) AS publisher_key, currency, count(DISTINCT placement_id) AS active_placements,
    count(DISTINCT campaign_id) AS active_campaigns FROM {{impressions}} GROUP BY 1, 2, 3""")
def mart_distinct_actives(t: Tables) -> DataFrame:
    """Distinct counts, which are not additive, at the mart's grain."""
    f = mart_rows(t)["impressions"]
    actives, keys = {"active_placements": "placement_id", "active_campaigns": "campaign_id"}, ["date_key", "publisher_id", "currency"]
    found = marts.build([marts.Part(f, {}, actives)], keys, keys, rows_expected(t, 1))
    key = S.or_unknown(dims.surrogate_key_or_null("publisher_id")).alias("publisher_key")
    return found.select("date_key", key, "currency", *actives)


@query(f"""SELECT m.publisher_key, m.month_key, m.currency, {d("m.impressions", "impressions")}, {d("m.clicks", "clicks")}, round(CAST(clicks AS DOUBLE) / CAST(impressions AS DOUBLE) * 1, 8) AS click_through_rate
    FROM (SELECT md5(i.publisher_id) AS publisher_key, year(i.impression_timestamp) * 100 + month(i.impression_timestamp) AS month_key, i.currency, count(*) AS impressions,
      sum(CASE WHEN k.click_id IS NOT NULL THEN 1 ELSE 0 END) AS clicks
      FROM {{impressions}} i LEFT JOIN {{clicks}} k ON i.impression_id = k.impression_id GROUP BY 1, 2, 3) m""")
def mart_monthly(t: Tables) -> DataFrame:
    """Months from daily components; rates come anew."""
    daily = build_mart(t, "publisher", ["impressions", "clicks"]).withColumn("month_key", F.floor(F.col("date_key") / 100).cast("long"))
    out = marts.reaggregate(daily, ["publisher_key", "month_key", "currency"], ["impressions", "clicks"])
    return out.select("publisher_key", "month_key", "currency", F.col("impressions").cast("double").alias("impressions"), F.col("clicks").cast("double").alias("clicks"), "click_through_rate")


SQL_TOTALS = {
    "impressions": "SELECT count(*) FROM {impressions}",
    "clicks": "SELECT count(*) FROM {clicks}",
    "conversions": "SELECT count(*) FROM {conversions}",
    "clearing_cost": "SELECT sum(CAST(clearing_price AS DECIMAL(18,9)) * 0.001) FROM {impressions}",
    "conversion_value": "SELECT sum(conversion_value) FROM {conversions}",
    "spend": "SELECT sum(spend_amount) FROM {spend_transactions}",
}


def sql_drift() -> str:
    """Every mart's totals beside those of the facts, taken from the facts alone."""
    parts = []
    for entity, held in MARTS.items():
        names = [n for n in SQL_TOTALS if n != "spend" or "spend" in held]
        totals = ", ".join(f"sum({n}) AS {n}" for n in names)
        rows = " UNION ALL ".join(
            f"SELECT '{entity}' AS mart, '{n}' AS name, round(CAST({n} AS DOUBLE), 2) AS mart_total, round(CAST(({SQL_TOTALS[n]}) AS DOUBLE), 2) AS fact_total FROM m"
            for n in names
        )
        parts.append(f"SELECT * FROM (WITH m AS (SELECT {totals} FROM ({sql_mart(entity, held)}) y) {rows}) x")
    return " UNION ALL ".join(parts)


@query(sql_drift(), written=DELIVERY)
def mart_reconciles(t: Tables) -> DataFrame:
    """Totals of all marts against the facts; a mart that multiplied or lost rows shows here."""
    f = fact_tables(t)
    sides = {
        "impressions": (f["impressions"], F.count("*")), "clicks": (f["clicks"], F.count("*")), "conversions": (f["conversions"], F.count("*")),
        "clearing_cost": (f["impressions"], F.sum("impression_cost")), "conversion_value": (f["conversions"], F.sum("conversion_value")),
        "spend": (f["spend"], F.sum("spend_amount")),
    }
    found = mart_rows(t)
    found["responses"] = cut(found["responses"], "responses")  # every mart reads them
    parts = [
        marts.drift(build_mart(t, e, held, found), {n: v for n, v in sides.items() if n != "spend" or "spend" in held}).withColumn("mart", F.lit(e))
        for e, held in MARTS.items()
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.select("mart", "name", *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("mart_total", "fact_total")])


@query(" UNION ".join(
    f"SELECT {SQL_DAY.format('f.' + SQL_PARTS[p][1])} AS date_key, md5(f.campaign_id) AS campaign_key FROM {{{SQL_PARTS[p][0]}}} f" for p in ALL
), written=DELIVERY)
def mart_grain(t: Tables) -> DataFrame:
    """Every day and campaign that any fact holds."""
    return marts.grain_of(list(fact_tables(t).values()), ["date_key", "campaign_key"])


#: A mart with planted faults: rows of some days carry a rate too many, too much spend, or too many viewable impressions.
SQL_FAULTY = f"""SELECT * REPLACE (CASE WHEN date_key % 7 = 0 THEN spend + 1 ELSE spend END AS spend,
      CASE WHEN date_key % 5 = 0 THEN measured_impressions + 1 ELSE viewable_impressions END AS viewable_impressions,
      CASE WHEN date_key % 3 = 0 THEN 0.5 ELSE click_through_rate END AS click_through_rate) FROM ({sql_mart("campaign", ALL)}) y"""


def sql_invariants(mart: str, source: str) -> str:
    rates = [r for r, (a, b, _) in marts.RATES.items()]
    rules = {
        "spend_not_sum_of_types": "abs(spend - cpm_spend - cpc_spend - cpa_spend) > 0.0000001",
        "viewable_above_measured": "viewable_impressions > measured_impressions",
        "measured_above_impressions": "measured_impressions > impressions",
    } | {f"{r}_without_denominator": f"({r} IS NULL) <> ({marts.RATES[r][1]} = 0)" for r in rates}
    return f"SELECT '{mart}' AS mart, " + ", ".join(f"count(CASE WHEN {v} THEN 1 END) AS {k}" for k, v in rules.items()) + f" FROM ({source}) z"


@query(sql_invariants("campaign", sql_mart("campaign", ALL)) + " UNION ALL " + sql_invariants("faulty", SQL_FAULTY), written=DELIVERY)
def mart_invariants(t: Tables) -> DataFrame:
    """Rules of the campaign mart, and of a copy with planted faults."""
    m = marts.with_rates(build_mart(t, "campaign", ALL))
    day = F.col("date_key")
    faulty = m.select(*[
        F.when(day % 7 == 0, m["spend"] + 1).otherwise(m["spend"]).alias(c) if c == "spend"
        else F.when(day % 5 == 0, m["measured_impressions"] + 1).otherwise(m[c]).alias(c) if c == "viewable_impressions"
        else F.when(day % 3 == 0, 0.5).otherwise(m[c]).alias(c) if c == "click_through_rate"
        else m[c]
        for c in m.columns
    ])
    both = [marts.broken_invariants(x).withColumn("mart", F.lit(n)) for n, x in (("campaign", m), ("faulty", faulty))]
    return both[0].unionByName(both[1])


@query(sql_mart("campaign", ALL), written=DELIVERY)
def mart_increment(t: Tables) -> DataFrame:
    """The campaign mart as of a time when the newest days had only half of their events, then the months of its
    trailing days computed anew and put in the place of the old ones."""
    spark = t["impressions"].sparkSession
    path = scratch_dir(spark, "mart")
    r = {n: f.withColumn("late", F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0) for n, f in mart_rows(t).items()}
    newest = reduce(DataFrame.unionAll, [f.select("date_key") for f in fact_tables(t).values()]).agg(F.max("date_key")).first()[0]
    if newest is None:
        return all_doubles(marts.with_rates(build_mart(t, "campaign", ALL)))
    floor = spark.range(1).select(S.date_key_lookback(F.lit(newest), 3)).first()[0] // 100 * 100
    early = {n: f.where(~F.col("late") | (F.col("date_key") < floor)) for n, f in r.items()}
    again = {n: f.where(F.col("date_key") >= floor) for n, f in r.items()}
    # Rows lie together by month and a share of the campaigns when they are added up, and are written from there; there
    # are as many shares as keep a month's files from being small.
    shares = 1 + rows_expected(t, len(ALL)) // marts.ROWS_TOGETHER // 64
    month, share = F.floor(F.col("date_key") / 100).cast("long"), F.pmod(F.xxhash64("campaign_id"), F.lit(shares))
    for rows in (early, again):
        mart = build_mart(t, "campaign", ALL, rows, {"month": month, "share": share})
        merge.overwrite_days(mart.withColumn("month_key", F.floor(F.col("date_key") / 100)), path, "month_key", gathered=True)
    return all_doubles(marts.with_rates(spark.read.parquet(path).drop("month_key")))


@query(f"""WITH k AS (SELECT {SQL_DAY.format("impression_timestamp")} AS date_key, impression_timestamp FROM {{impressions}})
    SELECT date_key, count(*) AS n FROM k WHERE CAST(impression_timestamp AS DATE) >= (SELECT CAST(max(impression_timestamp) AS DATE) - INTERVAL '3' DAY FROM k) GROUP BY date_key""")
def mart_trailing_days(t: Tables) -> DataFrame:
    f = facts.impressions(t["impressions"])
    return merge.trailing_days(f, "date_key", 3).groupBy("date_key").agg(F.count("*").alias("n"))


SQL_STAMPED = """SELECT impression_id, clearing_price, CASE WHEN CAST(impression_id AS BIGINT) % 50 <> 0 THEN impression_timestamp END AS stamp FROM {impressions}"""


@query(f"""SELECT CAST(CAST(stamp AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT impression_id) AS n_ids, {d("sum(clearing_price)", "clearing")},
    CAST(0 AS BIGINT) AS inserted_again, true AS pruned FROM ({SQL_STAMPED}) e GROUP BY CAST(stamp AS DATE)""")
def fact_increment(t: Tables) -> DataFrame:
    """A stored fact loaded in three runs: what was there a month before the end, all from its newest time on, and
    the same again. Every fiftieth row has no time; rows at the newest time come twice and are merged."""
    spark, path = t["impressions"].sparkSession, scratch(t, "fact")
    stamped = F.when(F.col("impression_id").cast("long") % 50 != 0, F.col("impression_timestamp")).alias("stamp")
    # Read by each of the three runs.
    rows = cut(t["impressions"].select("impression_id", "clearing_price", stamped).withColumn("month", F.date_trunc("month", "stamp").cast("date")), "stamped")
    until = rows.agg(F.max("stamp").alias("hi")).select(F.col("hi") - F.expr("interval 30 days")).first()[0]
    early = rows.where(F.col("stamp").isNull() | (F.col("stamp") <= F.lit(until)))
    found = [stored.load_increment(source, path, "impression_id", "stamp", "month") for source in (early, rows, rows)]
    loaded = stored.read_stored(spark, path, rows)
    counts = loaded.groupBy(F.to_date("stamp").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("impression_id").alias("n_ids"), F.sum("clearing_price").alias("clearing"))
    again, pruned = F.lit(found[2].inserted).cast("long"), F.lit(found[2].rows_read < sum(x.inserted for x in found) or found[0].merged == 0)
    return plain(doubles(counts.select("*", again.alias("inserted_again"), pruned.alias("pruned"))))


@query(f"""WITH p AS (SELECT *, {SQL_DAY.format("impression_timestamp")} AS date_key FROM {{impressions}}),
    c AS (SELECT * FROM {{clicks}} WHERE click_timestamp >= TIMESTAMP '2000-01-01 00:00:00')
    SELECT date_key, count(*) AS n FROM p WHERE CAST(impression_timestamp AS DATE) >= (SELECT CAST(min(click_timestamp) AS DATE) - INTERVAL '1' DAY FROM c) GROUP BY date_key""")
def resolution_window(t: Tables) -> DataFrame:
    f = fact_tables(t)
    batch = f["clicks"].where(F.col("click_timestamp") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return merge.resolution_window(batch, f["impressions"], "date_key", 1).groupBy("date_key").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT campaign_id, currency, count(*) AS n, sum(clearing_price) AS price FROM {impressions} GROUP BY campaign_id, currency)
    SELECT c.campaign_id, a.advertiser_name, a.industry, i.currency, CAST(i.n AS BIGINT) AS impressions, CAST(i.price AS DOUBLE) AS clearing
    FROM i LEFT JOIN {campaigns} c ON i.campaign_id = c.campaign_id LEFT JOIN {advertisers} a ON c.advertiser_id = a.advertiser_id""")
def star_lookup(t: Tables) -> DataFrame:
    f = facts.impressions(t["impressions"]).groupBy("campaign_key", "currency").agg(F.count("*").alias("impressions"), F.sum("clearing_price").alias("clearing"))
    out = marts.look_up(f, dims.type1(t["campaigns"], dims.CAMPAIGN), "campaign_key", ["campaign_id", "advertiser_key"])
    out = marts.look_up(out, dims.type1(t["advertisers"], dims.ADVERTISER), "advertiser_key", ["advertiser_name", "industry"])
    return doubles(out.select("campaign_id", "advertiser_name", "industry", "currency", "impressions", "clearing"))


# ---------------------------------------------------------------- billing

SQL_CPM, SQL_CPC, SQL_CPA = (
    f"(SELECT campaign_id FROM {{campaigns}} WHERE bid_strategy IN ({kinds}))" for kinds in ("'CPM'", "'CPC'", "'CPA', 'TARGET_ROAS', 'MAX_CONVERSIONS'")
)


@query(f"""SELECT campaign_id, line_item_id, publisher_id, currency, date_trunc('hour', impression_timestamp) AS spend_timestamp,
    {d("sum(CAST(clearing_price AS DECIMAL(18,9)) * 0.001)", "spend_amount")}, count(*) AS impressions,
    least(date_trunc('hour', impression_timestamp) + INTERVAL '1' HOUR, TIMESTAMP '2001-01-01 00:30:00') AS created_at
    FROM {{impressions}} WHERE campaign_id IN {SQL_CPM} GROUP BY campaign_id, line_item_id, publisher_id, currency, date_trunc('hour', impression_timestamp)""")
def billing_hourly_cpm(t: Tables) -> DataFrame:
    return plain(billing.hourly_cpm(t["impressions"], t["campaigns"], F.lit("2001-01-01 00:30:00").cast("timestamp_ntz")))


@query(f"""SELECT impression_id, campaign_id, line_item_id, {d('CAST(clearing_price AS DECIMAL(18,9)) * 0.001', 'spend_amount')} FROM {{impressions}}
    WHERE campaign_id IN {SQL_CPM}""")
def billing_per_impression(t: Tables) -> DataFrame:
    return doubles(billing.per_impression(t["impressions"], t["campaigns"]))


@query(f"""SELECT k.click_id, k.campaign_id, k.line_item_id, 'CPC' AS billing_type, {d("l.bid_amount", "spend_amount")}, l.bid_currency AS currency
    FROM {{clicks}} k JOIN {{line_items}} l ON k.line_item_id = l.line_item_id WHERE k.campaign_id IN {SQL_CPC}""")
def billing_cpc(t: Tables) -> DataFrame:
    return doubles(billing.per_event(t["clicks"], t["campaigns"], t["line_items"], "CPC", "click_id"))


@query(f"""SELECT v.conversion_id, v.campaign_id, v.line_item_id, 'CPA' AS billing_type, {d("l.bid_amount", "spend_amount")}, l.bid_currency AS currency
    FROM {{conversions}} v JOIN {{line_items}} l ON v.line_item_id = l.line_item_id WHERE v.campaign_id IN {SQL_CPA}""")
def billing_cpa(t: Tables) -> DataFrame:
    return doubles(billing.per_event(t["conversions"], t["campaigns"], t["line_items"], "CPA", "conversion_id"))


# ---------------------------------------------------------------- quality


def bases(t: Tables, names: set[str]) -> Tables:
    out = {}
    for name in names & set(checks.BASES):
        text = checks.NARROWED.get(name, checks.BASES[name])
        used = {n: t[n] for n in t if "{" + n + "}" in text}
        out[name] = next(iter(used.values())).sparkSession.sql(text, **used)
    return out


def _family(name: str, family: list) -> None:
    def run(t: Tables) -> DataFrame:
        others = {c.base for c in family} - set(checks.RELATIONS) - set(checks.EACH)
        if name == "referential":  # these ask for every parent
            with brief_shuffles(t["orders"].sparkSession):
                return quality.observe_apart(family, t, checks.RELATIONS, checks.EACH, bases(t, others))
        return quality.observe_scans(family, t, checks.RELATIONS, checks.EACH, bases(t, others))

    run.__name__ = f"checks_{name}"
    written = DELIVERY if name != "source_reconciliation" else ()
    # These ask line items for their times, so that partial sums are as large as the rows and are moved again for each join.
    query(checks.as_sql(family, checks.BASES), written=written, dealt=("line_items",) if name == "temporal" else ())(run)


for _name, _checks in (
    ("referential", checks.REFERENTIAL), ("temporal", checks.TEMPORAL), ("business", checks.BUSINESS),
    ("uniqueness", checks.UNIQUENESS), ("join_presence", checks.JOINS), ("row_rules", checks.ROW_RULES),
    ("all_tables", checks.ALL_TABLES), ("source_reconciliation", checks.RECONCILIATION),
):
    _family(_name, _checks)

SQL_SILVER = {
    "s_state": f"SELECT *, {SQL_HALF} AS boundary FROM ({SQL_CURRENT}) c",
    "s_keys": f"SELECT user_id, count(*) AS n FROM ({SQL_CURRENT}) c GROUP BY user_id",
    "s_events": """SELECT CAST(impression_id AS BIGINT) % 997 = 0 AS is_deleted, CASE WHEN CAST(impression_id AS BIGINT) % 499 = 0 THEN 7 END AS _lsn FROM {impressions}
      UNION ALL SELECT false, CAST(NULL AS BIGINT) FROM {clicks} UNION ALL SELECT false, CAST(NULL AS BIGINT) FROM {conversions}""",
    "b_impression_ids": checks.BASES["b_impression_ids"],
}


@query(checks.as_sql(checks.INTEGRITY + checks.LINEAGE, SQL_SILVER))
def checks_current_state(t: Tables) -> DataFrame:
    state, at = current(t), boundary(t)
    exported = {n: changelog.from_snapshot(t[n]) for n in ("impressions", "clicks", "conversions")}
    number = F.col("impression_id").cast("long")
    exported["impressions"] = exported["impressions"].withColumns({"is_deleted": number % 997 == 0, "_lsn": F.when(number % 499 == 0, F.lit(7)).cast("long")})
    own = {
        "s_state": state.withColumn("boundary", F.lit(at)),
        "s_keys": state.groupBy("user_id").agg(F.count("*").alias("n")),
        # Event tables come from exports alone; some impressions were merged and deleted all the same.
        "s_events": reduce(DataFrame.unionAll, [events.select("is_deleted", "_lsn") for events in exported.values()]),
    }
    return quality.observe(checks.INTEGRITY + checks.LINEAGE, own | bases(t, {"b_impression_ids"}))


@query("""WITH a AS (SELECT * FROM {orders}), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 101 <> 0)
    SELECT (SELECT count(*) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) AS missing_right, 0 AS missing_left,
      (SELECT count(*) FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus <> b.o_orderstatus) AS different""")
def checks_reconciliation(t: Tables) -> DataFrame:
    """A source and a copy with planted differences, compared both ways."""
    a = t["orders"]
    b = a.where("o_orderkey % 101 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")))
    return quality.compare_systems(a, b, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice"])


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def test_unique_combination(t: Tables) -> DataFrame:
    return quality.unique(t["lineitem"], "l_orderkey", "l_linenumber")


@query("""SELECT impression_id, creative_id FROM {impressions} WHERE creative_id NOT IN (SELECT creative_id FROM {creatives} WHERE creative_type <> 'AUDIO')""")
def test_relationships(t: Tables) -> DataFrame:
    parents = t["creatives"].where("creative_type <> 'AUDIO'")
    return quality.relationships(t["impressions"].select("impression_id", "creative_id"), "creative_id", parents, "creative_id")


@query("""SELECT campaign_id FROM {campaigns} WHERE campaign_status NOT IN ('ACTIVE', 'PAUSED')""")
def test_accepted_values(t: Tables) -> DataFrame:
    return quality.accepted_values(t["campaigns"], "campaign_status", ["ACTIVE", "PAUSED"]).select("campaign_id")


@query("""SELECT spend_transaction_id FROM {spend_transactions} WHERE NOT (spend_amount >= 1.5)""")
def test_expression_is_true(t: Tables) -> DataFrame:
    return quality.expression_is_true(t["spend_transactions"], "spend_amount >= 1.5").select("spend_transaction_id")


@query("""SELECT impression_id FROM {impressions} WHERE viewability_score IS NULL""")
def test_not_null(t: Tables) -> DataFrame:
    return quality.not_null(t["impressions"], "viewability_score").select("impression_id")


@query("""SELECT hours_to_conversion, count(*) AS n FROM (SELECT CAST(floor(date_diff('minute', i.impression_timestamp, v.conversion_timestamp) / 60) AS BIGINT) AS hours_to_conversion
    FROM {conversions} v JOIN {impressions} i ON v.impression_id = i.impression_id) x WHERE hours_to_conversion > 12 GROUP BY 1""")
def test_within_window(t: Tables) -> DataFrame:
    f = fact_tables(t)
    return quality.outside_window(facts.resolve_conversions(f["conversions"], f["impressions"]), "hours_to_conversion", 12)


def sql_share(key: str) -> str:
    return f"""WITH p AS (SELECT {key}, sum(spend_amount) AS m FROM {{spend_transactions}} GROUP BY {key}),
    r AS (SELECT *, row_number() OVER (ORDER BY m DESC, {key}) AS rank, count(*) OVER () AS n, sum(m) OVER () AS total FROM p)
    SELECT round(CAST(sum(m) AS DOUBLE) / CAST(max(total) AS DOUBLE), 8) AS top_share FROM r WHERE rank <= ceil(n * 0.1)"""


@query(sql_share("campaign_id"))
def concentration_campaigns(t: Tables) -> DataFrame:
    return quality.concentration(t["spend_transactions"], "campaign_id", "spend_amount")


@query(sql_share("publisher_id"))
def concentration_publishers(t: Tables) -> DataFrame:
    return quality.concentration(t["spend_transactions"], "publisher_id", "spend_amount")


@query("""WITH a AS (SELECT md5(impression_id) AS k FROM {impressions}), b AS (SELECT md5(impression_id || '') AS k FROM {impressions} ORDER BY impression_id)
    SELECT count(*) AS n, count(DISTINCT k) AS n_keys, (SELECT count(*) FROM b) AS n_rebuilt,
      (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) x) = 0 AND (SELECT count(*) FROM b) = count(*) AS unchanged FROM a""")
def key_stability(t: Tables) -> DataFrame:
    """Checksums of the impression keys of two builds, the second from a written copy in another order."""
    first = facts.impressions(t["impressions"])
    second = facts.impressions(cut(t["impressions"].repartition("impression_id"), "rebuilt"))
    own = quality.key_checksum(first, "impression_key", F.count_distinct(F.unhex("impression_key")).alias("n_keys"))
    both = own.crossJoin(quality.key_checksum(second, "impression_key").select(F.col("n").alias("n_rebuilt"), F.col("checksum").alias("again")))
    return both.select("n", "n_keys", "n_rebuilt", ((F.col("n") == F.col("n_rebuilt")) & (F.col("checksum") == F.col("again"))).alias("unchanged"))


# ---------------------------------------------------------------- reports

SQL_FUNNEL = """(SELECT i.*, coalesce(k.k, 0) AS k, coalesce(v.v, 0) AS v FROM {impressions} i
    LEFT JOIN (SELECT impression_id, count(*) AS k FROM {clicks} GROUP BY impression_id) k ON i.impression_id = k.impression_id
    LEFT JOIN (SELECT impression_id, count(*) AS v FROM {conversions} GROUP BY impression_id) v ON i.impression_id = v.impression_id)"""
SQL_SPEND = "(SELECT campaign_id, sum(spend_amount) AS spend FROM {spend_transactions} GROUP BY campaign_id)"


@query(f"""SELECT c.campaign_id, a.advertiser_name, c.campaign_name, count(*) AS impressions, CAST(sum(k) AS BIGINT) AS clicks, CAST(sum(v) AS BIGINT) AS conversions, {d("max(s.spend)", "spend")}
    FROM {SQL_FUNNEL} f JOIN {{campaigns}} c ON f.campaign_id = c.campaign_id JOIN {{advertisers}} a ON c.advertiser_id = a.advertiser_id
    LEFT JOIN {SQL_SPEND} s ON f.campaign_id = s.campaign_id GROUP BY 1, 2, 3 ORDER BY max(s.spend) DESC, 1 LIMIT 10""")
def report_headline(t: Tables) -> DataFrame:
    return doubles(reports.headline(t))


@query(f"""WITH f AS (SELECT campaign_id, count(*) AS impressions, CAST(sum(k) AS BIGINT) AS clicks, CAST(sum(v) AS BIGINT) AS conversions FROM {SQL_FUNNEL} x GROUP BY campaign_id),
    w AS (SELECT campaign_id, sum(conversion_value) AS value FROM {{conversions}} GROUP BY campaign_id)
    SELECT f.campaign_id, impressions, clicks, conversions, round(CAST(clicks AS DOUBLE) / impressions, 6) AS ctr,
      CASE WHEN clicks <> 0 THEN round(CAST(conversions AS DOUBLE) / clicks, 6) END AS cvr, round(CAST(spend AS DOUBLE) / impressions * 1000, 7) AS cpm,
      CASE WHEN clicks <> 0 THEN round(CAST(spend AS DOUBLE) / clicks, 7) END AS cpc, CASE WHEN conversions <> 0 THEN round(CAST(spend AS DOUBLE) / conversions, 7) END AS cpa,
      CASE WHEN spend <> 0 THEN round(CAST(value AS DOUBLE) / CAST(spend AS DOUBLE), 6) END AS roas
    FROM f LEFT JOIN {SQL_SPEND} s ON f.campaign_id = s.campaign_id LEFT JOIN w ON f.campaign_id = w.campaign_id WHERE impressions > 3""")
def report_campaign_metrics(t: Tables) -> DataFrame:
    return reports.campaign_metrics(t, least=3)


@query(f"""SELECT creative_type, creative_format, count(*) AS impressions, CAST(sum(k) AS BIGINT) AS clicks, round(CAST(sum(k) AS DOUBLE) / count(*), 6) AS ctr
    FROM {SQL_FUNNEL} f JOIN {{creatives}} c ON f.creative_id = c.creative_id GROUP BY 1, 2 HAVING count(*) > 20""")
def report_creative_ctr(t: Tables) -> DataFrame:
    return reports.creative_ctr(t, least=20)


@query(f"""WITH p AS (SELECT publisher_id, sum(spend_amount) AS spend FROM {{spend_transactions}} GROUP BY publisher_id)
    SELECT publisher_id, {d("spend", "spend")}, round(CAST(spend AS DOUBLE) / CAST(sum(spend) OVER () AS DOUBLE), 8) AS share FROM p ORDER BY p.spend DESC, publisher_id LIMIT 20""")
def report_publisher_share(t: Tables) -> DataFrame:
    return doubles(reports.publisher_share(t))


@query(f"""SELECT f.audience_id, audience_name, count(*) AS impressions, CAST(sum(k) AS BIGINT) AS clicks, round(CAST(sum(k) AS DOUBLE) / count(*), 6) AS ctr,
    CASE WHEN sum(k) <> 0 THEN round(CAST(sum(v) AS DOUBLE) / CAST(sum(k) AS DOUBLE), 6) END AS cvr
    FROM {SQL_FUNNEL} f LEFT JOIN {{audiences}} a ON f.audience_id = a.audience_id GROUP BY 1, 2""")
def report_audience_rates(t: Tables) -> DataFrame:
    return reports.audience_rates(t)


@query(f"""SELECT device_type, country, count(*) AS impressions, CAST(sum(k) AS BIGINT) AS clicks FROM {SQL_FUNNEL} f GROUP BY 1, 2 HAVING count(*) > 5
    ORDER BY count(*) DESC, 1, 2 LIMIT 12""")
def report_device_geography(t: Tables) -> DataFrame:
    return reports.device_geography(t, least=5)


@query(f"""SELECT CAST(CAST(impression_timestamp AS DATE) AS VARCHAR) AS day, strftime(CAST(impression_timestamp AS DATE), '%a') AS weekday, count(*) AS impressions, {d("sum(clearing_price)", "clearing")}
    FROM {{impressions}} GROUP BY 1, 2 ORDER BY 1 DESC LIMIT 30""")
def report_daily_trend(t: Tables) -> DataFrame:
    return doubles(reports.daily_trend(t))


@query("""WITH p AS (SELECT campaign_id, count(*) AS n FROM {impressions} GROUP BY campaign_id),
    r AS (SELECT *, CAST(ntile(10) OVER (ORDER BY n DESC, campaign_id) AS INTEGER) AS decile FROM p)
    SELECT decile, count(*) AS campaigns, CAST(sum(n) AS BIGINT) AS impressions, round(CAST(sum(n) AS DOUBLE) / CAST((SELECT sum(n) FROM p) AS DOUBLE), 8) AS share FROM r GROUP BY decile""")
def report_delivery_deciles(t: Tables) -> DataFrame:
    return reports.delivery_deciles(t)


@query("""SELECT conversion_id, round(date_diff('second', k.click_timestamp, v.conversion_timestamp) / 3600, 2) AS hours_from_click,
    round(date_diff('second', i.impression_timestamp, v.conversion_timestamp) / 3600, 2) AS hours_from_impression
    FROM {conversions} v JOIN {clicks} k ON v.click_id = k.click_id JOIN {impressions} i ON v.impression_id = i.impression_id""")
def report_attribution_lags(t: Tables) -> DataFrame:
    return reports.attribution_lags(t)


@query(f"SELECT billing_type, count(*) AS lines, {d('sum(spend_amount)', 'spend')}, count(impression_id) AS with_impression FROM {{spend_transactions}} GROUP BY billing_type")
def report_spend_by_type(t: Tables) -> DataFrame:
    return doubles(reports.spend_by_type(t))


@query("""WITH a AS (SELECT (SELECT count(*) FROM {impressions}) AS i, (SELECT count(*) FROM {clicks}) AS k, (SELECT count(*) FROM {conversions}) AS v,
      (SELECT CAST(sum(conversion_value) AS DOUBLE) FROM {conversions}) AS value, (SELECT CAST(sum(spend_amount) AS DOUBLE) FROM {spend_transactions}) AS s)
    SELECT i AS impressions, k AS clicks, v AS conversions, value, s AS spend, round(CAST(k AS DOUBLE) / i, 8) AS ctr, round(CAST(v AS DOUBLE) / k, 8) AS cvr,
      round(s / i * 1000, 6) AS cpm, round(value / s, 8) AS roas FROM a""")
def report_funnel_totals(t: Tables) -> DataFrame:
    return reports.funnel_totals(t)


@query(f"""WITH p AS (SELECT publisher_id, CAST(sum(k) AS DOUBLE) / count(*) AS ctr FROM {SQL_FUNNEL} f GROUP BY publisher_id HAVING count(*) >= 100),
    c AS (SELECT publisher_id, count(*) AS n FROM {{placements}} GROUP BY publisher_id)
    SELECT round(min(ctr), 8) AS min_ctr, round(quantile_cont(ctr, 0.5), 8) AS median_ctr, round(max(ctr), 8) AS max_ctr,
      (SELECT round(avg(n), 4) FROM c) AS avg_placements, (SELECT max(n) FROM c) AS max_placements FROM p""")
def report_ctr_spread(t: Tables) -> DataFrame:
    return reports.ctr_spread(t)


# ---------------------------------------------------------------- scalar functions and sources


@query(f"""SELECT event_id, {SQL_DAY.format("ts")} AS date_key,
    {SQL_DAY.format("(CAST(ts AS DATE) - INTERVAL '3' DAY)")} AS date_key_before,
    CASE WHEN event_id % 3 <> 0 THEN value / (event_id % 3) END AS divided,
    md5(CAST(user_id AS VARCHAR) || '-' || event_type) AS surrogate, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'k' END, 'UNKNOWN') AS known,
    CASE WHEN event_id % 4 = 0 THEN -1 ELSE greatest(user_id, event_id) END AS strictly,
    CAST(floor(date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', date_trunc('minute', ts)) / 60) AS BIGINT) AS hours_elapsed,
    date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS hours_crossed,
    event_id * 4294967296 + user_id AS position, json_extract_string(props, '$.k') AS k FROM {{events}}""")
def scalar_functions(t: Tables) -> DataFrame:
    e = t["events"]
    ts, start = F.col("ts"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    third = F.col("event_id") % 3
    return e.select(
        "event_id",
        S.date_key(ts).alias("date_key"),
        S.date_key_lookback(S.date_key(ts), 3).alias("date_key_before"),
        S.safe_divide(F.col("value"), third).alias("divided"),
        S.surrogate_key(F.col("user_id"), F.col("event_type")).alias("surrogate"),
        S.or_unknown(F.when(F.col("event_id") % 5 == 0, None).otherwise("k")).alias("known"),
        F.coalesce(S.strict_greatest(F.col("user_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id"))), F.lit(-1)).alias("strictly"),
        S.elapsed("HOUR", start, F.date_trunc("minute", ts).cast("timestamp_ntz")).alias("hours_elapsed"),
        S.boundaries("HOUR", start, ts).alias("hours_crossed"),
        S.log_position(F.concat(F.hex("event_id"), F.lit("/"), F.hex("user_id"))).alias("position"),
        F.from_json(S.canonical_json(F.col("props")), "map<string,string>")["k"].alias("k"),
    )


@query("""SELECT 'orders' AS table_name, count(*) AS n_rows FROM {orders} UNION ALL SELECT 'lineitem', count(*) FROM {lineitem} UNION ALL SELECT 'events', count(*) FROM {events}""")
def table_sizes(t: Tables) -> DataFrame:
    """Rows by table from the files' footers."""
    parts = [sources.table_size(t["orders"].sparkSession, f"{t.sf_dir}/{n}.parquet").select(F.lit(n).alias("table_name"), "n_rows") for n in ("orders", "lineitem", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT advertiser_id, advertiser_name AS name, industry AS sector FROM {advertisers}""")
def staging_renamed(t: Tables) -> DataFrame:
    return sources.stage(t["advertisers"], {"advertiser_id": "advertiser_id", "name": "advertiser_name", "sector": "industry"})


SQL_PRICES = SQL_DECIMALS | {"bid_price", "clearing_price", "viewability_score", "conversion_value", "spend_amount"}
SQL_LINEAGE = """false AS is_deleted, CAST(NULL AS TIMESTAMP) AS deleted_at, CAST(NULL AS BIGINT) AS source_lsn, CAST(NULL AS VARCHAR) AS source_operation,
    CAST(NULL AS TIMESTAMP) AS source_event_at"""


def _staging(table: str) -> None:
    columns = COLUMNS[table].split()
    shown = ", ".join(d(c, c) if c in SQL_PRICES else f"CAST({c} AS VARCHAR) AS {c}" if c in SQL_DATES else c for c in columns)

    def build(t: Tables) -> DataFrame:
        landed = changelog.rename_lineage(changelog.from_snapshot(t[table]))
        lineage = ("is_deleted", "deleted_at", "source_lsn", "source_operation", "source_event_at")
        return plain(sources.stage(landed, {c: c for c in (*columns, *lineage)}))

    build.__name__ = f"staging_{table}"
    query(f"SELECT {shown}, {SQL_LINEAGE} FROM {{{table}}}")(build)


for _name in COLUMNS:
    _staging(_name)


@query("""SELECT event_id, ts, user_id FROM {events} ORDER BY event_id DESC LIMIT 10""")
def newest_events(t: Tables) -> DataFrame:
    return t["events"].select("event_id", "ts", "user_id").orderBy(F.desc("event_id")).limit(10)


# ---------------------------------------------------------------- files: exports, loads, listings


def scratch(t: Tables, name: str) -> str:
    return scratch_dir(t["orders"].sparkSession, name)


@query("""SELECT 'r2' AS run_id, CAST(42 AS BIGINT) AS wal_lsn, 'orders' AS table_name, count(*) AS n_rows, 'o_orderkey' AS first_column FROM {orders}
    UNION ALL SELECT 'r2', CAST(42 AS BIGINT), 'events', count(*), 'event_id' FROM {events}""")
def snapshot_runs(t: Tables) -> DataFrame:
    """Two exports, the newest complete one picked and read back, its columns from the files' footers."""
    spark, root = t["orders"].sparkSession, scratch(t, "exports")
    own = {n: t[n] for n in ("orders", "events")}
    sources.export_snapshot({n: df.where(F.col(df.columns[0]) % 2 == 0) for n, df in own.items()}, root, "r1", 7)
    sources.export_snapshot(own, root, "r2", 42)
    run = sources.pick_run(spark, root)
    parts = []
    for n in own:
        path = f"{root}/r2/{n}"
        first = sources.footer_schema(spark, path).names[0]
        counted = sources.read_files(spark, path).agg(F.count("*").alias("n_rows"))
        parts.append(run.crossJoin(counted).select("run_id", "wal_lsn", F.lit(n).alias("table_name"), "n_rows", F.lit(first).alias("first_column")))
    return parts[0].unionByName(parts[1])


@contextmanager
def database(t: Tables, **given: DataFrame) -> Iterator[jdbc.Source]:
    """A Derby database within the driver that holds the given tables, gone at the end. Its executors have to be in
    the driver too, so it is for local sessions."""
    spark = t["orders"].sparkSession
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("an embedded database is only seen from within the driver; use jdbc.Source with a server's url")
    memory = f"jdbc:derby:memory:tidemill_{uuid.uuid4().hex}"
    for name, df in given.items():
        jdbc.load_table(df, f"{memory};create=true", name, ", ".join(f"{c} VARCHAR(100)" for c, k in df.dtypes if k == "string") or None)
    try:
        yield jdbc.Source(spark, memory, "SET CURRENT ISOLATION = RR")
    finally:
        with suppress(Exception):  # Derby reports the end of a database as an error
            spark._jvm.java.sql.DriverManager.getConnection(f"{memory};drop=true")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(o_orderkey) AS first_key FROM {orders} GROUP BY o_orderstatus")
def jdbc_ranges(t: Tables) -> DataFrame:
    """A database's table read in ranges of its key, the aggregate's columns alone."""
    with database(t, orders=t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))) as source:
        rows = source.ranges("orders", "o_orderkey", rows_per_part=4000)
        return cut(plain(doubles(rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.min("o_orderkey").alias("first_key")))))


@query("""SELECT 'customer' AS table_name, count(*) AS source_rows, count(*) AS loaded_rows, true AS equal FROM {customer}
    UNION ALL SELECT 'supplier', count(*), count(CASE WHEN s_suppkey % 10 <> 0 THEN 1 END), count(CASE WHEN s_suppkey % 10 = 0 THEN 1 END) = 0 FROM {supplier}""")
def jdbc_counts(t: Tables) -> DataFrame:
    """Counts by the source against those of loaded tables, one of which lacks rows."""
    keys = {"customer": t["customer"].select("c_custkey"), "supplier": t["supplier"].select("s_suppkey")}
    with database(t, **keys) as source:
        loaded = [("customer", keys["customer"]), ("supplier", keys["supplier"].where("s_suppkey % 10 <> 0"))]
        own = reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("loaded_rows")) for n, df in loaded])
        found = source.counts(*keys).withColumnsRenamed({"TABLE_NAME": "table_name", "N": "n"})
        there = found.select(F.trim("table_name").alias("table_name"), F.col("n").cast("long").alias("source_rows"))
        return cut(there.join(own, "table_name").withColumn("equal", F.col("source_rows") == F.col("loaded_rows")))


@query(f"SELECT * FROM ({SQL_CURRENT}) x")
def jdbc_snapshot(t: Tables) -> DataFrame:
    """A database that holds the state as of half the log: exported with its position, then reconciled with the log after it."""
    spark, root, at = t["orders"].sparkSession, scratch(t, "exports"), boundary(t)
    state = snapshot(t, at)
    with database(t, users=state, log_position=spark.createDataFrame([(at,)], "lsn long")) as source:
        position, read = source.snapshot({"users": "user_id"}, 'SELECT max("lsn") AS lsn FROM log_position', lambda name, df: df)
        sources.export_snapshot(read, root, "r1", position)
    run = sources.pick_run(spark, root).first()
    exported = sources.read_files(spark, f"{root}/{run.run_id}/users").to(state.schema)
    return plain(changelog.reconcile_table(exported, change_events(t), "user_id", run.wal_lsn))


@query("""SELECT 'orders' AS table_name, count(*) AS n_rows, true AS has_files, true AS has_bytes, false AS mismatch FROM {orders}
    UNION ALL SELECT 'events', count(*), true, true, true FROM {events}""")
def publish_manifest(t: Tables) -> DataFrame:
    """An export's manifest, and which loaded table has not the manifest's rows (one is loaded short)."""
    spark, root = t["orders"].sparkSession, scratch(t, "publish")
    manifest = sources.publish_export({"orders": t["orders"], "events": t["events"], "absent": None}, root)
    loaded = {"orders": spark.read.parquet(f"{root}/orders"), "events": spark.read.parquet(f"{root}/events")}
    loaded["events"] = loaded["events"].union(loaded["events"].limit(1))
    wrong = sources.count_mismatches(loaded, manifest).select("table_name", F.lit(True).alias("mismatch"))
    return manifest.join(wrong, "table_name", "left").select(
        "table_name", "n_rows", (F.col("n_files") > 0).alias("has_files"), (F.col("n_bytes") > 0).alias("has_bytes"), F.coalesce("mismatch", F.lit(False)).alias("mismatch")
    )


@query("""SELECT 'o_orderdate' AS column_name, least(1000, count(*)) AS implausible FROM {orders}""")
def load_times(t: Tables) -> DataFrame:
    """Times outside the years 2000 to 2100 in a load's sample of 1,000 rows; the dates are shifted back."""
    return sources.implausible_times(t["orders"].select("o_orderkey", (F.col("o_orderdate") - F.expr("interval 60 years")).alias("o_orderdate")))


@query("SELECT r_regionkey, r_name, n_nationkey, n_name FROM {region} JOIN {nation} ON n_regionkey = r_regionkey")
def csv_export(t: Tables) -> DataFrame:
    spark, root = t["region"].sparkSession, scratch(t, "csv")
    both = t["region"].join(t["nation"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "n_nationkey", "n_name")
    sources.write_csv(both, root)
    return spark.read.schema(both.schema).option("header", True).csv(root)


@query("SELECT CAST(day AS VARCHAR) AS day, count(*) AS n_rows, true AS has_files, true AS has_bytes FROM {changes} GROUP BY day")
def layer_listing(t: Tables) -> DataFrame:
    """A table written by days of its event time, listed by day."""
    spark, root = t["changes"].sparkSession, scratch(t, "keyed")
    sources.write_keyed(t["changes"].drop("day"), root, "ts")
    found = sources.table_size(spark, root, "day")
    return found.select(F.col("day").cast("string").alias("day"), "n_rows", (F.col("n_files") > 0).alias("has_files"), (F.col("n_bytes") > 0).alias("has_bytes"))


@query("SELECT lsn, op FROM {changes} ORDER BY lsn DESC LIMIT 10")
def newest_changes(t: Tables) -> DataFrame:
    return sources.peek(change_events(t).where("op <> 't'")).select("lsn", "op")


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 40 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day, event_type FROM {events}),
    h AS (SELECT max(event_id) / 2 AS half FROM {events})
    SELECT event_id, user_id, CASE WHEN event_id % 15 = 0 AND event_id > half THEN (SELECT max(day) FROM e) ELSE day END AS day,
      CASE WHEN event_id % 5 = 0 AND event_id > half THEN 'again' ELSE event_type END AS event_type FROM e, h""")
def merge_floor(t: Tables) -> DataFrame:
    """A stored table merged by key from the changes' first day on. Some rows have no day and some of the changes move to
    the last one; an empty batch, and the same batch again, change nothing."""
    spark, path = t["events"].sparkSession, scratch(t, "events-by-day")
    day = F.when(F.col("event_id") % 40 != 0, F.to_date("ts"))
    days = t["events"].select("event_id", "user_id", "event_type", day.alias("day"))
    last, half = days.agg(F.max("day"), F.max("event_id") / 2).first()
    chosen = days.where((F.col("event_id") % 5 == 0) & (F.col("event_id") > half))
    floor = chosen.agg(F.min("day")).first()[0]
    moved = F.when(F.col("event_id") % 15 == 0, F.lit(last)).otherwise(F.col("day"))
    changes = chosen.withColumns({"event_type": F.lit("again"), "day": moved})
    stored.merge_stored(days, path, "event_id", "day")
    for batch in (changes, changes.where("false"), changes):
        stored.merge_stored(batch, path, "event_id", "day", floor=floor)
    return stored.read_stored(spark, path, days).withColumn("day", F.col("day").cast("string"))


@query("""SELECT event_id, CAST(round(CAST(value AS DECIMAL(18,6)), 2) AS DOUBLE) AS two, CAST(round(CAST(value AS DECIMAL(18,8)), 4) AS DOUBLE) AS four,
    user_id AS summed, CAST(CAST(ts AS DATE) AS VARCHAR) AS since FROM {events}""")
def scalar_decimals(t: Tables) -> DataFrame:
    e = t["events"]
    summary = F.create_map(F.lit("total-records"), F.col("user_id").cast("string"))
    since = F.when(F.to_date("ts") > S.beginning_of_time(), F.to_date("ts")).cast("string").alias("since")
    return doubles(e.select("event_id", S.quantise(F.col("value"), 2).alias("two"), S.quantise(F.col("value"), 4).alias("four"), S.summary_value(summary, "total-records").alias("summed"), since))


# ---------------------------------------------------------------- the quality gate


@query("SELECT name, observed, status, 'run-7' AS run_id, true AS gated FROM (" + checks.as_sql(checks.UNIQUENESS, checks.BASES) + ") o")
def checks_persisted(t: Tables) -> DataFrame:
    """Observations stored with their run and read back; the gate lets them through unless one fails."""
    spark, root = t["orders"].sparkSession, scratch(t, "observations")
    quality.persist(quality.observe(checks.UNIQUENESS, bases(t, {c.base for c in checks.UNIQUENESS})), root, "run-7")
    found = spark.read.parquet(root)
    try:
        quality.gate(found)
        gated = found.where("status = 'FAIL'").limit(1).count() == 0
    except quality.QualityError:
        gated = found.where("status = 'FAIL'").limit(1).count() == 1
    return found.select("name", "observed", "status", "run_id", F.lit(gated).alias("gated"))


@query("SELECT dim, CAST(1 AS BIGINT) AS n_unknown, CAST(0 AS BIGINT) AS n_broken FROM (VALUES " + ", ".join(f"('{n}')" for n in dims.DIMENSIONS) + ") v(dim)")
def unknown_members(t: Tables) -> DataFrame:
    """Every dimension has one unknown member."""
    parts = []
    for name, dim in dims.DIMENSIONS.items():
        members = dims.type1(t[f"{name}s"], dim)
        broken = quality.has_unknown_member(members, dim.key).agg(F.count("*").alias("n_broken"))
        own = members.agg(F.count_if(F.col(dim.key) == "UNKNOWN").alias("n_unknown"))
        parts.append(own.crossJoin(broken).withColumn("dim", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT 'orders_without_customer' AS name, count(*) AS observed FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer})")
def checks_by_view(t: Tables) -> DataFrame:
    """Checks given as SQL over views; one whose table is absent is skipped."""
    spark = t["orders"].sparkSession
    for n in ("orders", "customer"):
        t[n].createOrReplaceTempView(f"checked_{n}")
    return quality.sql_checks(spark, {
        "orders_without_customer": ("SELECT count(*) FROM checked_orders LEFT ANTI JOIN checked_customer ON o_custkey = c_custkey", ["checked_orders", "checked_customer"]),
        "skipped": ("SELECT count(*) FROM checked_nowhere", ["checked_nowhere"]),
    })


assert set(ORACLES) <= set(QUERIES) and DERIVED
