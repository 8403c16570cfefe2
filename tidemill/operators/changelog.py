"""Change logs: collapse to the newest change of each key, and reconcile with a snapshot.

Changes are ordered by log position, never by time. A deletion keeps the last values and sets a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operations of a change record: create, update, delete, snapshot read, tombstone.
DELETES = ("d", "t")

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("op", T.StringType(), False),
        T.StructField("source_schema", T.StringType()),
        T.StructField("source_table", T.StringType(), False),
        T.StructField("event_ts_ms", T.LongType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("tx_id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("before_json", T.StringType()),
        T.StructField("after_json", T.StringType()),
        T.StructField("kafka_topic", T.StringType(), False),
        T.StructField("kafka_partition", T.IntegerType(), False),
        T.StructField("kafka_offset", T.LongType(), False),
        T.StructField("ingested_at_ms", T.LongType(), False),
    ]
)

LINEAGE = [
    T.StructField("is_deleted", T.BooleanType(), False),
    T.StructField("deleted_at", T.TimestampType()),
    T.StructField("_lsn", T.LongType()),
    T.StructField("_op", T.StringType()),
    T.StructField("_event_ts", T.TimestampType()),
]
LINEAGE_NAMES = [f.name for f in LINEAGE]


def wire_schema(target: T.StructType) -> T.StructType:
    """How payload JSON carries each type: decimals as text, dates as days, timestamps as milliseconds."""

    def wire(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.DecimalType):
            return T.StringType()
        if isinstance(kind, T.DateType):
            return T.IntegerType()
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return T.LongType()
        return kind

    return T.StructType([T.StructField(f.name, wire(f.dataType)) for f in target])


def current_schema(target: T.StructType) -> T.StructType:
    return T.StructType([*target.fields, *LINEAGE])


def source_columns(current: DataFrame) -> DataFrame:
    """A current-state table without its lineage."""
    return current.drop(*LINEAGE_NAMES)


def rename_lineage(current: DataFrame) -> DataFrame:
    names = {"_lsn": "source_lsn", "_op": "source_operation", "_event_ts": "source_event_at"}
    return current.withColumnsRenamed(names)


def restore(value: Column, kind: T.DataType) -> Column:
    """A payload field back in the table's type."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_millis(value).cast(kind)
    return value.cast(kind)


def collapse_changes(events: DataFrame, pk: str, target: T.StructType, min_lsn: int | None = None) -> DataFrame:
    """One typed row per key: its newest change above ``min_lsn``, tombstones left out."""
    live = events.where(~F.col("op").eqNullSafe("t"))
    if min_lsn is not None:
        live = live.where(F.col("lsn") > min_lsn)
    order = Window.partitionBy("_pk").orderBy(F.desc_nulls_last("lsn"), F.desc("kafka_offset"))
    newest = (
        live.withColumn("_pk", F.get_json_object("key", f"$.{pk}"))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") == 1)
    )
    parsed = newest.withColumn("_row", F.from_json(F.coalesce("after_json", "before_json"), wire_schema(target)))
    deleted = F.col("op").isin(*DELETES)
    at = F.timestamp_millis("event_ts_ms")
    return parsed.select(
        *[restore(F.col("_row")[f.name], f.dataType).alias(f.name) for f in target],
        deleted.alias("is_deleted"),
        F.when(deleted, at).alias("deleted_at"),
        F.col("lsn").alias("_lsn"),
        F.col("op").alias("_op"),
        at.alias("_event_ts"),
    )


def from_snapshot(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows in current-state shape, without provenance."""
    return snapshot.select(
        "*",
        F.lit(False).alias("is_deleted"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in LINEAGE[1:]],
    )


def apply_changes(current: DataFrame, changes: DataFrame, pk: str) -> DataFrame:
    """Rows without a change, and every changed row."""
    return current.join(changes.select(pk), pk, "left_anti").unionByName(changes)


def reconcile_table(snapshot: DataFrame, events: DataFrame | None, pk: str, min_lsn: int | None = None) -> DataFrame:
    """Current state from a snapshot and the changes after its position; the snapshot alone if there is no log."""
    base = from_snapshot(snapshot)
    if events is None:
        return base
    return apply_changes(base, collapse_changes(events, pk, snapshot.schema, min_lsn), pk)


def compact_log(events: DataFrame, older_than_ms: int, tombstones_until_ms: int | None = None) -> DataFrame:
    """Keep-latest-per-key for records older than a time; newer ones stay as they are.

    A tombstone that is the latest of its key goes too if it is older than ``tombstones_until_ms``. A record's
    time is that of its event, or of its arrival if it has none.
    """
    at = F.coalesce("event_ts_ms", "ingested_at_ms")
    order = Window.partitionBy("source_table", "key").orderBy(F.desc("kafka_offset"))
    kept = events.where(at < older_than_ms).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")
    if tombstones_until_ms is not None:
        kept = kept.where(~((F.col("op") == "t") & (at < tombstones_until_ms)))
    return kept.unionByName(events.where(at >= older_than_ms))


def change_counts(events: DataFrame) -> DataFrame:
    """Changes and tombstones in one pass."""
    return events.groupBy((F.col("op") == "t").alias("is_tombstone")).agg(F.count("*").alias("n_events"))


def high_water(table: DataFrame, column: str = "_lsn") -> DataFrame:
    """The newest applied position; null for an empty table."""
    return table.agg(F.max(column).alias("high_water"))


def offset_bookmarks(applied: DataFrame) -> DataFrame:
    return applied.groupBy("kafka_topic", "kafka_partition").agg(F.max("kafka_offset").alias("seen_offset"))


#: So many bookmarks become a predicate that reaches the files' statistics; more are joined.
LITERAL_BOOKMARKS = 200


def pending(events: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Events after the bookmark of their partition; a partition without one is read whole.

    Few bookmarks become literals, which Parquet filters by its statistics; many are joined.
    """
    marks = bookmarks.select("kafka_topic", "kafka_partition", "seen_offset").limit(LITERAL_BOOKMARKS + 1).collect()
    if len(marks) > LITERAL_BOOKMARKS:
        joined = events.join(bookmarks, ["kafka_topic", "kafka_partition"], "left")
        return joined.where(F.col("seen_offset").isNull() | (F.col("kafka_offset") > F.col("seen_offset"))).drop("seen_offset")
    known, after = F.lit(False), F.lit(False)
    for topic, partition, seen in marks:
        own = (F.col("kafka_topic") == topic) & (F.col("kafka_partition") == partition)
        known, after = known | own, after | (own & (F.col("kafka_offset") > seen))
    return events.where(after | ~known) if marks else events


def refresh_status(
    events: DataFrame,
    bookmarks: DataFrame,
    tables: DataFrame,
    exports: DataFrame | None = None,
    append_only: tuple[str, ...] = (),
    forced: tuple[str, ...] = (),
) -> DataFrame:
    """Per table what a refresh has to do: mode, reason, applied position and the events to read.

    ``tables`` holds what exists: source_table, applied_lsn and, with ``exports``, the run_id that it was built on.
    ``exports`` lists every source_table with the run_id of its newest export. A rebuild or bootstrap reads all
    events again, a skip none.
    """
    if exports is None:
        exports = tables.select("source_table", F.lit(None).cast("string").alias("run_id"))
    built = tables.select("source_table", "applied_lsn", (F.col("run_id") if "run_id" in tables.columns else F.lit(None).cast("string")).alias("built_on"), F.lit(True).alias("there"))
    counted = events.groupBy("source_table").agg(F.count("*").alias("n_all"))
    waiting = pending(events, bookmarks).groupBy("source_table").agg(F.count("*").alias("n_pending"))
    out = exports.join(built, "source_table", "left").join(counted, "source_table", "left").join(waiting, "source_table", "left")
    n_pending = F.coalesce("n_pending", F.lit(0))
    rules = [
        (F.col("source_table").isin(*forced) if forced else F.lit(False), "rebuild", F.lit("forced")),
        (F.col("there").isNull() | F.col("applied_lsn").isNull(), "bootstrap", F.lit("no table yet")),
        (
            F.col("run_id").isNotNull() & ~F.col("run_id").eqNullSafe(F.col("built_on")), "rebuild",
            F.concat(F.lit("snapshot export changed: "), F.coalesce("built_on", F.lit("none")), F.lit(" -> "), F.col("run_id")),
        ),
        (F.col("source_table").isin(*append_only) if append_only else F.lit(False), "skip", F.lit("append-only, export unchanged")),
        (n_pending > 0, "incremental", F.concat(n_pending.cast("string"), F.lit(" new change events"))),
    ]
    mode, reason = F.lit("skip"), F.lit("no new change events")
    for condition, name, why in reversed(rules):
        mode, reason = F.when(condition, name).otherwise(mode), F.when(condition, why).otherwise(reason)
    out = out.withColumn("mode", mode).withColumn("reason", reason)
    to_read = F.when(F.col("mode").isin("rebuild", "bootstrap"), F.coalesce("n_all", F.lit(0))).when(F.col("mode") == "incremental", n_pending).otherwise(0)
    return out.select("source_table", "applied_lsn", to_read.cast("long").alias("pending_events"), "mode", "reason")
