"""Upserts into current-state tables and incremental windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import date_key_lookback
from tidemill.operators.stored import from_floor, observed_merge
from tidemill.session import cut_at, discard


def merge_upsert(target: DataFrame, changes: DataFrame, pk: str | list[str]) -> DataFrame:
    """Matched rows replaced, others inserted; an unseen deletion comes in flagged."""
    keys = [pk] if isinstance(pk, str) else pk
    return target.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def merge_partitions(target: DataFrame, changes: DataFrame, pk: str, part: str, floor) -> tuple[DataFrame, DataFrame]:
    """(untouched, rewritten): only target partitions from ``floor`` on, and rows without a partition value, take
    part in the merge; without a floor, as an empty batch has none, nothing has to be left out."""
    touched = from_floor(part, floor)
    return target.where(~touched), merge_upsert(target.where(touched), changes, pk)


def merge_report(before: DataFrame, changes: DataFrame, pk: str, events: DataFrame | None = None) -> DataFrame:
    """Rows merged, inserted, updated, deleted and the size after, counted by the run that merges; with ``events``
    also the changes and tombstones that were read. The merged keys are computed and dropped."""
    spark = before.sparkSession
    batch, folder = cut_at(changes, "merge-batch")
    merged, seen = observed_merge(before.select(pk), batch.select(pk, "is_deleted"), pk, "is_deleted", ("is_deleted",))
    merged.write.format("noop").mode("overwrite").save()
    rows, counts = batch.count(), seen.get
    discard(spark, folder)
    known = counts["updated"] + counts["deleted"]
    report = (rows, rows - known, counts["updated"], counts["deleted"], counts["rows_before"], counts["rows_before"] + rows - known)
    out = spark.createDataFrame([report], "merged long, inserted long, updated long, deleted long, rows_before long, rows_after long")
    if events is None:
        return out
    gone = F.col("op") == "t"
    return out.crossJoin(events.agg(F.count_if(~gone).alias("n_events"), F.count_if(gone).alias("n_tombstones")))


def live_counts(current: DataFrame) -> DataFrame:
    return current.agg(
        F.count("*").alias("total_rows"),
        F.count_if(~F.col("is_deleted")).alias("live_rows"),
        F.count_if(F.col("is_deleted")).alias("deleted_rows"),
    )


def trailing_days(source: DataFrame, key: str, days: int) -> DataFrame:
    """The trailing days that an incremental mart computes anew."""
    newest = source.agg(F.max(key).alias("k")).select(date_key_lookback(F.col("k"), days).alias("floor"))
    return source.join(F.broadcast(newest), F.col(key) >= F.col("floor")).drop("floor")


def resolution_window(batch: DataFrame, parents: DataFrame, key: str, days: int) -> DataFrame:
    """Parents that events of the batch can descend from: back to the batch's first day less ``days``."""
    floor = batch.agg(F.min(key).alias("k")).select(date_key_lookback(F.col("k"), days)).first()[0]
    return parents.where(F.col(key) >= floor)


def freshness(table: DataFrame, ts: str, as_of: Column, warn_hours: int = 12, error_hours: int = 48) -> DataFrame:
    """Age of the newest row, and pass, warn or error."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
    state = F.when(F.col("newest").isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass")
    return table.agg(F.max(ts).alias("newest")).withColumn("age_hours", F.round(age, 3)).withColumn("status", state)


def overwrite_days(df: DataFrame, path: str, key: str = "date_key", gathered: bool = False) -> None:
    """Replaces the days, or whatever ``key`` partitions by, that ``df`` holds and leaves the others. Rows that are
    ``gathered`` lie together by ``key`` already and are written from where they are."""
    rows = df if gathered else df.repartition(key)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(key).parquet(path)
