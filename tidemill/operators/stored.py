"""Merges into partitioned tables on storage: the partitions that a batch touches are read and replaced, no others.

A merge finds where the batch's keys are (two columns of the partitions from ``floor`` on), reads those
partitions and the batch's own, and writes them again by dynamic partition overwrite; rows without a partition
value are a partition like others. Partitions that rows moved out of and nothing else is left in are deleted after the write. If
a run dies in between, a rerun of the batch gives the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.session import cut_at, discard


@dataclass
class Merged:
    """What a merge did: the batch's rows after its own repeats, and the rows of the partitions it read."""

    merged: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    rows_read: int = 0
    partitions: int = 0


def newest_rows(changes: DataFrame, pk: str, *order: str) -> DataFrame:
    """One row a key, the greatest by ``order`` and then by all columns; nulls are least."""
    columns = [*order, *[c for c in changes.columns if c not in order]]
    return changes.groupBy(pk).agg(F.max(F.struct(*columns)).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in changes.columns])


def observed_merge(
    target: DataFrame, changes: DataFrame, pk: str, deleted: str | None = None, more: tuple[str, ...] = ()
) -> tuple[DataFrame, Observation]:
    """The merged rows, and counts that the run which computes them leaves behind: the target is scanned once.

    ``changes`` holds a key once, and may have columns ``more`` that the target lacks. The observation has rows_before, updated and deleted; inserted rows are the others of the batch.
    """
    gone = F.col(deleted) if deleted else F.lit(False)
    marks = changes.select(F.col(pk).alias("_pk"), F.coalesce(gone, F.lit(False)).alias("_gone"))
    seen = Observation()
    met = target.join(marks, F.col(pk) == F.col("_pk"), "left").observe(
        seen,
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.col("_pk").isNotNull() & ~F.col("_gone")).alias("updated"),
        F.count_if(F.col("_pk").isNotNull() & F.col("_gone")).alias("deleted"),
    )
    kept = met.where(F.col("_pk").isNull()).select(*target.columns, *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in more])
    return kept.unionByName(changes), seen


def _among(part: str, values: list) -> Column:
    """A predicate over the partition column that reaches the listing of files."""
    known = [v for v in values if v is not None]
    inside = F.col(part).isin(*known) if known else F.lit(False)
    return inside | F.col(part).isNull() if None in values else inside


def from_floor(part: str, floor) -> Column:
    """Partitions from ``floor`` on, and that of rows without a value; all of them if there is no floor."""
    return F.lit(True) if floor is None else (F.col(part) >= F.lit(floor)) | F.col(part).isNull()


def touched_partitions(target: DataFrame, batch: DataFrame, pk: str, part: str, floor=None) -> tuple[list, list]:
    """(partitions where the batch's keys are now, partitions that the batch's rows belong to). They are as
    many as the table's partitions at most, which the driver lists to read it."""
    homes = target.where(from_floor(part, floor)).select(pk, part).join(batch.select(pk), pk, "left_semi").select(part).distinct()
    return [r[0] for r in homes.collect()], [r[0] for r in batch.select(part).distinct().collect()]


def rows_of(target: DataFrame, part: str, values: list) -> DataFrame:
    return target.where(_among(part, values))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stored table with the columns and types of ``like``, its partition column's too."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def _write(rows: DataFrame, path: str, part: str) -> None:
    writer = rows.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(part).parquet(path)


def merge_stored(
    changes: DataFrame, path: str, pk: str, part: str, floor=None, order: tuple[str, ...] = (), deleted: str | None = None
) -> Merged:
    """Merges a batch by key into the table at ``path``, partitioned by ``part``, which need not exist.

    Of rows of one key the newest by ``order`` counts. ``floor`` is a promise that no key of the batch is in an
    earlier partition; those are not looked at. ``deleted`` names a flag that the report counts by. An empty
    batch changes nothing. A batch with rows that have no key is refused, as nothing could merge them again.
    """
    spark = changes.sparkSession
    batch, folder = cut_at(newest_rows(changes, pk, *order), "merge-batch")
    try:
        merged, nameless = batch.agg(F.count("*"), F.count_if(F.col(pk).isNull())).first()
        if nameless:
            raise ValueError(f"rows without {pk} cannot be merged")
        if not merged:
            return Merged()
        if not exists(spark, path):
            _write(batch, path, part)
            return Merged(merged, merged, partitions=batch.select(part).distinct().count())
        target = read_stored(spark, path, batch)
        homes, own = touched_partitions(target, batch, pk, part, floor)
        touched = [*homes, *[v for v in own if v not in homes]]
        rows, seen = observed_merge(rows_of(target, part, touched), batch, pk, deleted)
        left = [v for v in homes if v not in own]
        if left:  # only what rows moved out of can end up empty
            still = rows_of(target, part, left).join(batch.select(pk), pk, "left_anti").select(part).distinct().collect()
            left = [v for v in left if v not in [r[0] for r in still]]
        _write(rows, path, part)
        for value in left:
            discard(spark, f"{path}/{_folder(spark, part, value)}")
        counts = seen.get
        known = counts["updated"] + counts["deleted"]
        return Merged(merged, merged - known, counts["updated"], counts["deleted"], counts["rows_before"], len(touched))
    finally:
        discard(spark, folder)


def _folder(spark: SparkSession, part: str, value) -> str:
    utils = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.getPartitionPathString(part, None if value is None else str(value))


def watermark(spark: SparkSession, path: str, like: DataFrame, ts: str, part: str):
    """(newest partition, newest ``ts`` in it) of a stored table; only that partition's times are read."""
    if not exists(spark, path):
        return None, None
    target = read_stored(spark, path, like)
    last = target.agg(F.max(part)).first()[0]
    return last, None if last is None else target.where(F.col(part) == F.lit(last)).agg(F.max(ts)).first()[0]


def load_increment(source: DataFrame, path: str, pk: str, ts: str, part: str) -> Merged:
    """Rows from the table's newest time on, ties again, merged by key; everything if there is no table yet.

    Rows without a time have no place in an order of times, so they come with every batch and merge by key.
    ``part`` does not fall where ``ts`` rises, as the day of a time.
    """
    last, newest = watermark(source.sparkSession, path, source, ts, part)
    batch = source if newest is None else source.where((F.col(ts) >= F.lit(newest)) | F.col(ts).isNull())
    return merge_stored(batch, path, pk, part, floor=last)
