"""Reading, publishing, listing and checking tables on any file system that Spark reaches."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1_000_000


def read_files(spark: SparkSession, *urls: str) -> DataFrame:
    """Exactly the listed files."""
    return spark.read.parquet(*urls)


def footer_schema(spark: SparkSession, url: str) -> T.StructType:
    return spark.read.parquet(url).schema


def export_snapshot(tables: dict[str, DataFrame], root: str, run_id: str, position: int) -> None:
    """Every table as Parquet, then the manifest: a run without one is not complete."""
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{root}/{run_id}/{name}")
    spark = next(iter(tables.values())).sparkSession
    row = [(run_id, position, sorted(tables))]
    spark.createDataFrame(row, "run_id string, wal_lsn long, tables array<string>").coalesce(1).write.json(f"{root}/manifests/{run_id}")


def pick_run(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """The newest complete run, or a named one; a named run that is not complete is an error."""
    runs = spark.read.schema("run_id string, wal_lsn long, tables array<string>").json(f"{root}/manifests/*")
    if run_id is not None:
        named = runs.where(F.col("run_id") == run_id)
        if not named.take(1):
            raise ValueError(f"no complete run {run_id} under {root}")
        return named
    return runs.agg(F.max_by(F.struct("run_id", "wal_lsn", "tables"), "run_id").alias("r")).select("r.*")


def file_count(rows: int, per_file: int = ROWS_PER_FILE) -> int:
    return max(1, math.ceil(rows / per_file))


def write_keyed(df: DataFrame, path: str, event_ts: str | None = None) -> None:
    """Replaces a table; event tables are partitioned by day and rows dealt by it first, a large day to several
    tasks: adaptive execution sizes them by ``spark.sql.adaptive.advisoryPartitionSizeInBytes``."""
    writer = df.withColumn("day", F.to_date(event_ts)).hint("rebalance", "day") if event_ts else df.hint("rebalance")
    out = writer.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE)
    (out.partitionBy("day") if event_ts else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def compact_files(landed: DataFrame, out: str, day: str = "dt", partition: str = "kafka_partition", offset: str = "kafka_offset") -> int:
    """Fewer, offset-ordered files per day and source partition; the row count is verified before it is published."""
    before = landed.count()
    ordered = landed.repartition(day, partition).sortWithinPartitions(day, partition, offset)
    ordered.write.partitionBy("source_table", day).parquet(out)
    after = landed.sparkSession.read.parquet(out).count()
    if before != after:
        raise ValueError(f"compaction wrote {after} of {before} rows")
    return after


def publish_export(tables: dict[str, DataFrame | None], root: str, files: int | None = None) -> DataFrame:
    """Each present table as Parquet, in its own partitions or ``files``, and a manifest with rows, files and bytes."""
    rows = []
    spark = None
    for name, df in tables.items():
        if df is None:
            continue
        spark = df.sparkSession
        dealt = df if files is None else df.repartition(files)
        dealt.write.mode("overwrite").option("compression", "snappy").parquet(f"{root}/{name}")
        rows.append(table_size(spark, f"{root}/{name}").withColumn("table_name", F.lit(name)))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _footers(spark: SparkSession) -> SparkSession:
    """A session beside the given one in which counts and extremes come from Parquet footers, without a read of rows."""
    side = spark.newSession()
    side.conf.set("spark.sql.sources.useV1SourceList", "")
    side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return side


def footer_counts(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(keys, n_rows) of a Parquet table by its partition columns, counted from footers; in a session of its own."""
    return _footers(spark).read.parquet(path).groupBy(*keys).agg(F.count("*").alias("n_rows"))


def table_size(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(keys, n_rows, n_files, n_bytes) of a Parquet table, by its partition columns ``keys`` if any: rows from
    footers, files and bytes from the listing. A row for each combination of keys reaches the driver, which lists them anyway."""
    counted = footer_counts(spark, path, *keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema)
    # Spark adds up no footers to null where all files are empty.
    rows = spark.createDataFrame([(*r[:-1], r[-1] or 0) for r in counted.collect()], kinds)
    # Contents are not read where they are not selected.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    listed = files.groupBy(*[F.col(k).cast(rows.schema[k].dataType) for k in keys]).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
    if not keys:
        return rows.crossJoin(listed)
    on = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(listed[k]) for k in keys])
    return rows.join(listed, on, "left").select(*[rows[k] for k in keys], "n_rows", "n_files", "n_bytes")


def peek(landed: DataFrame, n: int = 10) -> DataFrame:
    """The newest change events."""
    return landed.orderBy(F.desc("kafka_offset")).limit(n)


def count_mismatches(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Loaded tables whose row count is not the manifest's."""
    spark = manifest.sparkSession
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("loaded")).withColumn("table_name", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        counted = spark.createDataFrame([], "loaded long, table_name string")
    return manifest.join(counted, "table_name", "left").where(~F.col("n_rows").eqNullSafe(F.col("loaded")))


def implausible_times(df: DataFrame, sample: int = 1000, first: int = 2000, last: int = 2100) -> DataFrame:
    """Per date or timestamp column of a sample: values outside the years; the sample is the check's definition."""
    columns = [n for n, k in df.dtypes if k.startswith(("date", "timestamp"))]
    some = df.select(*columns).limit(sample)
    counts = some.agg(*[F.count_if(~F.year(c).between(first, last)).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("implausible")) for c in columns])))


def stage(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A staging projection: named columns only, renamed."""
    return df.select(*[F.col(source).alias(name) for name, source in columns.items()])
