"""A zone map of landed change files, and the files that bookmarks leave to read.

The map holds for each file and source partition the least and greatest offset and the rows. It is made from two
columns of files that it does not hold yet, and kept beside the log. A file is passed over only if the bookmark of every source partition in it has
reached its greatest offset: one that straddles a bookmark is read again and its applied part filtered by position.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.versions import newest, publish, read_version

MAP = "file string, source_table string, kafka_partition int, first_offset long, last_offset long, n_rows long"


def _map_of(landed: DataFrame) -> DataFrame:
    keys = [F.col("_metadata.file_path").alias("file"), F.col("source_table"), F.col("kafka_partition")]
    return landed.groupBy(*keys).agg(F.min("kafka_offset").alias("first_offset"), F.max("kafka_offset").alias("last_offset"), F.count("*").alias("n_rows"))


def read_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """The named files of a landed log, with the columns that its folders spell."""
    whole = spark.read.parquet(path)
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*files) if files else whole.limit(0)


def update_map(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The map of the log at ``path``, kept as versions under ``root``: files it does not hold are looked at, files
    that are gone, as after a compaction, leave it."""
    there = spark.read.parquet(path).inputFiles()
    known = read_version(spark, root) if newest(spark, root) else spark.createDataFrame([], MAP)
    # The driver lists the log's files to read it; their names are all that it compares.
    seen = {r.file for r in known.select("file").distinct().collect()}
    listed = {_plain(f): f for f in there}
    new = [f for name, f in listed.items() if name not in {_plain(x) for x in seen}]
    gone = [f for f in seen if _plain(f) not in listed]
    if new or gone:
        kept = known.join(spark.createDataFrame([(f,) for f in gone], "file string"), "file", "left_anti") if gone else known
        added = _map_of(read_files(spark, path, new)) if new else known.limit(0)
        publish(kept.unionByName(added), root, note={"files": len(there)})
    return read_version(spark, root)


def _plain(file: str) -> str:
    """A file's name without the ways in which Spark spells the scheme of local files."""
    return file.replace("file:///", "/").replace("file:/", "/")


def encode_bookmarks(marks: dict[int, int]) -> str:
    return json.dumps({str(k): v for k, v in sorted(marks.items())})


def decode_bookmarks(raw: str | None) -> dict[int, int]:
    """A bookmark that cannot be read is none: everything is read again, and positions keep it from applying twice."""
    if not raw:
        return {}
    try:
        return {int(k): int(v) for k, v in json.loads(raw).items()}
    except (ValueError, TypeError, AttributeError):
        logging.getLogger(__name__).warning("unreadable bookmark, reading everything: %r", raw)
        return {}


def files_after(zones: DataFrame, marks: dict[int, int]) -> DataFrame:
    """(source_table, file, n_rows, straddles) of the files to read beyond the bookmarks of one table's log."""
    spark = zones.sparkSession
    known = spark.createDataFrame(sorted(marks.items()), "kafka_partition int, seen long")
    # One row a source partition.
    joined = zones.join(F.broadcast(known), "kafka_partition", "left")
    left = F.col("seen").isNull() | (F.col("last_offset") > F.col("seen"))
    cut = F.col("seen").isNotNull() & (F.col("first_offset") <= F.col("seen"))
    found = joined.groupBy("source_table", "file").agg(F.sum("n_rows").alias("n_rows"), F.bool_or(left).alias("_left"), F.bool_or(cut).alias("straddles"))
    return found.where("_left").drop("_left")


def bookmarks_after(zones: DataFrame, marks: dict[int, int]) -> dict[int, int]:
    """Bookmarks once everything in the map has been read."""
    rows = zones.groupBy("kafka_partition").agg(F.max("last_offset").alias("last")).collect()
    return marks | {r.kafka_partition: max(r.last, marks.get(r.kafka_partition, r.last)) for r in rows}
