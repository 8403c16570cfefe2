"""Tables published as numbered versions: files beside the old ones, then one atomic rename of a manifest.

``root/data/<id>`` holds a version's files and ``root/manifests/<number>.json`` names it. A reader takes the newest
manifest and so sees whole versions only; a manifest is renamed into place only where none has its number, so of two
writers that start from one version the second fails and its files are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import discard

VERSIONS = "number long, version string, n_rows long, note string, operation string, committed_at timestamp"
#: Rows of one file at most.
ROWS_PER_FILE = 1_000_000


class Conflict(RuntimeError):
    """Another writer published first."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _rename_if_absent(spark: SparkSession, source: str, target: str) -> None:
    fs_package = spark._jvm.org.apache.hadoop.fs
    rename = getattr(fs_package, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    at = fs_package.Path(target)
    context = fs_package.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else fs_package.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    context.rename(fs_package.Path(source), at, how)


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, False)
    out.write(bytearray(text.encode()))
    out.close()


def newest(spark: SparkSession, root: str) -> int:
    """The newest version's number; 0 where there is none."""
    fs, at = _fs(spark, f"{root}/manifests")
    if not fs.exists(at):
        return 0
    names = [str(s.getPath().getName()) for s in fs.listStatus(at)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def publish(
    df: DataFrame,
    root: str,
    partition: str | None = None,
    note: dict | None = None,
    operation: str | None = None,
    based_on: int | None = None,
) -> int:
    """Writes a new version and commits it; its number.

    ``note`` says where the version came from, such as an export's run and the applied position. ``based_on`` is the
    version that ``df`` was made from, the newest one by default: if another was committed since, Conflict is raised.
    Rows are dealt by ``partition``, a large value to several tasks, as adaptive execution sizes them.
    """
    spark = df.sparkSession
    before = newest(spark, root) if based_on is None else based_on
    version = uuid.uuid4().hex
    path = f"{root}/data/{version}"
    writer = (df.hint("rebalance", partition) if partition else df).write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).count()
    at = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).first()[0]
    done = operation or ("create" if before == 0 else "overwrite")
    manifest = {"number": before + 1, "version": version, "n_rows": rows, "note": json.dumps(note or {}, sort_keys=True), "operation": done, "committed_at": at}
    temporary = f"{root}/manifests/.{version}"
    _put(spark, temporary, json.dumps(manifest))
    try:
        _rename_if_absent(spark, temporary, f"{root}/manifests/{before + 1:012d}.json")
    except Exception as error:
        discard(spark, temporary)
        discard(spark, path)
        if newest(spark, root) > before:
            raise Conflict(f"version {before + 1} of {root} was published by another writer") from error
        raise
    return before + 1


def versions(spark: SparkSession, root: str) -> DataFrame | None:
    """Committed versions, one row each, with their commit time and what they came from."""
    return spark.read.schema(VERSIONS).json(f"{root}/manifests/*.json") if newest(spark, root) else None


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """The newest version's manifest, or a named one's; None where there is none."""
    number = newest(spark, root) if number is None else number
    fs, at = _fs(spark, f"{root}/manifests/{number:012d}.json")
    if not number or not fs.exists(at):
        return None
    row = spark.read.schema(VERSIONS).json(f"{root}/manifests/{number:012d}.json").first()
    return {**row.asDict(), "note": json.loads(row["note"])}


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The newest version, or a named one; later commits do not change what was opened."""
    found = manifest(spark, root, number)
    if found is None:
        raise ValueError(f"no version {number} under {root}" if number else f"nothing published under {root}")
    return spark.read.parquet(f"{root}/data/{found['version']}")


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the files and manifests of all but the newest ``keep`` versions; how many went."""
    last, gone = newest(spark, root), 0
    for number in range(last - keep, 0, -1):
        found = manifest(spark, root, number)
        if found is None:
            break
        discard(spark, f"{root}/manifests/{number:012d}.json")
        discard(spark, f"{root}/data/{found['version']}")
        gone += 1
    return gone
