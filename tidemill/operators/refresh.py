"""A refresh of current-state tables that acts: what each needs is decided from its newest version, done and published.

A version's note holds the export it was built on and the bookmarks of the log; the applied position is read back
from its rows. Bookmarks choose files and may be lost; positions decide what is applied. A run that dies leaves the old version, and the next one does the work again.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import changelog
from tidemill.operators.stored import observed_merge
from tidemill.session import cut_at, discard
from tidemill.sources import offsets, versions


@dataclass
class Export:
    """A table's export: its rows as of a position in the log. An append-only table has no log."""

    table: str
    pk: str
    rows: DataFrame
    run_id: str
    position: int
    append_only: bool = False


@dataclass
class Done:
    source_table: str
    mode: str
    reason: str
    files: int = 0
    merged: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    n_rows: int = 0
    version: int = 0


REPORT = "source_table string, mode string, reason string, files int, merged long, inserted long, updated long, deleted long, n_rows long, version long"


def plan(export: Export, note: dict | None, n_files: int, forced: bool) -> tuple[str, str]:
    """(mode, reason) from what a table's newest version says and the files that its bookmarks leave."""
    if forced:
        return "rebuild", "forced"
    if note is None:
        return "bootstrap", "no table yet"
    if note.get("run_id") != export.run_id:
        return "rebuild", f"snapshot export changed: {note.get('run_id')} -> {export.run_id}"
    if export.append_only:
        return "skip", "append-only, export unchanged"
    return ("incremental", f"{n_files} new change files") if n_files else ("skip", "no new change events")


def refresh_table(spark: SparkSession, root: str, export: Export, log: str, zones: DataFrame, forced: bool = False) -> Done:
    """Brings one table up to the log."""
    home = f"{root}/{export.table}"
    found = versions.manifest(spark, home)
    note = None if found is None else found["note"]
    own = zones.where(F.col("source_table") == export.table)
    marks = offsets.decode_bookmarks((note or {}).get("offsets"))
    full = forced or note is None or note.get("run_id") != export.run_id
    # As many names as the table's log has files.
    files = [] if export.append_only else [r.file for r in offsets.files_after(own, {} if full else marks).collect()]
    mode, reason = plan(export, note, len(files), forced)
    done = Done(export.table, mode, reason)
    if mode == "skip":
        done.n_rows, done.version = found["n_rows"], found["number"]
        return done
    done.files = len(files)
    events = offsets.read_files(spark, log, files)
    said = {"run_id": export.run_id, "offsets": offsets.encode_bookmarks(offsets.bookmarks_after(own, {} if full else marks))}
    base = found["number"] if found else 0
    if full:
        rows = changelog.reconcile_table(export.rows, events if files else None, export.pk, export.position)
        done.version = versions.publish(rows, home, note=said, operation="create" if found is None else "rebuild", based_on=base)
    else:
        current = versions.read_version(spark, home, base)
        applied = current.agg(F.max("_lsn")).first()[0]
        after = max(export.position, export.position if applied is None else applied)
        batch, folder = cut_at(changelog.collapse_changes(events, export.pk, export.rows.schema, after), "refresh-batch")
        rows, seen = observed_merge(current, batch.select(*current.columns), export.pk, "is_deleted")
        done.version = versions.publish(rows, home, note=said, operation="merge", based_on=base)
        counts = seen.get
        done.merged = batch.count()
        done.updated, done.deleted = counts["updated"], counts["deleted"]
        done.inserted = done.merged - done.updated - done.deleted
        discard(spark, folder)
    done.n_rows = versions.manifest(spark, home, done.version)["n_rows"]
    return done


def refresh(spark: SparkSession, root: str, exports: list[Export], log: str, forced: tuple[str, ...] = ()) -> DataFrame:
    """Every table in turn -> REPORT, one row each. ``log`` is a landed log; its zone map is kept under ``root``."""
    zones = offsets.update_map(spark, log, f"{root}/zones")
    done = [refresh_table(spark, root, e, log, zones, e.table in forced) for e in exports]
    return spark.createDataFrame([tuple(asdict(x).values()) for x in done], REPORT)
