"""Connected components of an edge table by alternating star contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut_at, discard


#: From so many edges on, minima are written before they are joined: a join of two plain exchanges, whose
#: large partitions adaptive execution splits, so that a hub's edges need not meet in one task.
WRITTEN_FROM = 10_000


def _least(edges: DataFrame, written: list[str] | None) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    if written is None:
        return low
    low, path = cut_at(low, "minima")
    written.append(path)
    return low


def _large_star(edges: DataFrame, written: list[str] | None) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both, written).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, written: list[str] | None) -> DataFrame:
    low = _least(edges, written)
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of any orderable type -> (node, component), component = smallest node reachable.

    Every round is written to the shared folder and the one before deleted; only a row count and a checksum
    reach the driver. No edges give no rows; an edge with a null end links nothing; repeated edges and loops
    change nothing.
    """
    spark = edges.sparkSession
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = cut_at(now, "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        # Smaller neighbours first: it gathers a node's many links to one before any join over both directions.
        old, written = [path], [] if state[0] >= WRITTEN_FROM else None
        if written is None:
            now, path = cut_at(_large_star(_small_star(now, None), None), "edges")
        else:
            small, between = cut_at(_small_star(now, written), "edges")
            now, path = cut_at(_large_star(small, written), "edges")
            old += [between, *written]
        for folder in old:
            discard(spark, folder)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
