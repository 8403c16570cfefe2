"""Global ranks and tiles without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import cut


def global_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """Row numbers from 1 over all rows. Rows are dealt by ranges of the order and numbered within a range;
    only the ranges' counts are summed in one place."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition of the exchange.
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + within).drop("_part", "_base")


def tile(rank: Column, rows: Column, tiles: int) -> Column:
    """The tile of a rank, as ``ntile`` deals them: the first tiles are longer by one."""
    short, longer = F.floor(rows / tiles), rows % tiles
    edge = longer * (short + 1)
    late = F.floor((rank - 1 - edge) / F.greatest(short, F.lit(1))) + longer + 1
    return F.when(rank <= edge, F.floor((rank - 1) / (short + 1)) + 1).otherwise(late).cast("int")
