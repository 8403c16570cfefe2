from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators.ranking import global_rank, tile


def test_ranks_and_tiles_equal_the_window(spark):
    for n in (0, 3, 10, 57, 200):
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(20)).alias("m"), "id")
        order = [F.desc("m"), F.col("id")]
        rows = global_rank(df, *order).withColumn("tile", tile(F.col("rank"), F.lit(n), 10))
        w = Window.orderBy(*order)
        want = df.withColumn("rank", F.row_number().over(w)).withColumn("tile", F.ntile(10).over(w))
        assert sorted(map(tuple, rows.select("m", "id", "rank", "tile").collect())) == sorted(map(tuple, want.select("m", "id", "rank", "tile").collect()))
