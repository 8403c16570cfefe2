"""Shuffled shards by a two-pass external shuffle.

Equal records are first counted, so that any number of copies is one row. Pass one scatters records into memory-sized
buckets by seeded hashes: shard by rendezvous hashing of the id, bucket by another hash of the record and of the
number of its group of copies, which holds COPIES at most. Pass two orders each bucket and runs a Fisher-Yates shuffle over it,
drawing from hashes of the seed, the bucket and the step, and numbers its records; bucket offsets make the numbers
gapless within a shard.

Law ``key``: the shard depends on the id and the shard count alone. With one more shard a record stays or
moves to the new shard, since rendezvous hashing keeps the scores of the old ones.

Slots depend on the rows, the seed and the bucket size alone: not on files, their order, partitions or settings.

Defined results: a null text has size 1 and checksum 0; a null id is hashed like any other value; repeated
rows each get a slot of their own; texts of any length are records like others; an empty table gives an empty
result. ``carry`` names further columns to take along, of types that can be grouped; input columns named like the operator's own
(``size``, ``shard``, ``slot``, ...) are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Copies of a record that share a bucket's group, and records of a bucket on average: a shuffle step copies its list.
COPIES, BUCKET_ROWS = 64, 1000
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is greatest."""
    scores = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*scores))["s"]


def fisher_yates(n: Column, *key: Column) -> Column:
    """A permutation of 0 to n - 1: from the last place down, each is swapped with one of those up to it, drawn by
    a hash of ``key`` and the place."""

    def swapped(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*key, i), i + 1).cast("int")
        parts = [
            F.slice(order, F.lit(1), j), F.array(F.element_at(order, i + 1)), F.slice(order, j + 2, i - j - 1),
            F.array(F.element_at(order, j + 1)), F.slice(order, i + 2, n - i - 1),
        ]
        return F.when(j < i, F.concat(*parts)).otherwise(order)

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), n - 1), swapped)


def shuffle_to_shards(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    bucket_bytes: int = 4 << 20,
    seed: int = 20240607,
) -> DataFrame:
    """Records with size, text_crc32, law, shard, slot and grown_shard, text and ``carry`` included."""
    total, rows = docs.agg(F.sum(record_size(F.col(text_col))), F.count("*")).first()
    buckets = max(1, math.ceil((total or 0) / shards / bucket_bytes), math.ceil(rows / shards / BUCKET_ROWS))
    extra = [c for c in carry if c.lower() not in OWN and c not in (id_col, text_col)]
    record = F.struct(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]
    )
    counted = docs.select(record.alias("record")).groupBy("record").agg(F.count("*").alias("n"))
    # Fewer copies to a group where they are long.
    most = F.greatest(F.lit(1), F.least(F.lit(COPIES), F.floor(F.lit(bucket_bytes) / record_size(F.col("record.text"))))).cast("long")
    groups = counted.select("record", "n", most.alias("most"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("group"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "record.id", "record.text", "group"), F.lit(buckets))
    # Never null, and known as such: a filter on one branch alone would keep the two from sharing the exchange.
    placed = groups.select(
        F.coalesce(rendezvous(F.col("record.id"), shards, seed), F.lit(0)).alias("shard"),
        F.coalesce(bucket.cast("int"), F.lit(0)).alias("bucket"),
        F.struct("record", F.least("most", F.col("n") - F.col("group") * F.col("most")).cast("int").alias("m")).alias("entry"),
    )
    filled = placed.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    filled = filled.select(
        "shard", "bucket", F.flatten(F.transform("entries", lambda e: F.array_repeat(e["record"], e["m"]))).alias("records")
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "bucket", F.size("records").cast("long").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    order = fisher_yates(F.size("records"), F.lit(seed + 2), F.col("shard"), F.col("bucket"))
    shuffled = filled.select("shard", "bucket", "records", order.alias("order"))
    out = shuffled.join(offsets, ["shard", "bucket"]).select("shard", "base", "records", F.posexplode("order").alias("at", "from"))
    out = out.select("shard", "base", "at", F.element_at("records", F.col("from") + 1).alias("r"))
    text = F.col("r.text")
    return out.select(
        F.col("r.id").alias(id_col),
        text.alias(text_col),
        *[F.col(f"r.x{i}").alias(c) for i, c in enumerate(extra)],
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("shard"),
        (F.col("base") + F.col("at")).cast("long").alias("slot"),
        rendezvous(F.col("r.id"), shards + 1, seed).alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows keep their slot, files stay within a bucket's size."""
    sharded.write.partitionBy("shard").parquet(path)
