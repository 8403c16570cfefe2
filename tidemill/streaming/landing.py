"""Landing a change topic: messages flattened to change records, written by table and event day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "key string, value string, topic string, partition int, offset long, ingested_at_ms long"


#: The operation of an envelope that names none, and of a null value.
UNKNOWN_OP, TOMBSTONE = "?", "t"
#: The operation and table of messages that are no JSON object.
DEAD_OP, DEAD_TABLE = "!", "dead_letters"


def table_of_topic(topic: str = "topic") -> Column:
    """The last of three or more dotted parts, else the topic itself."""
    parts = F.split(topic, r"\.")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(F.col(topic))


def flatten(messages: DataFrame) -> DataFrame:
    """Messages -> the 13 columns of a change record, one for each message.

    A null value is a tombstone. Payloads become canonical: keys of every object sorted, no spaces, numbers by
    their value, so equal payloads are equal texts. An envelope without an operation has ``?``; its table is that of
    its source, else of its topic; its transaction is the source's, else the first part of the transaction block's
    id. A value that is no JSON object (an object with a key twice is none) is a record of the table
    ``dead_letters`` with the operation ``!`` and the whole value as its payload: nothing is lost or holds up
    the stream, and the landed folder of that table is what is to be looked at.
    """
    parsed = messages.withColumn("_v", F.try_parse_json("value"))
    parsed = parsed.withColumn("_whole", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT<"), F.lit(False)))
    text = lambda p: F.nullif(F.try_variant_get("_v", p, "string"), F.lit(""))
    number = lambda p: text(p).try_cast("long")
    payload = lambda p: F.nullif(F.to_json(F.try_variant_get("_v", p, "variant")), F.lit("null"))
    gone, whole = F.col("value").isNull(), F.col("_whole")
    transaction = F.coalesce(F.nullif(number("$.source.txId"), F.lit(0)), F.element_at(F.split(text("$.transaction.id"), ":"), 1).try_cast("long"))
    return parsed.select(
        F.when(gone, TOMBSTONE).when(~whole, DEAD_OP).otherwise(F.coalesce(text("$.op"), F.lit(UNKNOWN_OP))).alias("op"),
        F.when(whole, text("$.source.schema")).alias("source_schema"),
        F.when(~gone & ~whole, DEAD_TABLE).otherwise(F.coalesce(F.when(whole, text("$.source.table")), table_of_topic())).alias("source_table"),
        F.when(whole, number("$.ts_ms")).alias("event_ts_ms"),
        F.when(whole, number("$.source.lsn")).alias("lsn"),
        F.when(whole, transaction).alias("tx_id"),
        "key",
        F.when(whole, payload("$.before")).alias("before_json"),
        F.when(whole, payload("$.after")).otherwise(F.col("value")).alias("after_json"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        "ingested_at_ms",
    )


def event_day(event_ts_ms: str = "event_ts_ms", ingested_at_ms: str = "ingested_at_ms") -> Column:
    """The day a change happened, or was taken in if it carries no time."""
    return F.to_date(F.timestamp_millis(F.coalesce(event_ts_ms, ingested_at_ms)))


def with_day(records: DataFrame) -> DataFrame:
    return records.withColumn("dt", event_day())


def kafka_messages(spark: SparkSession, servers: str, pattern: str, most: int = 5000) -> DataFrame:
    """A topic stream, where the connector is installed."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", pattern)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", most)
        .load()
    )
    return raw.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset",
        F.unix_millis("timestamp").alias("ingested_at_ms"),
    )


def file_messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Messages from Parquet files as a stream."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def land(messages: DataFrame, path: str, checkpoint: str, drain: bool = True, seconds: int = 300) -> StreamingQuery:
    """Writes records by table and day. The checkpoint holds the offsets: files first, offsets after, and a
    restart adds nothing twice. ``drain`` reads what is there and ends."""
    writer = (
        with_day(flatten(messages))
        .writeStream.format("parquet")
        .partitionBy("source_table", "dt")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{seconds} seconds")).start()


def event_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event time and kind, closed when the watermark passes; for monitoring, never for selection."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
