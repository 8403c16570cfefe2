"""Billing lines from delivery: hourly CPM roll-ups, CPC per click, CPA per conversion.

A campaign is billed one way, by its bid strategy; delivery of campaigns billed another way gives no line, and
neither does a strategy that is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How each bid strategy is billed.
BILLED_AS = {"CPM": "CPM", "CPC": "CPC", "CPA": "CPA", "TARGET_ROAS": "CPA", "MAX_CONVERSIONS": "CPA"}


def billing_type(strategy: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in BILLED_AS.items() for x in pair]), strategy)


def billed_as(campaigns: DataFrame, kind: str) -> DataFrame:
    """The campaigns that are billed as ``kind``."""
    return campaigns.where(billing_type(F.col("bid_strategy")) == kind).select("campaign_id")


def hourly_cpm(impressions: DataFrame, campaigns: DataFrame, cutoff: Column) -> DataFrame:
    """Clearing cost per line item, publisher, currency and hour of CPM campaigns; made an hour later or at the cutoff."""
    hour = F.date_trunc("hour", "impression_timestamp")
    cost = (F.col("clearing_price") / 1000).cast("decimal(18,9)")
    own = impressions.join(billed_as(campaigns, "CPM"), "campaign_id", "left_semi")
    out = own.groupBy("campaign_id", "line_item_id", "publisher_id", "currency", hour.alias("spend_timestamp")).agg(
        F.sum(cost).alias("spend_amount"), F.count("*").alias("impressions")
    )
    return out.withColumn("created_at", F.least(F.col("spend_timestamp") + F.expr("interval 1 hour"), cutoff))


def per_impression(impressions: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One line for each impression of CPM campaigns."""
    own = impressions.join(billed_as(campaigns, "CPM"), "campaign_id", "left_semi")
    return own.select(
        "impression_id", "campaign_id", "line_item_id", (F.col("clearing_price") / 1000).cast("decimal(18,9)").alias("spend_amount")
    )


def per_event(events: DataFrame, campaigns: DataFrame, line_items: DataFrame, kind: str, event_id: str) -> DataFrame:
    """One charge at the line item's bid for each event of a campaign billed as ``kind``."""
    bids = line_items.select("line_item_id", "bid_amount", "bid_currency")
    return (
        events.join(billed_as(campaigns, kind), "campaign_id", "left_semi")
        .join(bids, "line_item_id")
        .select(event_id, "campaign_id", "line_item_id", F.lit(kind).alias("billing_type"), F.col("bid_amount").alias("spend_amount"), F.col("bid_currency").alias("currency"))
    )
