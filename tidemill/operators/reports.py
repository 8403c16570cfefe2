"""Reporting queries over the advertising tables. Children are aggregated before they meet their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import hours_between, safe_divide
from tidemill.operators.ranking import global_rank, tile

Tables = dict[str, DataFrame]


def _funnel(t: Tables, *keys: str) -> DataFrame:
    """Impressions, clicks and conversions per key of the impression."""
    clicks = t["clicks"].groupBy("impression_id").agg(F.count("*").alias("k"))
    conversions = t["conversions"].groupBy("impression_id").agg(F.count("*").alias("v"))
    joined = t["impressions"].join(clicks, "impression_id", "left").join(conversions, "impression_id", "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("impressions"), F.coalesce(F.sum("k"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("v"), F.lit(0)).alias("conversions")
    )


def headline(t: Tables, k: int = 10) -> DataFrame:
    """R1: top advertiser x campaign by spend, with the funnel's distinct counts."""
    spend = t["spend_transactions"].groupBy("campaign_id").agg(F.sum("spend_amount").alias("spend"))
    funnel = _funnel(t, "campaign_id")
    names = t["campaigns"].join(t["advertisers"], "advertiser_id").select("campaign_id", "advertiser_name", "campaign_name")
    out = names.join(funnel, "campaign_id").join(spend, "campaign_id", "left")
    return out.orderBy(F.desc_nulls_last("spend"), "campaign_id").limit(k)


def campaign_metrics(t: Tables, least: int = 1000) -> DataFrame:
    """R2: rates per campaign with more than ``least`` impressions."""
    spend = t["spend_transactions"].groupBy("campaign_id").agg(F.sum("spend_amount").alias("spend"))
    value = t["conversions"].groupBy("campaign_id").agg(F.sum("conversion_value").alias("value"))
    m = _funnel(t, "campaign_id").where(F.col("impressions") > least).join(spend, "campaign_id", "left").join(value, "campaign_id", "left")
    i, c, v, s = (F.col(x) for x in ("impressions", "clicks", "conversions", "spend"))
    return m.select(
        "campaign_id", i, c, v,
        F.round(safe_divide(c, i), 6).alias("ctr"), F.round(safe_divide(v, c), 6).alias("cvr"),
        F.round(safe_divide(s, i) * 1000, 7).alias("cpm"), F.round(safe_divide(s, c), 7).alias("cpc"),
        F.round(safe_divide(s, v), 7).alias("cpa"), F.round(safe_divide(F.col("value"), s), 6).alias("roas"),
    )


def creative_ctr(t: Tables, least: int = 500) -> DataFrame:
    """R3: click-through rate by creative type and format."""
    per = _funnel(t, "creative_id")
    out = per.join(t["creatives"].select("creative_id", "creative_type", "creative_format"), "creative_id")
    out = out.groupBy("creative_type", "creative_format").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return out.where(F.col("impressions") > least).withColumn("ctr", F.round(safe_divide(F.col("clicks"), F.col("impressions")), 6))


def publisher_share(t: Tables, k: int = 20) -> DataFrame:
    """R4: share of all spend by publisher; the total is one row, not a window over all."""
    per = t["spend_transactions"].groupBy("publisher_id").agg(F.sum("spend_amount").alias("spend"))
    total = per.agg(F.sum("spend").alias("total"))
    out = per.crossJoin(F.broadcast(total)).withColumn("share", F.round(safe_divide(F.col("spend"), F.col("total")), 8))
    return out.select("publisher_id", "spend", "share").orderBy(F.desc("spend"), "publisher_id").limit(k)


def audience_rates(t: Tables) -> DataFrame:
    """R5: click-through and conversion rates by audience."""
    out = _funnel(t, "audience_id").join(t["audiences"].select("audience_id", "audience_name"), "audience_id", "left")
    return out.select(
        "audience_id", "audience_name", "impressions", "clicks",
        F.round(safe_divide(F.col("clicks"), F.col("impressions")), 6).alias("ctr"),
        F.round(safe_divide(F.col("conversions"), F.col("clicks")), 6).alias("cvr"),
    )


def device_geography(t: Tables, least: int = 1000, k: int = 12) -> DataFrame:
    """R6: delivery by device and country."""
    out = _funnel(t, "device_type", "country").where(F.col("impressions") > least)
    return out.select("device_type", "country", "impressions", "clicks").orderBy(F.desc("impressions"), "device_type", "country").limit(k)


def daily_trend(t: Tables, k: int = 30) -> DataFrame:
    """R7: the newest days with their weekday."""
    day = F.to_date("impression_timestamp").alias("day")
    out = t["impressions"].groupBy(day).agg(F.count("*").alias("impressions"), F.sum("clearing_price").alias("clearing"))
    return out.select("day", F.date_format("day", "E").alias("weekday"), "impressions", "clearing").orderBy(F.desc("day")).limit(k)


def delivery_deciles(t: Tables) -> DataFrame:
    """R8: campaigns by decile of delivery; ranks run by ranges of the pre-aggregated table."""
    per = t["impressions"].groupBy("campaign_id").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"), F.count("*").alias("n_keys"))
    ranked = global_rank(per, F.desc("n"), F.col("campaign_id")).crossJoin(F.broadcast(total.select("n_keys")))
    out = ranked.withColumn("decile", tile(F.col("rank"), F.col("n_keys"), 10)).groupBy("decile").agg(F.count("*").alias("campaigns"), F.sum("n").alias("impressions"))
    return out.crossJoin(F.broadcast(total)).select("decile", "campaigns", "impressions", F.round(safe_divide(F.col("impressions"), F.col("total")), 8).alias("share"))


def attribution_lags(t: Tables) -> DataFrame:
    """R9: hours from impression and click to conversion."""
    clicks = t["clicks"].select("click_id", "click_timestamp")
    impressions = t["impressions"].select("impression_id", "impression_timestamp")
    out = t["conversions"].join(clicks, "click_id").join(impressions, "impression_id")
    return out.select(
        "conversion_id",
        hours_between(F.col("click_timestamp"), F.col("conversion_timestamp")).alias("hours_from_click"),
        hours_between(F.col("impression_timestamp"), F.col("conversion_timestamp")).alias("hours_from_impression"),
    )


def spend_by_type(t: Tables) -> DataFrame:
    """R10: lines, spend and lines with an impression by billing type."""
    return t["spend_transactions"].groupBy("billing_type").agg(
        F.count("*").alias("lines"), F.sum("spend_amount").alias("spend"), F.count("impression_id").alias("with_impression")
    )


def funnel_totals(t: Tables) -> DataFrame:
    """Q5: counts, spend, value and rates of the whole funnel."""
    i = t["impressions"].agg(F.count("*").alias("impressions"))
    k = t["clicks"].agg(F.count("*").alias("clicks"))
    v = t["conversions"].agg(F.count("*").alias("conversions"), F.sum("conversion_value").alias("value"))
    s = t["spend_transactions"].agg(F.sum("spend_amount").alias("spend"))
    out = i.crossJoin(k).crossJoin(v).crossJoin(s)
    return out.select(
        "impressions", "clicks", "conversions", F.col("value").cast("double").alias("value"), F.col("spend").cast("double").alias("spend"),
        F.round(safe_divide(F.col("clicks"), F.col("impressions")), 8).alias("ctr"),
        F.round(safe_divide(F.col("conversions"), F.col("clicks")), 8).alias("cvr"),
        F.round(safe_divide(F.col("spend"), F.col("impressions")) * 1000, 6).alias("cpm"),
        F.round(safe_divide(F.col("value"), F.col("spend")), 8).alias("roas"),
    )


def ctr_spread(t: Tables, least: int = 100) -> DataFrame:
    """Q6: least, median and greatest click-through rate of publishers, and placements per publisher."""
    per = _funnel(t, "publisher_id").where(F.col("impressions") >= least)
    rates = per.select((F.col("clicks") / F.col("impressions")).alias("ctr"))
    children = t["placements"].groupBy("publisher_id").agg(F.count("*").alias("n"))
    return rates.agg(
        F.round(F.min("ctr"), 8).alias("min_ctr"), F.round(F.percentile("ctr", F.lit(0.5)), 8).alias("median_ctr"), F.round(F.max("ctr"), 8).alias("max_ctr")
    ).crossJoin(children.agg(F.round(F.avg("n"), 4).alias("avg_placements"), F.max("n").alias("max_placements")))
