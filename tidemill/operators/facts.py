"""Fact builders, and events resolved to what they inherit from their impression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import UNKNOWN, date_key, elapsed, impression_cost, or_unknown, surrogate_key, version_key
from tidemill.operators.dims import surrogate_key_or_null
from tidemill.operators.history import as_of_join, as_of_time


def hashed_keys(*entities: str) -> list:
    return [or_unknown(surrogate_key_or_null(f"{e}_id")).alias(f"{e}_key") for e in entities]


def _versions(events: DataFrame, ts: str, histories: dict[str, DataFrame]) -> DataFrame:
    """One as-of join for each entity history given. Of ``member_versions``, which have no key yet, the capture's time is
    joined, which is shorter, and the key is made of it after the last join."""
    made = {}
    for entity, history in histories.items():
        key, own = f"{entity}_version_key", f"{entity}_id"
        if key in history.columns:
            events = as_of_join(events, history, own, ts, key, key)
        else:
            events = as_of_time(events, history, own, ts, "captured_at", key)
            made[key] = or_unknown(F.when(F.col(key).isNotNull(), version_key(F.col(own), F.col(key))))
    return events.withColumns(made) if made else events


def impressions(events: DataFrame, histories: dict[str, DataFrame] | None = None) -> DataFrame:
    out = _versions(events, "impression_timestamp", histories or {})
    entities = ("campaign", "line_item", "advertiser", "creative", "publisher", "placement", "audience")
    return out.select(
        surrogate_key(F.col("impression_id")).alias("impression_key"),
        date_key(F.col("impression_timestamp")).alias("date_key"),
        *hashed_keys(*entities),
        *[f"{e}_version_key" for e in histories or {}],
        "impression_id",
        "impression_timestamp",
        *[c for c in ("device_type", "operating_system", "browser", "country", "city") if c in events.columns],
        "currency",
        "bid_price",
        "clearing_price",
        impression_cost(F.col("clearing_price")).alias("impression_cost"),
        "viewability_score",
    )


def clicks(events: DataFrame, histories: dict[str, DataFrame] | None = None) -> DataFrame:
    """Factless: keys and ids only."""
    out = _versions(events, "click_timestamp", histories or {})
    return out.select(
        surrogate_key(F.col("click_id")).alias("click_key"),
        date_key(F.col("click_timestamp")).alias("date_key"),
        *hashed_keys("campaign", "line_item", "advertiser", "creative"),
        *[f"{e}_version_key" for e in histories or {}],
        "click_id",
        "impression_id",
        "click_timestamp",
        *[c for c in ("device_type", "country") if c in events.columns],
    )


def conversions(events: DataFrame, histories: dict[str, DataFrame] | None = None) -> DataFrame:
    out = _versions(events, "conversion_timestamp", histories or {})
    return out.select(
        surrogate_key(F.col("conversion_id")).alias("conversion_key"),
        date_key(F.col("conversion_timestamp")).alias("date_key"),
        *hashed_keys("campaign", "advertiser"),
        *[f"{e}_version_key" for e in histories or {}],
        "conversion_id",
        "click_id",
        "impression_id",
        "conversion_type",
        "conversion_timestamp",
        "conversion_value",
        "currency",
    )


def spend(events: DataFrame, histories: dict[str, DataFrame] | None = None) -> DataFrame:
    out = _versions(events, "spend_timestamp", histories or {})
    return out.select(
        surrogate_key(F.col("spend_transaction_id")).alias("spend_key"),
        date_key(F.col("spend_timestamp")).alias("date_key"),
        *hashed_keys("campaign", "line_item", "advertiser", "publisher"),
        *[f"{e}_version_key" for e in histories or {}],
        "spend_transaction_id",
        "impression_id",
        "billing_type",
        "spend_amount",
        "currency",
    )


def _inherit(events: DataFrame, parents: DataFrame, names: dict[str, str]) -> DataFrame:
    """Left join on the impression; keys that cannot be inherited are unknown."""
    picked = parents.select(F.col("impression_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in names])
    joined = events.join(picked, F.col("impression_id") == F.col("_id"), "left")
    keys = [(or_unknown(F.col(f"_{c}")) if kind == "key" else F.col(f"_{c}")).alias(c) for c, kind in names.items()]
    return joined.select(*events.columns, *keys)


def resolve_clicks(click_facts: DataFrame, impression_facts: DataFrame) -> DataFrame:
    """Clicks with publisher, placement, audience and currency of their impression, and the lag to it."""
    names = {"publisher_key": "key", "placement_key": "key", "audience_key": "key", "currency": "value", "impression_timestamp": "value"}
    out = _inherit(click_facts, impression_facts, names)
    return out.withColumn("seconds_to_click", elapsed("SECOND", F.col("impression_timestamp"), F.col("click_timestamp"))).drop("impression_timestamp")


def resolve_conversions(conversion_facts: DataFrame, impression_facts: DataFrame) -> DataFrame:
    """Conversions with five inherited keys and the lag in hours."""
    names = {k: "key" for k in ("line_item_key", "creative_key", "publisher_key", "placement_key", "audience_key")}
    out = _inherit(conversion_facts, impression_facts, names | {"impression_timestamp": "value"})
    return out.withColumn("hours_to_conversion", elapsed("HOUR", F.col("impression_timestamp"), F.col("conversion_timestamp"))).drop("impression_timestamp")


def unresolved(resolved: DataFrame, key: str) -> DataFrame:
    return resolved.where(F.col(key) == UNKNOWN).groupBy(key).agg(F.count("*").alias("n"))


def by_member(impression_events: DataFrame, click_events: DataFrame, conversion_events: DataFrame, spend_events: DataFrame) -> dict[str, DataFrame]:
    """The facts' rows for marts: day, currency, measures, and members by their own ids, which are shorter than the keys
    made of them. Clicks and conversions are one table of responses, by ``kind``, and inherit what ``resolve_clicks`` and
    ``resolve_conversions`` give them by one join."""
    day = lambda ts: date_key(F.col(ts)).alias("date_key")
    own = {"campaign_id": "string", "advertiser_id": "string", "line_item_id": "string", "creative_id": "string", "currency": "string"}
    known = {"click": ("campaign_id", "advertiser_id", "line_item_id", "creative_id"), "conversion": ("campaign_id", "advertiser_id", "currency")}

    def response(events: DataFrame, kind: str, value: Column) -> DataFrame:
        taken = [(F.col(c) if c in known[kind] else F.lit(None)).cast(k).alias(c) for c, k in own.items()]
        return events.select(
            F.col(f"{kind}_id").alias("event_id"), F.lit(kind).alias("kind"), day(f"{kind}_timestamp"), F.col("impression_id").alias("_parent"), *taken,
            value.cast(conversion_events.schema["conversion_value"].dataType).alias("conversion_value"),
        )

    both = response(click_events, "click", F.lit(None)).unionByName(response(conversion_events, "conversion", F.col("conversion_value")))
    lent = ("line_item_id", "creative_id", "publisher_id", "placement_id", "audience_id", "currency")
    parents = impression_events.select("impression_id", *[F.col(c).alias(f"_{c}") for c in lent])
    joined = both.join(parents, F.col("_parent") == F.col("impression_id"), "left")
    clicked = F.col("kind") == "click"
    mixed = {c: F.when(clicked, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("line_item_id", "creative_id")}
    mixed["currency"] = F.when(clicked, F.col("_currency")).otherwise(F.col("currency"))
    responses = joined.select(
        "event_id", "kind", "date_key", "campaign_id", "advertiser_id", *[m.alias(c) for c, m in mixed.items()],
        *[F.col(f"_{c}").alias(c) for c in ("publisher_id", "placement_id", "audience_id")], "conversion_value",
    )
    members = ("campaign_id", "line_item_id", "advertiser_id", "creative_id", "publisher_id", "placement_id", "audience_id")
    return {
        "impressions": impression_events.select(
            F.col("impression_id").alias("event_id"), day("impression_timestamp"), *members, "currency", "viewability_score",
            impression_cost(F.col("clearing_price")).alias("impression_cost"),
        ),
        "responses": responses,
        "spend": spend_events.select(
            F.col("spend_transaction_id").alias("event_id"), day("spend_timestamp"), "campaign_id", "line_item_id", "advertiser_id", "publisher_id",
            "currency", "billing_type", "spend_amount",
        ),
    }
