"""Type 1 dimensions with an unknown member, and the date dimension."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalars import UNKNOWN, calendar, date_key, or_unknown, surrogate_key


@dataclass(frozen=True)
class Dimension:
    """A member table as a dimension: key, parents by natural key, attributes and unknown values."""

    name: str
    natural_key: str
    parents: dict[str, str] = field(default_factory=dict)  # output key column -> parent's natural key
    attributes: tuple[str, ...] = ()
    unknown: dict[str, object] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"{self.name}_key"


def type1(members: DataFrame, dim: Dimension) -> DataFrame:
    """One row per member, deleted ones too, and one unknown row typed like the members."""
    rows = members.select(
        surrogate_key(F.col(dim.natural_key)).alias(dim.key),
        F.col(dim.natural_key),
        *[or_unknown(surrogate_key_or_null(natural)).alias(out) for out, natural in dim.parents.items()],
        *dim.attributes,
    )
    kinds = dict(rows.dtypes)

    def blank(column: str):
        if column == dim.key or column in dim.parents or column == dim.natural_key:
            return F.lit(UNKNOWN)
        value = dim.unknown.get(column, "Unknown" if kinds[column] == "string" else None)
        return F.lit(value)

    one = members.sparkSession.range(1).select(*[blank(c).cast(kinds[c]).alias(c) for c in rows.columns])
    return rows.unionByName(one)


def surrogate_key_or_null(natural: str):
    return F.when(F.col(natural).isNotNull(), surrogate_key(F.col(natural)))


def date_dimension(days: DataFrame, day: str = "day") -> DataFrame:
    """Calendar parts for a table of days."""
    return days.select(date_key(F.col(day)).alias("date_key"), F.col(day).alias("date_day"), *calendar(F.col(day)))


def day_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last``, the end exclusive, of a one-row table."""
    days = F.sequence(F.col(first), F.date_sub(F.col(last), 1), F.expr("interval 1 day"))
    return bounds.where(F.col(first) < F.col(last)).select(F.explode(days).alias("day"))


ADVERTISER = Dimension("advertiser", "advertiser_id", {}, ("advertiser_name", "industry", "billing_country", "billing_currency", "account_status"), {"billing_currency": "XXX"})
CAMPAIGN = Dimension("campaign", "campaign_id", {"advertiser_key": "advertiser_id"}, ("campaign_name", "campaign_objective", "campaign_status", "campaign_budget", "daily_budget", "bid_strategy", "start_date", "end_date"), {"campaign_budget": 0, "daily_budget": 0})
LINE_ITEM = Dimension("line_item", "line_item_id", {"campaign_key": "campaign_id"}, ("line_item_name", "line_item_status", "bid_amount", "bid_currency", "optimization_goal", "target_cpm", "frequency_cap", "start_date", "end_date"), {"bid_amount": 0, "bid_currency": "XXX", "target_cpm": 0, "frequency_cap": 0})
CREATIVE = Dimension("creative", "creative_id", {"advertiser_key": "advertiser_id"}, ("creative_name", "creative_type", "creative_format", "landing_page_url", "creative_status"))
PUBLISHER = Dimension("publisher", "publisher_id", {}, ("publisher_name", "publisher_type", "country", "domain", "publisher_status"))
PLACEMENT = Dimension("placement", "placement_id", {"publisher_key": "publisher_id"}, ("placement_name", "placement_type", "ad_format", "floor_price", "currency", "device_type"), {"floor_price": 0, "currency": "XXX"})
AUDIENCE = Dimension("audience", "audience_id", {}, ("audience_name", "audience_type", "min_age", "max_age", "gender", "country", "interest_category"), {"min_age": 13, "max_age": 99})
DIMENSIONS = {d.name: d for d in (ADVERTISER, CAMPAIGN, LINE_ITEM, CREATIVE, PUBLISHER, PLACEMENT, AUDIENCE)}
