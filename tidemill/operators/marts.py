"""Daily marts: the rows of every fact under one another, each with its own measures, in one aggregation.

No fact is joined to another, so none is multiplied; a grain key that any fact holds is in the mart. Partial
aggregation runs before the one exchange, or the rows themselves are exchanged where hardly any share a key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalars import safe_divide

VIEWABLE_FROM = 0.5


@dataclass(frozen=True)
class Part:
    """A fact, what each of its rows adds to the measures, and columns whose distinct values are counted."""

    fact: DataFrame
    measures: dict[str, Column]
    distinct: dict[str, str] = field(default_factory=dict)


def _one_if(condition: Column) -> Column:
    return F.coalesce(condition.cast("long"), F.lit(0).cast("long"))


def impression_measures(viewable_from: float = VIEWABLE_FROM) -> dict[str, Column]:
    return {
        "impressions": F.lit(1).cast("long"),
        "measured_impressions": _one_if(F.col("viewability_score").isNotNull()),
        "viewable_impressions": _one_if(F.col("viewability_score") >= F.lit(viewable_from)),
        "clearing_cost": F.col("impression_cost"),
    }


def click_measures() -> dict[str, Column]:
    return {"clicks": F.lit(1).cast("long")}


def conversion_measures() -> dict[str, Column]:
    return {"conversions": F.lit(1).cast("long"), "conversion_value": F.col("conversion_value")}


def spend_measures() -> dict[str, Column]:
    of = lambda kind: F.when(F.col("billing_type") == kind, F.col("spend_amount"))
    return {"spend": F.col("spend_amount"), "cpm_spend": of("CPM"), "cpc_spend": of("CPC"), "cpa_spend": of("CPA")}


def grain_of(facts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Every grain key that occurs in any fact, once."""
    return reduce(DataFrame.union, [f.select(*keys) for f in facts]).distinct()


#: Rows that a task adds up at once, where they are brought together first.
ROWS_TOGETHER = 500_000


def build(parts: list[Part], keys: list[str], gather: list[str] | None = None, rows_expected: int = 0) -> DataFrame:
    """One row for each grain key of any fact; absent additive measures and distinct counts are zero.

    ``gather`` names the keys by which rows are brought together before anything is added up, for marts with almost
    as many keys as rows: partial sums would hold every row in memory and save no exchange, and distinct counts
    need no second one. Of ``rows_expected`` rows a task gets ROWS_TOGETHER or so, however many there are."""
    rows = [
        p.fact.select(*keys, *[m.alias(n) for n, m in p.measures.items()], *[F.col(c).alias(n) for n, c in p.distinct.items()])
        for p in parts
    ]
    names = [n for p in parts for n in p.measures]
    counted = [n for p in parts for n in p.distinct]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    if gather:
        every = every.repartition(max(1, -(-rows_expected // ROWS_TOGETHER)), *gather) if rows_expected else every.repartition(*gather)
    if gather and counted:
        found = _counted_in_place(every, keys, names, counted)
    else:
        found = every.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names], *[F.count_distinct(n).alias(n) for n in counted])
    kinds = dict(found.dtypes)
    return found.select(*keys, *[F.coalesce(F.col(n), F.lit(0).cast(kinds[n])).alias(n) for n in names], *counted)


def _counted_in_place(every: DataFrame, keys: list[str], names: list[str], counted: list[str]) -> DataFrame:
    """Sums and distinct counts of rows that lie together by the keys: one row for each combination of counted values,
    and a value counts in the first of its combinations."""
    shown = every.select(*keys, *counted)
    per = every.groupBy(*keys, *counted).agg(*[F.sum(n).alias(n) for n in names]) if names else shown.distinct()
    for n in counted:
        others = [c for c in counted if c != n]
        first = F.row_number().over(Window.partitionBy(*keys, n).orderBy(*others)) == 1 if others else F.lit(True)
        per = per.withColumn(f"_first_{n}", first & F.col(n).isNotNull())
    kinds = dict(per.dtypes)
    return per.groupBy(*keys).agg(
        *[F.sum(n).cast(kinds[n]).alias(n) for n in names], *[F.count_if(f"_first_{n}").alias(n) for n in counted]
    )


RATES: dict[str, tuple[str, str, int]] = {
    "viewability_rate": ("viewable_impressions", "measured_impressions", 1),
    "click_through_rate": ("clicks", "impressions", 1),
    "conversion_rate": ("conversions", "clicks", 1),
    "effective_cpm": ("spend", "impressions", 1000),
    "cost_per_click": ("spend", "clicks", 1),
    "cost_per_acquisition": ("spend", "conversions", 1),
    "return_on_ad_spend": ("conversion_value", "spend", 1),
    "average_clearing_cpm": ("clearing_cost", "impressions", 1000),
    "return_on_clearing_cost": ("conversion_value", "clearing_cost", 1),
}


def with_rates(mart: DataFrame, digits: int = 8) -> DataFrame:
    """Every rate whose components the mart holds; null, never zero, where the denominator is zero."""
    have = set(mart.columns)
    return mart.select(
        "*",
        *[
            F.round(safe_divide(F.col(n), F.col(d)) * factor, digits).alias(name)
            for name, (n, d, factor) in RATES.items()
            if n in have and d in have
        ],
    )


def reaggregate(mart: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """A longer period from summed components; rates come anew, never from averages."""
    return with_rates(mart.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in components]))


def look_up(mart: DataFrame, dimension: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """A star lookup; a dimension small enough is broadcast by the optimiser, a large one is not."""
    return mart.join(dimension.select(key, *attributes), key, "left")


def drift(mart: DataFrame, facts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Totals of mart components against the facts they came from: name, mart_total, fact_total."""
    totals = mart.agg(*[F.sum(n).cast("decimal(30,6)").alias(n) for n in facts])
    left = totals.select(F.explode(F.create_map(*[x for n in facts for x in (F.lit(n), F.col(n))])).alias("name", "mart_total"))
    parts = [f.agg(m.cast("decimal(30,6)").alias("fact_total")).select(F.lit(n).alias("name"), "fact_total") for n, (f, m) in facts.items()]
    return left.join(reduce(DataFrame.union, parts), "name")


def broken_invariants(mart: DataFrame) -> DataFrame:
    """How many rows break each rule of a mart: spend is the sum of its types, viewable impressions are measured
    and measured ones impressions, and a rate is null just where its denominator is zero."""
    have = set(mart.columns)
    rules = {}
    if {"spend", "cpm_spend", "cpc_spend", "cpa_spend"} <= have:
        rules["spend_not_sum_of_types"] = F.col("spend") != F.col("cpm_spend") + F.col("cpc_spend") + F.col("cpa_spend")
    if {"viewable_impressions", "measured_impressions", "impressions"} <= have:
        rules["viewable_above_measured"] = F.col("viewable_impressions") > F.col("measured_impressions")
        rules["measured_above_impressions"] = F.col("measured_impressions") > F.col("impressions")
    for name, (_, below, _) in RATES.items():
        if name in have and below in have:
            rules[f"{name}_without_denominator"] = F.col(name).isNull() != (F.col(below) == 0)
    return mart.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])
