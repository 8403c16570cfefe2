"""Column functions shared by facts, dimensions and marts."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Key of the unknown member; not hexadecimal, so no hashed key equals it.
UNKNOWN = "UNKNOWN"
#: What a null part of a natural key is hashed as.
NULL_PART = "_dbt_utils_surrogate_key_null_"


def date_key(ts: Column) -> Column:
    """Year, month and day of a timestamp as one number, e.g. 20240131."""
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts)


def date_key_lookback(key: Column, days: int) -> Column:
    """The date key ``days`` earlier; null gives 0, the beginning."""
    day = F.date_sub(F.to_date(key.cast("string"), "yyyyMMdd"), days)
    return F.coalesce(date_key(day), F.lit(0))


def safe_divide(n: Column, d: Column) -> Column:
    """A double, or null where the denominator is null or zero."""
    return F.when(d != 0, n.cast("double") / d.cast("double"))


def surrogate_key(*parts: Column) -> Column:
    """MD5 of the parts as text, joined by ``-``."""
    texts = [F.coalesce(p.cast("string"), F.lit(NULL_PART)) for p in parts]
    return F.md5(F.concat_ws("-", *texts))


def timestamp_text(ts: Column) -> Column:
    """One text form of a timestamp on every engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def version_key(natural: Column, captured_at: Column) -> Column:
    return surrogate_key(natural, timestamp_text(captured_at))


def or_unknown(key: Column) -> Column:
    return F.coalesce(key, F.lit(UNKNOWN))


def end_of_time() -> Column:
    return F.to_timestamp(F.lit("9999-12-31 00:00:00"))


def beginning_of_time() -> Column:
    return F.to_timestamp(F.lit("1900-01-01 00:00:00"))


def strict_greatest(*columns: Column) -> Column:
    """Greatest, null if any argument is null."""
    return _strict(F.greatest(*columns), columns)


def strict_least(*columns: Column) -> Column:
    return _strict(F.least(*columns), columns)


def _strict(value: Column, columns: tuple[Column, ...]) -> Column:
    anyone = F.lit(False)
    for c in columns:
        anyone = anyone | c.isNull()
    return F.when(~anyone, value)


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Whole units between two timestamps."""
    return F.timestamp_diff(unit, start, end)


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """Unit boundaries crossed between two timestamps."""
    return F.timestamp_diff(unit, F.date_trunc(unit, start), F.date_trunc(unit, end))


def hours_between(start: Column, end: Column, digits: int = 2) -> Column:
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return F.round(seconds / 3600, digits)


def impression_cost(clearing_price: Column) -> Column:
    """A price is for a thousand impressions."""
    return clearing_price / F.lit(1000).cast("decimal(4,0)")


def log_position(text: Column) -> Column:
    """``HI/LO`` in hexadecimal -> one long."""
    parts = F.split(text, "/")
    high, low = (F.conv(parts[i], 16, 10).cast("long") for i in (0, 1))
    return high * F.lit(1 << 32) + low


def quantise(value: Column, digits: int, precision: int = 18) -> Column:
    """Half-up to 2, 4 or 6 places, through decimals."""
    return F.round(value.cast(f"decimal({precision},{digits + 4})"), digits).cast(f"decimal({precision},{digits})")


def canonical_json(json: Column) -> Column:
    """Compact JSON text with the keys of every object sorted and values as they are; null if it does not parse."""
    return F.to_json(F.try_parse_json(json))


def summary_value(summary: Column, key: str) -> Column:
    return F.try_element_at(summary, F.lit(key)).cast("long")


def calendar(day: Column) -> list[Column]:
    """The parts of a date that the date dimension holds."""
    return [
        F.year(day).alias("year_number"),
        F.quarter(day).alias("quarter_number"),
        F.month(day).alias("month_number"),
        F.day(day).alias("day_of_month"),
        F.date_format(day, "MMM").alias("month_name"),
        F.date_format(day, "E").alias("day_name"),
        (F.weekday(day) + 1).alias("iso_day_of_week"),
        F.weekofyear(day).alias("iso_week"),
        F.extract(F.lit("YEAROFWEEK"), day).alias("iso_year"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        F.trunc(day, "month").alias("month_start"),
        F.trunc(day, "quarter").alias("quarter_start"),
        F.trunc(day, "year").alias("year_start"),
        F.last_day(day).alias("month_end"),
    ]


def register(spark: SparkSession) -> None:
    """The same functions for SQL users."""
    for text in (
        "date_key(ts TIMESTAMP) RETURNS INT RETURN year(ts) * 10000 + month(ts) * 100 + day(ts)",
        "safe_divide(n DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN CASE WHEN d <> 0 THEN n / d END",
        f"surrogate_key(k STRING) RETURNS STRING RETURN md5(coalesce(k, '{NULL_PART}'))",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
