import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemill.functions import scalars as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_date_keys(spark):
    ts = F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
    assert one(spark, S.date_key(ts), S.date_key_lookback(S.date_key(ts), 1), S.date_key_lookback(F.lit(None).cast("int"), 3))[:] == (20240301, 20240229, 0)


def test_safe_divide_never_zero_by_zero(spark):
    assert one(spark, S.safe_divide(F.lit(1), F.lit(0)), S.safe_divide(F.lit(1), F.lit(4)), S.safe_divide(F.lit(None).cast("int"), F.lit(4)))[:] == (None, 0.25, None)


def test_surrogate_keys(spark):
    import hashlib

    row = one(spark, S.surrogate_key(F.lit(7), F.lit("x")), S.surrogate_key(F.lit(None).cast("string")), S.or_unknown(F.lit(None).cast("string")))
    assert row[0] == hashlib.md5(b"7-x").hexdigest()
    assert row[1] == hashlib.md5(S.NULL_PART.encode()).hexdigest() and row[2] == "UNKNOWN"


def test_strict_extremes(spark):
    null = F.lit(None).cast("int")
    assert one(spark, S.strict_greatest(F.lit(1), null), S.strict_least(F.lit(3), F.lit(2)))[:] == (None, 2)


def test_elapsed_and_boundaries_differ(spark):
    a, b = (F.lit(f"2024-01-01 {x}").cast("timestamp_ntz") for x in ("00:59:00", "01:01:00"))
    assert one(spark, S.elapsed("HOUR", a, b), S.boundaries("HOUR", a, b))[:] == (0, 1)


def test_positions_money_and_json(spark):
    row = one(
        spark, S.log_position(F.lit("16/B374D848")), S.quantise(F.lit("2.345"), 2), S.impression_cost(F.lit("12.345678").cast("decimal(12,6)")),
        S.canonical_json(F.lit('{"b": 1, "a": "x"}')), S.summary_value(F.from_json(F.lit('{"rows": "12"}'), "map<string,string>"), "rows"),
    )
    assert row[0] == 0x16 * 2**32 + 0xB374D848 and row[1] == Decimal("2.35")
    assert abs(float(row[2]) - 0.012345678) < 1e-12 and row[3] == '{"a":"x","b":1}' and row[4] == 12


def test_calendar(spark):
    day = F.lit("2021-01-03").cast("date")
    row = one(spark, *S.calendar(day)).asDict()
    assert (row["iso_year"], row["iso_week"], row["iso_day_of_week"], row["is_weekend"]) == (2020, 53, 7, True)
    assert row["month_end"] == dt.date(2021, 1, 31) and row["quarter_start"] == dt.date(2021, 1, 1)


def test_sql_functions(spark):
    S.register(spark)
    assert spark.sql("SELECT safe_divide(1, 0), date_key(TIMESTAMP '2024-05-06 00:00:00')").first()[:] == (None, 20240506)
