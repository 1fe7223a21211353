import datetime as dt

from pyspark.sql import functions as F

from spendlens.functions import half_even, js_number_text, js_round, month_diff, pct_tenths


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_js_round_half_up_toward_positive(spark):
    r = one(spark, js_round(F.lit(2.5), 0), js_round(F.lit(-2.5), 0), js_round(F.lit(1.005 * 1000), 0),
            js_round(F.lit(0.125), 2))
    assert r[0] == 3.0 and r[1] == -2.0 and r[3] == 0.13


def test_half_even(spark):
    r = one(spark, half_even(F.lit(2.5), 0), half_even(F.lit(3.5), 0), half_even(F.lit(0.125), 2))
    assert (r[0], r[1], r[2]) == (2.0, 4.0, 0.12)


def test_month_diff_ignores_day(spark):
    r = one(spark, month_diff(F.lit(dt.date(2026, 2, 1)), F.lit(dt.date(2025, 11, 30))))
    assert r[0] == 3


def test_pct_tenths_zero_safe(spark):
    r = one(spark, pct_tenths(F.lit(1), F.lit(3)), pct_tenths(F.lit(1), F.lit(0)))
    assert r[0] == 33.3 and r[1] == 0.0


def test_js_number_text(spark):
    r = one(spark, js_number_text(F.lit(12.0)), js_number_text(F.lit(0.5)), js_number_text(F.lit(1234567.25)),
            js_number_text(F.lit(100.0)))
    assert tuple(r) == ("12", "0.5", "1234567.25", "100")
