"""Monthly revenue with a fitted linear trend and a short forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.functions import as_date, dbl, js_round, month_diff, month_start
from spendlens.operators.rfm import COMPLETED, completed_orders


def monthly_revenue(orders: DataFrame, snapshot, months: int = 12, statuses=COMPLETED) -> DataFrame:
    """The last ``months`` calendar months up to the snapshot month, empty
    months included: month ('yyyy-MM'), month_index (0 = oldest),
    actual_revenue (2 dp), orders_count and trend_revenue (the least-squares
    line over the months, rounded to a whole number)."""
    snap_month = month_start(as_date(snapshot))
    first = F.add_months(snap_month, -(months - 1))
    nxt = F.add_months(snap_month, 1)
    per = (completed_orders(orders, statuses)
           .filter((F.col("order_date") >= first) & (F.col("order_date") < nxt))
           .groupBy(month_start("order_date").alias("month_start"))
           .agg(F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders_count")))
    spine = (orders.sparkSession.range(1)
             .select(F.explode(F.sequence(first, snap_month, F.expr("INTERVAL 1 MONTH"))).alias("month_start")))
    hist = (spine.join(F.broadcast(per), "month_start", "left")  # at most `months` rows each side
            .select("month_start",
                    month_diff("month_start", first).alias("month_index"),
                    F.coalesce(js_round("revenue", 2), F.lit(0.0)).alias("actual_revenue"),
                    F.coalesce(F.col("orders_count"), F.lit(0)).cast("long").alias("orders_count")))
    # the fit runs over the `months` rows of the series itself
    series = Window.partitionBy()
    x = dbl("month_index")
    return (hist.select(F.date_format("month_start", "yyyy-MM").alias("month"), "month_index",
                        "actual_revenue", "orders_count",
                        js_round(F.regr_slope("actual_revenue", x).over(series) * x
                                 + F.regr_intercept("actual_revenue", x).over(series), 0).alias("trend_revenue"))
            .orderBy("month_index"))


def revenue_forecast(monthly: DataFrame, average_order_value, horizon: int = 3) -> DataFrame:
    """History plus ``horizon`` forecast months: forecast = trend of the same
    least-squares line (whole number), actual 0, orders = forecast / AOV
    rounded.  History rows carry a null forecast.  Fewer than two months:
    no forecast rows."""
    series = Window.partitionBy()
    x = dbl("month_index")
    fitted = monthly.select(
        "*",
        F.count(F.lit(1)).over(series).alias("__n"),
        F.regr_slope("actual_revenue", x).over(series).alias("__m"),
        F.regr_intercept("actual_revenue", x).over(series).alias("__b"))
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("__step")
    last = (fitted.filter((F.col("month_index") == F.col("__n") - 1) & (F.col("__n") >= 2))
            .select(F.to_date(F.concat(F.col("month"), F.lit("-01"))).alias("__last"), "__n", "__m", "__b", step))
    value = js_round(F.col("__m") * (dbl("__n") - F.lit(1.0) + dbl("__step")) + F.col("__b"), 0)
    aov = dbl(average_order_value)
    future = last.select(
        F.date_format(F.add_months("__last", F.col("__step")), "yyyy-MM").alias("month"),
        (F.col("__n") - F.lit(1) + F.col("__step")).cast("int").alias("month_index"),
        F.lit(0.0).alias("actual_revenue"),
        F.coalesce(js_round(value / F.nullif(aov, F.lit(0.0)), 0), F.lit(0.0)).cast("long").alias("orders_count"),
        value.alias("trend_revenue"),
        value.alias("forecast_revenue"))
    return monthly.unionByName(future, allowMissingColumns=True)
