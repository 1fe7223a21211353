"""Signup cohorts: retention in long form and as a 12-month matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.functions import as_date, dbl, js_round, month_diff, month_start
from spendlens.operators.rfm import COMPLETED, completed_orders


def _cohorts(customers: DataFrame) -> DataFrame:
    return customers.select(F.col("id").alias("customer_id"),
                            month_start("signup_date").alias("cohort_start"))


def cohort_sizes(customers: DataFrame) -> DataFrame:
    """Customers (one row each) per signup month."""
    return _cohorts(customers).groupBy("cohort_start").agg(F.count(F.lit(1)).alias("cohort_size"))


def cohort_retention(customers: DataFrame, orders: DataFrame, max_index: int = 12,
                     statuses=COMPLETED) -> DataFrame:
    """Long form: cohort_month ('yyyy-MM'), cohort_size, month_index (months
    since the signup month, 0..max_index), retained_customers (distinct
    customers with an order that month) and retention_rate (% of the cohort,
    4 dp).  Sorted by cohort and index.

    Orders are reduced to each customer's set of order months before they meet
    the customers; every customer then counts once for the cohort (a row
    without an index) and once for each of its months, so sizes and retained
    customers come from the same aggregate.
    """
    months = (completed_orders(orders, statuses)
              .groupBy("customer_id").agg(F.collect_set(month_start("order_date")).alias("months")))
    own = F.coalesce(F.transform("months", lambda m: month_diff(m, F.col("cohort_start"))), F.array().cast("array<int>"))
    counts = (_cohorts(customers).filter(F.col("cohort_start").isNotNull()).join(months, "customer_id", "left")
              .select("cohort_start", F.explode(F.concat(F.array(F.lit(None).cast("int")), own)).alias("month_index"))
              .filter(F.col("month_index").isNull() | F.col("month_index").between(0, max_index))
              .groupBy("cohort_start", "month_index").agg(F.count(F.lit(1)).alias("n")))
    # max_index + 2 rows for each cohort
    size = F.max(F.when(F.col("month_index").isNull(), F.col("n"))).over(Window.partitionBy("cohort_start"))
    return (counts.withColumn("cohort_size", size).filter(F.col("month_index").isNotNull())
            .select(F.date_format("cohort_start", "yyyy-MM").alias("cohort_month"),
                    F.col("cohort_size").cast("long").alias("cohort_size"),
                    "month_index",
                    F.col("n").cast("long").alias("retained_customers"),
                    js_round(dbl("n") * F.lit(100.0) / dbl("cohort_size"), 4)
                    .alias("retention_rate"))
            .orderBy("cohort_month", "month_index"))


def cohort_matrix(customers: DataFrame, orders: DataFrame, snapshot, months: int = 12,
                  statuses=None) -> DataFrame:
    """The retention grid of the last ``months`` signup months up to the
    snapshot month (one row each, empty cohorts with zeros): initial_count
    and two arrays of ``months`` values –
    retention[k] (% of the cohort with an order in month k) and
    revenue_retention[k] (month-k revenue as % of month-0 revenue, 0 when
    month 0 had none), 1 dp.  Months without data (including those after
    the snapshot) are 0.  By default every order counts as activity.
    """
    snap_month = month_start(as_date(snapshot))
    first = F.add_months(snap_month, -(months - 1))
    cohorts = _cohorts(customers).filter(F.col("cohort_start").between(first, snap_month))
    o = completed_orders(orders, statuses).filter(F.col("order_date") >= first)
    # per customer and month first (pre-aggregates heavy buyers), then per cell
    per_customer = (o.groupBy("customer_id", month_start("order_date").alias("order_month"))
                    .agg(F.sum("total_amount").alias("amount")))
    cells = (per_customer.join(cohorts, "customer_id")
             .withColumn("k", month_diff("order_month", "cohort_start"))
             .filter(F.col("k").between(0, months - 1))
             .groupBy("cohort_start", "k")
             .agg(F.count(F.lit(1)).alias("active"), F.sum("amount").alias("revenue")))
    counted = cohorts.groupBy("cohort_start").agg(F.count(F.lit(1)).alias("initial_count"))
    # every cohort month of the window is a row, signups or not (`months` rows: a bounded broadcast)
    spine = (customers.sparkSession.range(1)
             .select(F.explode(F.sequence(first, snap_month, F.expr("INTERVAL 1 MONTH"))).alias("cohort_start")))
    sizes = (spine.join(F.broadcast(counted), "cohort_start", "left")
             .select("cohort_start", F.coalesce(F.col("initial_count"), F.lit(0)).alias("initial_count")))
    grid = sizes.select("cohort_start", "initial_count",
                        F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("k"))
    full = (grid.join(cells, ["cohort_start", "k"], "left")
            .select("cohort_start", "initial_count", "k",
                    F.coalesce(F.col("active"), F.lit(0)).alias("active"),
                    F.coalesce(dbl("revenue"), F.lit(0.0)).alias("revenue")))
    # one row per cohort: its `months` cells and its month-0 revenue
    rows = (full.groupBy("cohort_start", "initial_count")
            .agg(F.array_sort(F.collect_list(F.struct("k", "active", "revenue"))).alias("cells"),
                 F.max(F.when(F.col("k") == 0, F.col("revenue"))).alias("revenue0")))
    size = F.nullif(dbl("initial_count"), F.lit(0.0))
    ret = lambda c: F.coalesce(js_round(dbl(c["active"]) * F.lit(100.0) / size, 1), F.lit(0.0))
    rev = lambda c: F.when(F.col("revenue0") > 0,
                           js_round(c["revenue"] * F.lit(100.0) / F.col("revenue0"), 1)).otherwise(F.lit(0.0))
    return (rows.select(F.date_format("cohort_start", "yyyy-MM").alias("cohort_month"),
                        F.col("initial_count").cast("long").alias("initial_count"),
                        F.transform("cells", ret).alias("retention"),
                        F.transform("cells", rev).alias("revenue_retention"))
            .orderBy("cohort_month"))
