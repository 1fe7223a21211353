"""Pareto concentration of spend: which share of revenue the top accounts bring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.functions import dbl, js_round
from spendlens.functions import labels as L
from spendlens.operators.ranking import with_global_row_number, with_tied_running_sum
from spendlens.operators.rfm import COMPLETED, completed_orders


def customer_spend(orders: DataFrame, statuses=COMPLETED) -> DataFrame:
    return (completed_orders(orders, statuses).groupBy("customer_id")
            .agg(F.sum("total_amount").alias("total_spend")))


def _bracket(rank_col: str, total_col: str, top_pct: int):
    # rank / n * 100 <= top_pct, tested on integers (no rounding at the edge)
    return F.when(F.col(rank_col) * 100 <= F.col(total_col) * F.lit(top_pct), L.CORE_BRACKET) \
            .otherwise(L.REST_BRACKET)


def pareto_customers(orders: DataFrame, top_pct: int = 25, statuses=COMPLETED,
                     num_partitions: int | None = None) -> DataFrame:
    """Per customer: total_spend, customer_rank (spend descending, ties by
    customer id), percentile (rank / n * 100), running_spend (sum of all
    spends >= this one: tied spends share a value), cumulative_revenue and
    the bracket label.  All come from one distributed order, without a join
    on the spend (``with_tied_running_sum``)."""
    ranked = with_tied_running_sum(customer_spend(orders, statuses), "total_spend", "customer_id", "running_spend",
                                   "customer_rank", "total_customer_count", "all_spend", num_partitions)
    return (ranked
            .select("customer_id",
                    dbl("total_spend").alias("total_spend"),
                    "customer_rank",
                    (dbl("customer_rank") / dbl("total_customer_count") * F.lit(100.0)).alias("percentile"),
                    dbl("running_spend").alias("running_spend"),
                    dbl("all_spend").alias("cumulative_revenue"),
                    _bracket("customer_rank", "total_customer_count", top_pct).alias("customer_cohort")))


def pareto_summary(orders: DataFrame, top_pct: int = 25, statuses=COMPLETED,
                   num_partitions: int | None = None) -> DataFrame:
    """Two rows (core / remaining): distinct_accounts, bracket_revenue and
    contribution_percentage of all revenue (4 dp)."""
    spend = customer_spend(orders, statuses)
    ranked = with_global_row_number(
        spend, [F.col("total_spend").desc(), F.col("customer_id").asc()], "rank", "n", num_partitions)
    # the two bracket rows add up to the grand total
    total = F.sum("bracket_revenue").over(Window.partitionBy())
    return (ranked.groupBy(_bracket("rank", "n", top_pct).alias("customer_cohort"))
            .agg(F.count(F.lit(1)).alias("distinct_accounts"),  # one row per customer
                 F.sum("total_spend").alias("bracket_revenue"))
            .select("customer_cohort",
                    F.col("distinct_accounts").cast("long").alias("distinct_accounts"),
                    dbl("bracket_revenue").alias("bracket_revenue"),
                    js_round(dbl("bracket_revenue") / dbl(total) * F.lit(100.0), 4)
                    .alias("contribution_percentage")))
