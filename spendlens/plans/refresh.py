"""Batch refresh: build the per-customer tables once, then serve every report
from them.

At scale the customer profile is the expensive part of nearly every report
(orders, lines and events aggregated per customer).  ``refresh_tables``
computes it once, writes it and the ``customer_segments`` result table as
Parquet, and ``reports`` reads those files back (a lineage cut: a lost
executor re-reads Parquet instead of re-aggregating orders).  Tables go to a
folder under the cluster's shared ``spark.checkpoint.dir`` unless a path is
given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import as_date
from spendlens.operators import catalog, cohort, export, profile, revenue, search, summary
from spendlens.session import ensure_checkpoint_dir
from spendlens.sources.readers import write_table
from spendlens.sources.testdata import Tables


def default_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/spendlens-tables/{uuid.uuid4().hex}"


def write_orders_by_month(orders: DataFrame, path: str) -> None:
    """Orders laid out by calendar month (``order_month`` = first day of the
    month): a date-window report then reads only the months it needs
    (partition pruning at the file listing, before any Parquet footer).

    Rows are rebalanced by month: AQE gathers small months into one writer and
    splits a month that holds more than the advisory partition size."""
    (orders.withColumn("order_month", F.trunc("order_date", "month"))
     .hint("rebalance", "order_month")
     .write.mode("overwrite").partitionBy("order_month").parquet(path))


def read_orders_by_month(spark: SparkSession, path: str) -> DataFrame:
    """The laid-out orders; a filter on order_date also prunes months."""
    return spark.read.parquet(path)


def month_pruned(orders: DataFrame, snapshot, months: int) -> DataFrame:
    """Restrict laid-out orders to the partitions of the last ``months``
    months (a literal partition filter), leaving row filters to the operator."""
    snap_month = F.trunc(as_date(snapshot), "month")
    return orders.filter(F.col("order_month") >= F.add_months(snap_month, -(months - 1)))


def refresh_tables(t: Tables, folder: str | None = None) -> str:
    """Write customer_profile (in key order, with its page index), customer_segments, product_metrics and the
    month-partitioned orders under ``folder``; returns the folder."""
    folder = folder or default_folder(t.spark)
    write_orders_by_month(t.orders, f"{folder}/orders_by_month")
    prof = profile.customer_profile(t.customer_base, None, t.ticket_features, t.snapshot, facts=t.customer_facts)
    write_table(search.paged_profile(prof), f"{folder}/customer_profile")
    stored = t.spark.read.parquet(f"{folder}/customer_profile")
    write_table(search.page_index(stored), f"{folder}/customer_page_index")
    write_table(profile.build_customer_segments(stored), f"{folder}/customer_segments")
    write_table(catalog.product_metrics(t.order_items, t.products), f"{folder}/product_metrics")
    return folder


def customer_page(t: Tables, folder: str, segment: str = search.ALL, country: str = search.ALL, page=1, limit=10) -> DataFrame:
    """A page of the stored profile through its page index."""
    return search.customer_page_indexed(t.spark.read.parquet(f"{folder}/customer_profile"),
                                        t.spark.read.parquet(f"{folder}/customer_page_index"), segment, country, page, limit)


def reports(t: Tables, folder: str) -> dict[str, DataFrame]:
    """The dashboard reports over the stored tables (lazy frames)."""
    spark = t.spark
    prof = spark.read.parquet(f"{folder}/customer_profile").drop("page_block")
    segs = spark.read.parquet(f"{folder}/customer_segments")
    products = spark.read.parquet(f"{folder}/product_metrics")
    seg_summary = summary.segment_summary(prof)
    kpis = summary.kpi_stats(prof)
    by_month = read_orders_by_month(spark, f"{folder}/orders_by_month")
    monthly = revenue.monthly_revenue(month_pruned(by_month, t.snapshot, 12), t.snapshot)
    return {
        "kpi_stats": kpis,
        "segment_summary": seg_summary,
        "largest_segment": summary.largest_segment(seg_summary),
        "executive_digest": summary.executive_digest(prof),
        "churn_watchlist": profile.churn_watchlist(t.customers, segs),
        "top_products": catalog.top_products(products),
        "cohort_matrix": cohort.cohort_matrix(t.customers, month_pruned(by_month, t.snapshot, 12), t.snapshot),
        "revenue_forecast": revenue.revenue_forecast(monthly, kpis.select("average_order_value").scalar()),
        "export_segments": export.export_segments(seg_summary),
        "export_products": export.export_products(products),
        "export_customers": export.export_customers(prof),
    }
