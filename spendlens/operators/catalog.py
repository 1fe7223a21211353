"""Product and category performance from order lines.

Lines are aggregated per product first (partial aggregation on the map side
collapses hot products), then meet the product table one row per product,
and categories are a second, tiny aggregation over that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.functions import dbl, js_round, pct_tenths, safe_ratio


def _line_amount(items: DataFrame):
    if "line_amount" in items.columns:
        return F.coalesce(F.col("line_amount"),
                          (F.col("quantity") * F.col("unit_price")).cast("decimal(15,2)"))
    return (F.col("quantity") * F.col("unit_price")).cast("decimal(15,2)")


def product_line_totals(items: DataFrame, orders: DataFrame | None = None, statuses=None) -> DataFrame:
    """product_id -> lines, revenue (exact decimal), returned lines.

    ``statuses`` keeps only lines of orders in those states (semi join)."""
    if statuses is not None:
        keep = orders.filter(F.col("status").isin(list(statuses))).select(F.col("id").alias("order_id"))
        items = items.join(keep, "order_id", "left_semi")
    returned = (F.coalesce(F.col("is_returned"), F.lit(False)) if "is_returned" in items.columns
                else F.lit(False))
    return (items.groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("lines"),
                 F.sum(_line_amount(items)).alias("revenue"),
                 F.count_if(returned).alias("returned")))


def product_metrics(items: DataFrame, products: DataFrame, orders: DataFrame | None = None,
                    statuses=None) -> DataFrame:
    """Per product (all products, unsold ones with zeros): orders_count (the
    number of order lines), revenue (2 dp), rating and refund_rate (share of
    lines returned, 3 dp)."""
    totals = product_line_totals(items, orders, statuses)
    p = products.select(F.col("id").alias("product_id"), "name", "category", "price", "rating")
    lines = F.coalesce(F.col("lines"), F.lit(0)).cast("long")
    return (p.join(totals, "product_id", "left")
            .select(F.col("product_id").alias("id"), "name", "category",
                    dbl("price").alias("price"),
                    lines.alias("orders_count"),
                    F.coalesce(js_round("revenue", 2), F.lit(0.0)).alias("revenue"),
                    dbl("rating").alias("rating"),
                    F.when(lines > 0, js_round(dbl("returned") / dbl(lines), 3))
                     .otherwise(F.lit(0.0)).alias("refund_rate")))


def top_products(metrics: DataFrame, n: int = 50) -> DataFrame:
    """Products by revenue, highest first (ties by id), first ``n``."""
    return metrics.orderBy(F.col("revenue").desc(), F.col("id").asc()).limit(n)


def distinct_categories(products: DataFrame) -> DataFrame:
    return products.select("category").distinct()


def category_metrics(items: DataFrame, products: DataFrame, orders: DataFrame | None = None,
                     statuses=None) -> DataFrame:
    """Per category of the product table: revenue (2 dp), orders_count (lines),
    avg_order_value (revenue per line, 2 dp) and market_share (% of all line
    revenue, 1 dp); highest revenue first."""
    totals = product_line_totals(items, orders, statuses)
    p = products.select(F.col("id").alias("product_id"), "category")
    per = (p.join(totals, "product_id", "left")
           .groupBy("category")
           .agg(F.coalesce(F.sum("revenue"), F.lit(0).cast("decimal(25,2)")).alias("revenue"),
                F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("orders_count")))
    # grand total over the per-category rows (one row per category)
    grand = F.sum("revenue").over(Window.partitionBy())
    return (per.select(F.col("category").alias("name"),
                       js_round("revenue", 2).alias("revenue"),
                       "orders_count",
                       js_round(safe_ratio("revenue", "orders_count"), 2).alias("avg_order_value"),
                       pct_tenths("revenue", grand).alias("market_share"))
            .orderBy(F.col("revenue").desc(), F.col("name").asc()))
