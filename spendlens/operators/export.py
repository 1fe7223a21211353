"""Report exports: the segment, product and customer tables with their
download headers, written as CSV (with header) or JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import js_number_text

# FIXED VALUES – the export headers.
SEGMENT_HEADERS = ["Segment ID", "Segment Name", "Customer Count", "Percentage",
                   "Avg Recency (Days)", "Avg Frequency", "Avg Spend ($)"]
PRODUCT_HEADERS = ["Product ID", "Product Name", "Category", "Price", "Orders Count",
                   "Revenue Generated", "Rating"]
CUSTOMER_HEADERS = ["Customer ID", "Customer Name", "Email", "Country", "Signup Date", "RFM Segment",
                    "Recency (Days)", "Purchase Frequency", "Total spend ($)", "CLV ($)", "Churn Risk (%)"]

CSV_CUSTOMER_ROWS = 150
JSON_CUSTOMER_ROWS = 100


# CSV cells hold numbers as text printed the way the dashboard prints them
# ("12", "0.5", "1234.5"): no trailing zeros, no exponent.
def export_segments(summary: DataFrame) -> DataFrame:
    """Segment table as exported: percentage printed with a '%' suffix."""
    cols = [F.col("id"), F.col("name"), js_number_text("size"),
            F.concat(js_number_text("percentage"), F.lit("%")),
            js_number_text("avg_recency"), js_number_text("avg_frequency"), js_number_text("avg_monetary")]
    return summary.select(*[c.alias(h) for c, h in zip(cols, SEGMENT_HEADERS)])


def export_products(metrics: DataFrame) -> DataFrame:
    """All products, highest revenue first (ties by id)."""
    cols = [F.col("id"), F.col("name"), F.col("category"), js_number_text("price"),
            js_number_text("orders_count"), js_number_text("revenue"), js_number_text("rating")]
    return (metrics.orderBy(F.col("revenue").desc(), F.col("id").asc())
            .select(*[c.alias(h) for c, h in zip(cols, PRODUCT_HEADERS)]))


def export_customers(profile: DataFrame, n: int = CSV_CUSTOMER_ROWS) -> DataFrame:
    """The first ``n`` customers in id order; churn risk printed with '%'."""
    cols = [F.col("customer_id"), F.col("name"), F.col("email"), F.col("country"),
            F.date_format("signup_date", "yyyy-MM-dd"), F.col("segment"), js_number_text("recency"),
            js_number_text("frequency"), js_number_text("monetary"), js_number_text("clv"),
            F.concat(js_number_text("churn_risk"), F.lit("%"))]
    return (profile.orderBy("customer_id").limit(n)
            .select(*[c.alias(h) for c, h in zip(cols, CUSTOMER_HEADERS)]))


ORDER_LIST = "array<struct<date:date,id:string,amount:double,itemsCount:int>>"


def camel_case(df: DataFrame) -> DataFrame:
    """Columns renamed from snake_case to camelCase, the keys of the JSON exports."""
    def name(c):
        first, *rest = c.split("_")
        return first + "".join(w.capitalize() for w in rest)
    return df.withColumnsRenamed({c: name(c) for c in df.columns})


def export_customer_records(profile: DataFrame, order_lists_df: DataFrame | None = None,
                            n: int = JSON_CUSTOMER_ROWS) -> DataFrame:
    """The JSON customer export: the first ``n`` customer records in id order
    with camel-case keys, each with its nested order list (``order_lists_df``
    from ``profile.order_lists`` for these customers; empty where there is none)."""
    first = profile.orderBy("customer_id").limit(n)
    if order_lists_df is not None:
        first = first.join(order_lists_df, "customer_id", "left")
    else:
        first = first.withColumn("orders", F.lit(None).cast(ORDER_LIST))
    return camel_case(first.select(
        F.col("customer_id").alias("id"), "name", "email", "country", "signup_date", "segment", "recency", "frequency",
        F.col("monetary").cast("double").alias("monetary"), "clv", "churn_risk", "active_status", "discount_usage",
        "support_tickets", "satisfaction_rating", "last_purchase_date",
        F.coalesce(F.col("orders"), F.array().cast(ORDER_LIST)).alias("orders")))


def export_frame(target: str | None, fmt: str = "csv", summary: DataFrame | None = None,
                 metrics: DataFrame | None = None, profile: DataFrame | None = None,
                 order_lists_df: DataFrame | None = None) -> DataFrame:
    """The export chosen by ``target`` ('segments', 'products', anything else
    = customers) and format: CSV frames with their headers, or for JSON the
    segment rows, all product rows, or the first 100 customer records, with
    camel-case keys."""
    if fmt == "csv":
        if target == "segments":
            return export_segments(summary)
        if target == "products":
            return export_products(metrics)
        return export_customers(profile)
    if target == "segments":
        return camel_case(summary.drop("position"))
    if target == "products":
        return camel_case(metrics)
    return export_customer_records(profile, order_lists_df)


def write_export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                 single_file: bool = False) -> None:
    """Write an export frame: ``csv`` with a header line, or ``json`` lines.

    ``single_file`` is for the bounded exports (segments, capped customer
    lists); the product export grows with the catalogue and keeps its
    partitions (one part file each)."""
    w = (df.coalesce(1) if single_file else df).write.mode(mode)
    if fmt == "csv":
        # quotes inside a field are doubled (RFC 4180), not backslash-escaped
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
