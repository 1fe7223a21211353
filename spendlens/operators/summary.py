"""Dashboard summaries over the customer profile: KPIs, the seven-segment
table, the largest segment and the digests handed to a report writer.

All of them reduce the profile to a handful of rows with partial+final
aggregation; the only fixed input is the seven-row segment label table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.functions import dbl, js_round, pct_tenths
from spendlens.functions import labels as L


def segment_labels(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, sid, name, desc) for i, (sid, name, desc) in enumerate(L.SEGMENTS)]
    return spark.createDataFrame(rows, "position int, id string, name string, description string")


def _kpi_aggs():
    return [
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("monetary").alias("revenue"),
        F.sum("frequency").alias("orders"),
        F.count_if(F.col("frequency") > 1).alias("repeat"),
        F.count_if(F.col("recency") > 90).alias("churned"),
    ]


def _kpi_cols() -> dict:
    churn = pct_tenths("churned", "total_customers")
    return {
        "total_customers": F.col("total_customers").cast("long"),
        "total_revenue": js_round("revenue", 2),
        "average_order_value": js_round(js_round("revenue", 2) / F.greatest(dbl("orders"), F.lit(1.0)), 2),
        "customer_retention_rate": js_round(F.lit(100.0) - churn, 1),
        "churn_rate": churn,
        "repeat_purchase_rate": pct_tenths("repeat", "total_customers"),
    }


def kpi_stats(profile: DataFrame) -> DataFrame:
    """One row: total customers, revenue, average order value, retention,
    churn (away > 90 days) and repeat-purchase (> 1 order) rates."""
    return profile.agg(*_kpi_aggs()).select(*[c.alias(n) for n, c in _kpi_cols().items()])


def segment_summary(profile: DataFrame) -> DataFrame:
    """Seven rows in fixed order, empty segments kept with zeros: size,
    percentage of all customers (1 dp), mean recency (0 dp), frequency (1 dp)
    and spend (2 dp), description."""
    spark = profile.sparkSession
    per = profile.groupBy(F.col("segment").alias("name")).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("recency").alias("sum_r"),
        F.sum("frequency").alias("sum_f"),
        F.sum("monetary").alias("sum_m"),
    )
    labels = F.broadcast(segment_labels(spark))  # seven rows
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    # every profiled customer falls in exactly one of the seven segments
    total = F.sum(size).over(Window.partitionBy())
    mean = lambda c: dbl(c) / F.nullif(dbl(size), F.lit(0.0))
    return (labels.join(per, "name", "left")
            .select(
                "position", "id", "name",
                size.alias("size"),
                pct_tenths(size, total).alias("percentage"),
                F.coalesce(js_round(mean("sum_r"), 0), F.lit(0.0)).alias("avg_recency"),
                F.coalesce(js_round(mean("sum_f"), 1), F.lit(0.0)).alias("avg_frequency"),
                F.coalesce(js_round(mean("sum_m"), 2), F.lit(0.0)).alias("avg_monetary"),
                "description")
            .orderBy("position"))


def largest_segment(summary: DataFrame) -> DataFrame:
    """The segment with the most members (ties: first in display order)."""
    return summary.orderBy(F.col("size").desc(), F.col("position").asc()).limit(1)


def segment_digest(summary: DataFrame) -> DataFrame:
    """One row: the seven segments as a JSON array of
    {name, size, percentage, avgRecency, avgSpend} in display order."""
    entry = F.struct("position", F.struct(
        F.col("name"), F.col("size"), F.col("percentage"),
        F.col("avg_recency").alias("avgRecency"), F.col("avg_monetary").alias("avgSpend")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["v"])
    return summary.agg(F.to_json(ordered).alias("segments_json"))


def executive_digest(profile: DataFrame) -> DataFrame:
    """One row of headline facts: revenue, AOV, churn and repeat rates,
    customers, and size and mean spend of the Champions segment (0 if
    empty) – all from a single aggregation over the profile."""
    champ = F.col("segment") == L.CHAMPIONS
    agg = profile.agg(*_kpi_aggs(), F.count_if(champ).alias("champ_n"),
                      F.sum(F.when(champ, F.col("monetary"))).alias("champ_m"))
    kpis = _kpi_cols()
    return agg.select(
        *[kpis[k].alias(k) for k in ("total_revenue", "average_order_value", "churn_rate",
                                     "repeat_purchase_rate", "total_customers")],
        F.col("champ_n").cast("long").alias("champions_size"),
        F.coalesce(js_round(dbl("champ_m") / F.nullif(dbl("champ_n"), F.lit(0.0)), 2), F.lit(0.0))
         .alias("champions_avg_monetary"))


def average_order_value(orders: DataFrame, statuses=("completed",)) -> DataFrame:
    """One row: revenue over the number of completed orders (2 dp), straight
    from the orders."""
    o = orders.filter(F.col("customer_id").isNotNull() & F.col("status").isin(list(statuses)))
    return o.agg(F.sum("total_amount").alias("m"), F.count("id").alias("n")).select(
        js_round(F.coalesce(js_round("m", 2), F.lit(0.0)) / F.greatest(dbl("n"), F.lit(1.0)), 2).alias("average_order_value"))
