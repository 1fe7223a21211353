"""Customer profile, the ``customer_segments`` result table and the churn
watch-list.

The profile is the per-customer record of the dashboard: R/F/M (with the
signup date standing in for the last purchase of customers without a
completed order), segment, CLV, heuristic churn risk, active flag, the
behavioural inputs (tickets, discount usage, satisfaction); the order lists
are frames of their own.  At scale it is built once and written
(``plans.refresh.refresh_tables``), then read by every report instead of
being recomputed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import as_date, dbl, safe_ratio
from spendlens.operators.ranking import with_group_position
from spendlens.operators.rfm import COMPLETED, completed_orders, rfm_scores
from spendlens.session import ensure_checkpoint_dir
from spendlens.operators.scoring import (
    churn_heuristic_expr, clv_multiplier_expr, retention_action_expr, segment_expr,
)


def order_activity(orders: DataFrame, items: DataFrame, statuses=COMPLETED) -> DataFrame:
    """customer_id -> orders_listed, items_listed: the size of each customer's
    order list and the lines in it, as plain aggregates (no arrays)."""
    per_order = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"))
    o = completed_orders(orders, statuses).select(F.col("id").alias("order_id"), "customer_id")
    return (o.join(per_order, "order_id", "left")
            .groupBy("customer_id")
            .agg(F.count(F.lit(1)).cast("int").alias("orders_listed"),
                 F.coalesce(F.sum("n_items"), F.lit(0)).cast("int").alias("items_listed")))


def order_rows(orders: DataFrame, items: DataFrame | None = None, statuses=COMPLETED,
               num_partitions: int | None = None) -> DataFrame:
    """One row for each order of each customer: customer_id, position (from 0,
    by date and id), date, id, amount, items_count.

    The shape is the same for every history; a customer with a huge history is
    spread over many tasks, and no join meets its key (``with_group_position``)."""
    placed = with_group_position(_listed(orders, items, statuses), "customer_id", ["date", "id"], "position", num_partitions)
    return placed.select("customer_id", "position", "date", "id", "amount", "items_count")


def _listed(orders: DataFrame, items: DataFrame | None, statuses) -> DataFrame:
    o = completed_orders(orders, statuses)
    n_items = F.lit(None).cast("int")
    if items is not None:
        counts = items.groupBy("order_id").agg(F.count(F.lit(1)).cast("int").alias("items_count"))
        o = o.join(counts, o.id == counts.order_id, "left")
        n_items = F.coalesce(F.col("items_count"), F.lit(0))
    return o.select("customer_id", F.col("order_date").alias("date"), "id", dbl("total_amount").alias("amount"),
                    n_items.alias("items_count"))


def order_lists(orders: DataFrame, items: DataFrame | None, customers: DataFrame, statuses=COMPLETED) -> DataFrame:
    """customer_id -> orders: array<struct<date, id, amount, itemsCount>> in
    date order, one row for each customer of the page ``customers`` that has
    orders.  Nesting is for a page of records; ``order_rows`` is for all."""
    o = completed_orders(orders, statuses).join(customers.select("customer_id").distinct(), "customer_id", "left_semi")
    entry = F.struct("date", "id", "amount", F.col("items_count").alias("itemsCount"))
    return (_listed(o, items, None).groupBy("customer_id")
            .agg(F.array_sort(F.collect_list(entry)).alias("orders")))


def customer_facts(orders: DataFrame, lines: DataFrame | None = None, statuses=COMPLETED) -> DataFrame:
    """Everything the profile takes from orders and their lines, one row per customer, in one aggregate.

    ``orders`` is scanned once: each order is told apart by status inside the
    aggregate instead of filtered before it.  ``lines`` (order_id,
    discount_rate) are folded per order first, so each order meets one row.
    A query that reads no line column drops the lines from its plan.

    frequency, monetary, last_order_date, items_listed: orders of ``statuses``;
    first_date, last_date, discount_sum, n_lines: orders of any status."""
    done = F.lit(True) if statuses is None else F.col("status").isin(list(statuses))
    o = orders.filter(F.col("customer_id").isNotNull())
    if lines is None:
        o = o.withColumns({"n_items": F.lit(0).cast("long"), "discount": F.lit(None).cast("decimal(16,4)")})
    else:
        per_order = lines.groupBy(F.col("order_id").alias("__order")).agg(
            F.count(F.lit(1)).alias("n_items"), F.sum("discount_rate").alias("discount"))
        o = o.join(per_order, F.col("id") == F.col("__order"), "left")
    mine = lambda c: F.when(done, F.col(c))
    return o.groupBy("customer_id").agg(
        F.count(mine("id")).alias("frequency"), F.sum(mine("total_amount")).alias("monetary"),
        F.max(mine("order_date")).alias("last_order_date"), F.coalesce(F.sum(mine("n_items")), F.lit(0)).cast("int").alias("items_listed"),
        F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"),
        F.sum("discount").alias("discount_sum"), F.sum("n_items").alias("n_lines"))


def customer_profile(customers: DataFrame, orders: DataFrame | None, features, snapshot,
                     statuses=COMPLETED, facts: DataFrame | None = None) -> DataFrame:
    """``features``: one frame or a list of frames keyed by customer_id that
    carry support_tickets, discount_usage and satisfaction_rating (missing
    values: 0 tickets, 0 % discount, rating 5).

    With ``facts`` (``customer_facts``, perhaps with more columns) ``orders``
    isn't read again, and the profile also holds orders_listed and items_listed.
    A customer without a known status is inactive."""
    snap = as_date(snapshot)
    per_customer = facts
    if facts is None:
        per_customer = (completed_orders(orders, statuses)
                        .groupBy("customer_id")
                        .agg(F.count("id").alias("frequency"),
                             F.sum("total_amount").alias("monetary"),
                             F.max("order_date").alias("last_order_date")))
    c = customers.select(F.col("id").alias("customer_id"), *(x for x in customers.columns if x in (
        "first_name", "last_name", "email", "country", "signup_date", "status"))).withColumnRenamed("status", "customer_status")
    p = c.join(per_customer, "customer_id", "left")
    frames = features if isinstance(features, (list, tuple)) else ([features] if features is not None else [])
    for f in frames:
        p = p.join(f, "customer_id", "left")
    for name, default in (("support_tickets", F.lit(0)), ("discount_usage", F.lit(0.0)),
                          ("satisfaction_rating", F.lit(5))):
        if name not in p.columns:
            p = p.withColumn(name, default)
    last = F.coalesce(F.col("last_order_date"), F.col("signup_date"))
    p = p.select(
        "customer_id",
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("name"),
        "email", "country", "signup_date",
        F.coalesce("customer_status", F.lit("inactive")).alias("customer_status"),
        F.coalesce(F.col("frequency"), F.lit(0)).alias("frequency"),
        F.coalesce(F.col("monetary"), F.lit(0).cast("decimal(25,2)")).alias("monetary"),
        last.alias("last_purchase_date"),
        F.datediff(snap, last).cast("int").alias("recency"),
        F.coalesce(F.col("support_tickets"), F.lit(0)).cast("int").alias("support_tickets"),
        F.coalesce(F.col("discount_usage"), F.lit(0.0)).alias("discount_usage"),
        F.coalesce(F.col("satisfaction_rating"), F.lit(5)).cast("int").alias("satisfaction_rating"),
        *([] if facts is None else [F.coalesce(F.col("frequency"), F.lit(0)).cast("int").alias("orders_listed"),
                                    F.coalesce(F.col("items_listed"), F.lit(0)).alias("items_listed")]),
    )
    return p.select(
        "*",
        segment_expr("recency", "frequency").alias("segment"),
        clv_multiplier_expr("monetary", "frequency").alias("clv"),
        churn_heuristic_expr("recency", "support_tickets", "frequency", "satisfaction_rating").alias("churn_risk"),
        (F.col("recency") <= 90).alias("active_status"),
        safe_ratio("monetary", "frequency").alias("avg_order_value"),
    )


SEGMENT_COLUMNS = ["customer_id", "recency_days", "frequency_count", "monetary_spend", "recency_score",
                   "frequency_score", "monetary_score", "segment_name", "clv_estimated",
                   "churn_risk_probability", "last_updated"]


def segment_facts(profile: DataFrame) -> DataFrame:
    """The ``customer_segments`` columns that need no global ranking, typed
    as the relational table.  Readers that do not use the quintile scores
    (the watch-list, retention actions, key checks) take this frame and skip
    the three distributed rankings."""
    return profile.select(
        "customer_id",
        F.col("recency").cast("int").alias("recency_days"),
        F.col("frequency").cast("int").alias("frequency_count"),
        F.col("monetary").cast("decimal(15,2)").alias("monetary_spend"),
        F.col("segment").alias("segment_name"),
        F.col("clv").cast("decimal(15,2)").alias("clv_estimated"),
        F.col("churn_risk").cast("decimal(5,2)").alias("churn_risk_probability"),
    )


def build_customer_segments(profile: DataFrame, num_partitions: int | None = None,
                            updated_at=None) -> DataFrame:
    """The ``customer_segments`` result table: one row per profiled customer
    with R/F/M, quintile scores (over all profiled customers), segment, CLV
    and heuristic churn probability, typed as the relational table."""
    facts = segment_facts(profile)
    # written once: the cut rows and the scores both read it
    ensure_checkpoint_dir(facts.sparkSession)
    facts = facts.checkpoint(eager=True)
    ranked = rfm_scores(facts.withColumnsRenamed({"recency_days": "recency", "frequency_count": "frequency",
                                                  "monetary_spend": "monetary"}),
                        num_partitions=num_partitions)
    stamp = F.current_timestamp() if updated_at is None else F.lit(updated_at).cast("timestamp")
    return (ranked.withColumnsRenamed({"recency": "recency_days", "frequency": "frequency_count",
                                       "monetary": "monetary_spend"})
            .withColumn("last_updated", stamp)
            .select(*SEGMENT_COLUMNS))


def churn_watchlist(customers: DataFrame, segments: DataFrame, min_recency: int = 45,
                    n: int = 50, status: str = "active") -> DataFrame:
    """Active customers away longer than ``min_recency`` days, highest churn
    probability first (ties by customer id), first ``n``, with the retention
    action.  The limit is the report itself (a top-n list)."""
    c = customers.filter(F.col("status") == status).select(
        F.col("id").alias("customer_id"),
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("customer_name"),
        "email", "status")
    s = segments.filter(F.col("recency_days") > min_recency)
    return (c.join(s, "customer_id")
             .select("customer_id", "customer_name", "email", "status", "recency_days",
                     "frequency_count", "monetary_spend", "clv_estimated", "churn_risk_probability",
                     retention_action_expr("churn_risk_probability").alias("retention_action"))
             .orderBy(F.col("churn_risk_probability").desc(), F.col("customer_id").asc())
             .limit(n))
