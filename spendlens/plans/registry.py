"""Query registry: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each entry runs an operator of the library over the whole test tables (via
the adapter in ``sources.testdata``).  Column names match ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import dbl, js_round
from spendlens.operators import catalog, clean, cohort, export, ml, pareto, quality, revenue, scoring, search, summary
from spendlens.operators import profile as prof
from spendlens.operators import rfm as rfm_ops
from spendlens.session import stored
from spendlens.sources.testdata import Tables, load_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def _rfm(t: Tables) -> DataFrame:
    return rfm_ops.rfm_base(t.orders, t.snapshot)


@query("rfm_base")
def q_rfm_base(t: Tables) -> DataFrame:
    """RFM-1: recency, frequency, monetary per customer (completed orders)."""
    return _rfm(t).withColumn("monetary", F.col("monetary").cast("double"))


@query("rfm_scores")
def q_rfm_scores(t: Tables) -> DataFrame:
    """Query B: quintile scores and rfm_code."""
    return rfm_ops.rfm_scores(_rfm(t)).select(
        "customer_id", "recency", "frequency", F.col("monetary").cast("double").alias("monetary"),
        "recency_score", "frequency_score", "monetary_score", "rfm_code")


# --------------------------------------------------------------- shared parts
def _money():
    return F.col("monetary").cast("double").alias("monetary")


def _profile(t: Tables) -> DataFrame:
    return t._memo("profile", lambda: prof.customer_profile(
        t.customer_base, None, t.ticket_features, t.snapshot, facts=t.customer_facts))


def _segments_table(t: Tables) -> DataFrame:
    return t._memo("segments_table", lambda: prof.build_customer_segments(_profile(t)))


def _segment_facts(t: Tables) -> DataFrame:
    """customer_segments without the quintile scores (no rankings needed)."""
    return t._memo("segment_facts", lambda: prof.segment_facts(_profile(t)))


def _summary(t: Tables) -> DataFrame:
    return t._memo("summary", lambda: summary.segment_summary(_profile(t)))


def _kpis(t: Tables) -> DataFrame:
    return t._memo("kpis", lambda: summary.kpi_stats(_profile(t)))


def _scoring_input(t: Tables) -> DataFrame:
    return _profile(t).select("customer_id", "recency", "frequency", "avg_order_value", "support_tickets",
                              "discount_usage", F.col("satisfaction_rating").alias("satisfaction"))


def _tables_for_checks(t: Tables, scores: bool = True) -> dict[str, quality.Table]:
    """The canonical tables; customer_segments with its scores is written once,
    its per-row checks being metrics of that write.  ``scores=False`` hands checks
    that never read the scores the columns that need no ranking."""
    segs = (t._memo("checked", lambda: quality.write_checked("customer_segments", _segments_table(t), "customer_segments"))
            if scores else _segment_facts(t))
    return {"customers": t.customers, "categories": t.categories, "products": t.raw_products,
            "orders": t.raw_orders, "order_items": t.raw_order_items, "customer_segments": segs}


# ----------------------------------------------------------------- RFM family
@query("rfm_segments")
def q_rfm_segments(t: Tables) -> DataFrame:
    """SEG-1 over the RFM base of customers with a completed order."""
    return scoring.assign_segment(_rfm(t)).select("customer_id", "recency", "frequency", _money(), "segment")


@query("monetary_fence")
def q_monetary_fence(t: Tables) -> DataFrame:
    """AGG-10: spend quartiles (exact, distributed) and the IQR upper fence."""
    f = rfm_ops.monetary_fence(_rfm(t))
    return f.select(*[js_round(c, 4).alias(c) for c in ("q1", "q3", "iqr", "upper_fence")])


@query("spend_outliers")
def q_spend_outliers(t: Tables) -> DataFrame:
    """AGG-10 flag: customers above the upper fence (rows are kept)."""
    return rfm_ops.spend_outliers(_rfm(t)).select("customer_id", _money(), "is_outlier")


@query("clv_discounted")
def q_clv_discounted(t: Tables) -> DataFrame:
    """CLV-1 on the RFM base."""
    return scoring.clv_discounted(_rfm(t)).select("customer_id", _money(), "frequency", "aov", "clv_estimate")


@query("clv_profile")
def q_clv_profile(t: Tables) -> DataFrame:
    """CLV-1 / AGG-13 over the whole profile, customers without orders included."""
    return scoring.clv_discounted(_profile(t).select("customer_id", "monetary", "frequency")) \
        .select("customer_id", _money(), "frequency", "aov", "clv_estimate")


@query("clv_multiplier")
def q_clv_multiplier(t: Tables) -> DataFrame:
    """CLV-2 over the customer profile."""
    return scoring.clv_multiplier(_profile(t).select("customer_id", "monetary", "frequency"), out="clv_value") \
        .select("customer_id", _money(), "frequency", "clv_value")


@query("churn_label")
def q_churn_label(t: Tables) -> DataFrame:
    """LBL-1: recency > 90 days -> 1."""
    return scoring.churn_label(_rfm(t)).select("customer_id", "recency", "churn_label")


# --------------------------------------------------------------- cohorts
@query("cohort_sizes")
def q_cohort_sizes(t: Tables) -> DataFrame:
    """AGG-1a: customers per signup month."""
    return cohort.cohort_sizes(t.customers).select(
        F.date_format("cohort_start", "yyyy-MM").alias("cohort_month"),
        F.col("cohort_size").cast("long").alias("cohort_size"))


@query("cohort_retention")
def q_cohort_retention(t: Tables) -> DataFrame:
    """Query A: long-form cohort retention, month index 0..12."""
    return cohort.cohort_retention(t.customers, t.orders)


@query("cohort_matrix")
def q_cohort_matrix(t: Tables) -> DataFrame:
    """AGG-2: last 12 cohorts x 12 months retention and revenue retention."""
    return cohort.cohort_matrix(t.customers, t.orders, t.snapshot)


# --------------------------------------------------------------- Pareto
@query("pareto_customers")
def q_pareto_customers(t: Tables) -> DataFrame:
    """WIN-3..7: per-customer rank, percentile, running spend, bracket."""
    return pareto.pareto_customers(t.orders)


@query("pareto_summary")
def q_pareto_summary(t: Tables) -> DataFrame:
    """Query C: revenue share of the top 25 % of accounts."""
    return pareto.pareto_summary(t.orders)


# ------------------------------------------------- profile and result table
@query("customer_profile")
def q_customer_profile(t: Tables) -> DataFrame:
    """AGG-15: the per-customer record (order list summarised by its size)."""
    return _profile(t).select("customer_id", "name", "email", "country", "signup_date", "segment", "recency",
                              "frequency", _money(), "clv", "churn_risk", "active_status", "discount_usage",
                              "support_tickets", "satisfaction_rating", "last_purchase_date", "orders_listed", "items_listed")


@query("customer_segments")
def q_customer_segments(t: Tables) -> DataFrame:
    """SNK-7: the customer_segments table (without the load timestamp)."""
    return _segments_table(t).select(
        "customer_id", "recency_days", "frequency_count",
        F.col("monetary_spend").cast("double").alias("monetary_spend"),
        "recency_score", "frequency_score", "monetary_score", "segment_name",
        F.col("clv_estimated").cast("double").alias("clv_estimated"),
        F.col("churn_risk_probability").cast("double").alias("churn_risk_probability"))


@query("churn_watchlist")
def q_churn_watchlist(t: Tables) -> DataFrame:
    """Query D: top-50 dormant active customers by churn risk."""
    w = prof.churn_watchlist(t.customers, _segment_facts(t))
    return w.select("customer_id", "customer_name", "email", "status", "recency_days", "frequency_count",
                    F.col("monetary_spend").cast("double").alias("monetary_spend"),
                    F.col("clv_estimated").cast("double").alias("clv_estimated"),
                    F.col("churn_risk_probability").cast("double").alias("churn_risk_probability"),
                    "retention_action")


@query("retention_action")
def q_retention_action(t: Tables) -> DataFrame:
    """SC-5 over every row of customer_segments."""
    s = _segment_facts(t)
    return scoring.retention_action(s).select(
        "customer_id", F.col("churn_risk_probability").cast("double").alias("churn_risk_probability"),
        "retention_action")


# ------------------------------------------------------------- summaries
@query("kpi_stats")
def q_kpi_stats(t: Tables) -> DataFrame:
    """AGG-4: dashboard KPIs."""
    return _kpis(t)


@query("segment_summary")
def q_segment_summary(t: Tables) -> DataFrame:
    """AGG-5: the seven segments."""
    return _summary(t).drop("position")


@query("largest_segment")
def q_largest_segment(t: Tables) -> DataFrame:
    """AGG-16."""
    return summary.largest_segment(_summary(t)).select("id", "name", "size", "percentage")


@query("segment_digest")
def q_segment_digest(t: Tables) -> DataFrame:
    """SNK-5: the segment table as one JSON array."""
    return summary.segment_digest(_summary(t))


@query("executive_digest")
def q_executive_digest(t: Tables) -> DataFrame:
    """SNK-6: headline facts in one row."""
    return summary.executive_digest(_profile(t))


# --------------------------------------------------------------- catalogue
def _product_metrics(t: Tables) -> DataFrame:
    return t._memo("pm", lambda: catalog.product_metrics(t.order_items, t.products))


@query("product_metrics")
def q_product_metrics(t: Tables) -> DataFrame:
    """AGG-6: per product lines, revenue, rating, refund rate."""
    return _product_metrics(t)


@query("top_products")
def q_top_products(t: Tables) -> DataFrame:
    """SRT-3: the 50 products with the most revenue."""
    return catalog.top_products(_product_metrics(t))


@query("category_metrics")
def q_category_metrics(t: Tables) -> DataFrame:
    """AGG-7 / SRT-4: per category revenue, lines, AOV, market share."""
    return catalog.category_metrics(t.order_items, t.products)


@query("distinct_categories")
def q_distinct_categories(t: Tables) -> DataFrame:
    """AGG-12 / SET-2."""
    return catalog.distinct_categories(t.products)


# ----------------------------------------------------------------- revenue
def _monthly(t: Tables) -> DataFrame:
    return t._memo("monthly", lambda: revenue.monthly_revenue(t.orders, t.snapshot))


@query("monthly_revenue")
def q_monthly_revenue(t: Tables) -> DataFrame:
    """AGG-8: last 12 months with the fitted trend."""
    return _monthly(t)


@query("revenue_forecast")
def q_revenue_forecast(t: Tables) -> DataFrame:
    """FC-1 / SET-1: history plus a 3-month forecast."""
    aov = summary.average_order_value(t.orders).scalar()
    return revenue.revenue_forecast(_monthly(t), aov)


# ------------------------------------------------------------------ search
SEARCH_TEXT = "00001"
PAGE_SEGMENT = "At Risk / Sleeping"
PAGE_COUNTRY = "NATION_3"


def _found(t: Tables) -> DataFrame:
    return search.customer_search(_profile(t), "", PAGE_SEGMENT, PAGE_COUNTRY)


@query("customer_search")
def q_customer_search(t: Tables) -> DataFrame:
    """FLT-4: literal, case-folded text search on name / email / id."""
    return search.customer_search(_profile(t), SEARCH_TEXT).select(
        "customer_id", "name", "email", "segment", "country")


@query("customer_page")
def q_customer_page(t: Tables) -> DataFrame:
    """FLT-5/6 + PAG-1: page 2 (10 rows) of a segment and country filter."""
    return search.customer_page(_found(t), page=2, limit=10).select(
        "customer_id", "name", "segment", "country", "recency", _money(), "churn_risk")


@query("customer_page_indexed")
def q_customer_page_indexed(t: Tables) -> DataFrame:
    """PAG-1 over the stored profile and its page index: the page of customer_page, read as a key range."""
    paged = stored(search.paged_profile(_profile(t)), "paged-profile")
    index = stored(search.page_index(paged), "page-index")
    return search.customer_page_indexed(paged, index, PAGE_SEGMENT, PAGE_COUNTRY, page=2, limit=10).select(
        "customer_id", "name", "segment", "country", "recency", _money(), "churn_risk")


@query("customer_page_info")
def q_customer_page_info(t: Tables) -> DataFrame:
    """PAG-1 pagination block of the same filter."""
    return search.page_info(_found(t), page=2, limit=10)


@query("filtered_stats")
def q_filtered_stats(t: Tables) -> DataFrame:
    """AGG-9: statistics over the whole filtered set."""
    return search.filtered_stats(_found(t))


# ---------------------------------------------------------------- scoring
@query("churn_heuristic")
def q_churn_heuristic(t: Tables) -> DataFrame:
    """SC-1: heuristic churn risk 0..100."""
    return _profile(t).select("customer_id", "recency", "frequency", "support_tickets",
                              "satisfaction_rating", "churn_risk")


@query("churn_logistic_score")
def q_churn_logistic_score(t: Tables) -> DataFrame:
    """SC-2: fixed-weight logistic churn probability, batch."""
    return scoring.churn_logistic_score(_scoring_input(t)).select(
        "customer_id", "churn_probability", "is_high_risk")


@query("risk_bands")
def q_risk_bands(t: Tables) -> DataFrame:
    """SC-3: four risk factor bands."""
    return scoring.risk_bands(_scoring_input(t)).select(
        "customer_id", "recency_factor", "frequency_factor", "support_factor", "satisfaction_factor")


@query("churn_actions")
def q_churn_actions(t: Tables) -> DataFrame:
    """SC-4: recommended actions (codes joined by '|')."""
    return scoring.churn_actions(_scoring_input(t)).select(
        "customer_id", F.array_join("recommendations", "|").alias("actions"))


# -------------------------------------------------------- cleaning and DQ
@query("orders_clean")
def q_orders_clean(t: Tables) -> DataFrame:
    """CLN-2..4: completed orders, amount filled, duplicates dropped."""
    o = clean.clean_orders(t.orders.select("id", "customer_id", "order_date", "status", "total_amount"))
    return o.withColumn("total_amount", dbl("total_amount"))


@query("dq_nulls")
def q_dq_nulls(t: Tables) -> DataFrame:
    """DQ-1."""
    return quality.check_not_null(_tables_for_checks(t))


@query("dq_duplicates")
def q_dq_duplicates(t: Tables) -> DataFrame:
    """DQ-2."""
    return quality.check_unique(_tables_for_checks(t, scores=False))


@query("dq_orphans")
def q_dq_orphans(t: Tables) -> DataFrame:
    """DQ-3."""
    return quality.check_foreign_keys(_tables_for_checks(t, scores=False))


@query("dq_domains")
def q_dq_domains(t: Tables) -> DataFrame:
    """DQ-4."""
    return quality.check_domains(_tables_for_checks(t, scores=False))


@query("dq_ranges")
def q_dq_ranges(t: Tables) -> DataFrame:
    """DQ-5."""
    return quality.check_ranges(_tables_for_checks(t))


@query("dq_lengths")
def q_dq_lengths(t: Tables) -> DataFrame:
    """DQ-6."""
    return quality.check_lengths(_tables_for_checks(t, scores=False))


@query("dq_report")
def q_dq_report(t: Tables) -> DataFrame:
    """DQ-1..6 in one report."""
    return quality.check_all(_tables_for_checks(t))


# ----------------------------------------------------------------- exports
@query("export_segments")
def q_export_segments(t: Tables) -> DataFrame:
    """SNK-1: the segment CSV frame."""
    return export.export_segments(_summary(t))


@query("export_products")
def q_export_products(t: Tables) -> DataFrame:
    """SNK-2: the product CSV frame."""
    return export.export_products(_product_metrics(t))


@query("export_customers")
def q_export_customers(t: Tables) -> DataFrame:
    """SNK-3: the first 150 customers."""
    return export.export_customers(_profile(t))


@query("export_customers_json")
def q_export_customers_json(t: Tables) -> DataFrame:
    """SNK-4: the first 100 customer records with their order lists."""
    first = _profile(t).orderBy("customer_id").limit(export.JSON_CUSTOMER_ROWS).select("customer_id")
    lists = prof.order_lists(t.orders, t.order_items, customers=first)
    records = export.export_customer_records(_profile(t), lists)
    return records.withColumn("orders", F.to_json("orders"))  # as text, to be compared


@query("export_segments_json")
def q_export_segments_json(t: Tables) -> DataFrame:
    """SNK-4: the segment rows with the keys of the JSON export."""
    return export.export_frame("segments", "json", summary=_summary(t))


@query("export_products_json")
def q_export_products_json(t: Tables) -> DataFrame:
    """SNK-4: the product rows with the keys of the JSON export."""
    return export.export_frame("products", "json", metrics=_product_metrics(t))


@query("order_rows")
def q_order_rows(t: Tables) -> DataFrame:
    """ARR-1: every completed order with its position in its customer's history."""
    return prof.order_rows(t.orders, t.order_items)


# --------------------------------------------------------------------- ML
@query("scaled_features")
def q_scaled_features(t: Tables) -> DataFrame:
    """ML-1: standardised recency, frequency and monetary (4 dp)."""
    r = _rfm(t)
    z = ml.standardize(r, ml.RFM_FEATURES, ml.scaling_stats(r, ml.RFM_FEATURES))
    return z.select("customer_id", *[js_round(f"{c}_z", 4).alias(f"{c}_z") for c in ml.RFM_FEATURES])


@query("label_profile")
def q_label_profile(t: Tables) -> DataFrame:
    """AGG-11 over a deterministic label: means and sizes by churn label."""
    return ml.cluster_profile(scoring.churn_label(_rfm(t)).withColumnRenamed("churn_label", "cluster_label"))


@query("split_sizes")
def q_split_sizes(t: Tables) -> DataFrame:
    """ML-3: rows of each class on each side of the stratified split."""
    split = ml.stratified_split(scoring.churn_label(_rfm(t)).select("customer_id", "churn_label"), "churn_label", "customer_id")
    return split.groupBy("churn_label", "is_train").agg(F.count(F.lit(1)).alias("rows"))


@query("risk_bands_json")
def q_risk_bands_json(t: Tables) -> DataFrame:
    """STR-1: the four bands as one struct, printed as JSON."""
    return scoring.risk_bands(_scoring_input(t), as_struct=True).select(
        "customer_id", F.to_json("risk_factor_breakdown").alias("bands"))


def _model_input(t: Tables) -> DataFrame:
    f = t.ticket_features.select("customer_id", "support_tickets",
                                 F.col("satisfaction_rating").alias("satisfaction_score"))
    return scoring.churn_label(_rfm(t)).join(f, "customer_id", "left").fillna(
        {"support_tickets": 0, "satisfaction_score": 5})


@query("cluster_profile")
def q_cluster_profile(t: Tables) -> DataFrame:
    """ML-1/2 + AGG-11: K-Means (k=4) cluster means and sizes (rows only)."""
    clustered, _ = ml.cluster_customers(_rfm(t).withColumn("monetary", dbl("monetary")))
    return ml.cluster_profile(clustered)


def _trained(t: Tables):
    return t._memo("trained", lambda: ml.train_churn(_model_input(t).withColumn("monetary", dbl("monetary"))))


@query("churn_predictions")
def q_churn_predictions(t: Tables) -> DataFrame:
    """ML-3/4: fitted logistic model on the test split (probabilities to 5 dp)."""
    return _trained(t)[0].withColumn("probability", js_round("probability", 5))


@query("coefficients")
def q_coefficients(t: Tables) -> DataFrame:
    """ML-7: fitted coefficients on standardised features, and the intercept (5 dp)."""
    return _trained(t)[2].withColumn("coefficient", js_round("coefficient", 5))


@query("model_report")
def q_model_report(t: Tables) -> DataFrame:
    """ML-5 on the fitted model's test predictions."""
    return ml.classification_report(_trained(t)[0])


def _score_vs_label(t: Tables) -> DataFrame:
    scored = scoring.churn_logistic_score(_scoring_input(t))
    return scored.select("customer_id", (F.col("recency") > 90).cast("int").alias("churn_label"),
                         F.col("is_high_risk").cast("int").alias("prediction"),
                         (F.col("churn_probability") / 100.0).alias("probability"))


@query("classification_report")
def q_classification_report(t: Tables) -> DataFrame:
    """ML-5: report of the fixed-weight score (>= 50) against the churn label."""
    return ml.classification_report(_score_vs_label(t))


@query("roc_auc")
def q_roc_auc(t: Tables) -> DataFrame:
    """ML-6: exact ROC AUC of the fixed-weight score against the churn label."""
    return ml.roc_auc(_score_vs_label(t))
