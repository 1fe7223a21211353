"""End-to-end modelling job: clean -> RFM (+ spend fence) -> K-Means clusters
-> CLV -> churn classifier with its evaluation.

Tables in, tables out; every step is one of the library operators.  The
inputs are flat order rows (order_id, customer_id, order_date, total_amount,
status) and behavioural inputs per customer (support_tickets,
satisfaction_score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import dbl
from spendlens.operators import clean, ml, rfm, scoring
from spendlens.session import ensure_checkpoint_dir
from spendlens.sources.readers import orders_from_flat


def run_training_job(flat_orders: DataFrame, behaviour: DataFrame, snapshot, k: int = 4,
                     seed: int = 42, churn_days: int = 90, model_path: str | None = None) -> dict[str, DataFrame]:
    """``model_path``: where the fitted churn pipeline is saved, for ``ml.score_churn`` (default: the checkpoint folder)."""
    ensure_checkpoint_dir(flat_orders.sparkSession)
    cleaned = clean.clean_orders(flat_orders)
    base = rfm.rfm_base(orders_from_flat(cleaned, with_time=True), snapshot, statuses=None, floor_timestamp=True)
    base = base.withColumn("monetary", dbl("monetary")).checkpoint(eager=True)  # read by every step below
    fence = rfm.monetary_fence(base)
    clustered, _ = ml.cluster_customers(base, k=k, seed=seed)
    valued = scoring.clv_discounted(clustered)
    labelled = scoring.churn_label(valued, churn_days)
    model_in = labelled.join(behaviour.select("customer_id", "support_tickets", "satisfaction_score"),
                             "customer_id", "left").fillna({"support_tickets": 0, "satisfaction_score": 5})
    pred, _, coefs = ml.train_churn(model_in, seed=seed, path=model_path)
    return {
        "orders_clean": cleaned,
        "rfm": base,
        "fence": fence,
        "customers": labelled,
        "cluster_profile": ml.cluster_profile(clustered),
        "predictions": pred,
        "report": ml.classification_report(pred),
        "roc_auc": ml.roc_auc(pred),
        "coefficients": coefs,
        "clv_total": valued.agg(F.sum("clv_estimate").alias("clv_total")),
    }
