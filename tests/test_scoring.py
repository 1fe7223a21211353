import pytest
from pyspark.sql import functions as F

from spendlens.functions import labels as L
from spendlens.operators import scoring


def score_input(spark, rows):
    rows = [(r[0], *map(float, r[1:])) for r in rows]
    return spark.createDataFrame(rows, "customer_id string, recency double, frequency double, "
                                       "avg_order_value double, support_tickets double, discount_usage double, "
                                       "satisfaction double")


def test_logistic_goldens(spark):
    df = score_input(spark, [("a", 40, 4, 120, 1, 25, 4), ("b", 120, 1, 60, 4, 50, 2), ("c", 10, 10, 200, 0, 10, 5)])
    out = scoring.churn_actions(scoring.risk_bands(scoring.churn_logistic_score(df)))
    got = {r["customer_id"]: r for r in out.collect()}
    assert got["a"]["churn_probability"] == 38 and not got["a"]["is_high_risk"]
    assert [got["a"][c] for c in ("recency_factor", "frequency_factor", "support_factor", "satisfaction_factor")] \
        == ["medium", "low", "medium", "low"]
    assert got["a"]["recommendations"] == [L.NEWSLETTER]
    assert got["b"]["churn_probability"] == 100 and got["b"]["is_high_risk"]
    assert {got["b"][c] for c in ("recency_factor", "frequency_factor", "support_factor", "satisfaction_factor")} \
        == {"high"}
    assert got["b"]["recommendations"] == [L.REACTIVATION_25, L.CX_CALL, L.SECOND_PURCHASE, L.SUPPORT_CREDIT]
    assert got["c"]["churn_probability"] == 0
    assert got["c"]["recommendations"] == [L.NEWSLETTER]


def test_logistic_monotone_in_recency(spark):
    df = score_input(spark, [(str(r), r, 3, 100, 1, 20, 4) for r in range(0, 200, 5)])
    probs = [r[0] for r in scoring.churn_logistic_score(df).orderBy("recency").select("churn_probability").collect()]
    assert probs == sorted(probs)


def test_heuristic_clamps(spark):
    df = spark.createDataFrame([(0, 0, 1, 5), (300, 5, 1, 1)],
                               "recency int, support_tickets int, frequency int, satisfaction_rating int")
    got = [r[0] for r in scoring.churn_heuristic(df).select("churn_risk").collect()]
    assert got == [0.0, 100.0]


@pytest.mark.parametrize("f,r,label", [
    (8, 30, L.CHAMPIONS), (8, 31, L.LOYALISTS), (3, 45, L.POTENTIAL), (3, 121, L.AT_RISK),
    (2, 181, L.HIBERNATING), (1, 30, L.NEW_CUSTOMERS), (1, 31, L.NEED_ATTENTION)])
def test_segments(spark, f, r, label):
    df = spark.createDataFrame([(f, r)], "frequency int, recency int")
    assert scoring.assign_segment(df).first()["segment"] == label


def test_clv_goldens(spark):
    df = spark.createDataFrame([(100.0, 4)], "monetary double, frequency int")
    assert scoring.clv_discounted(df).first()["clv_estimate"] == 43.93
    assert scoring.clv_multiplier(df).first()["clv"] == 182.0


def test_retention_action_thresholds(spark):
    df = spark.createDataFrame([(85.0,), (60.0,), (59.99,)], "churn_risk_probability double")
    got = [r[0] for r in scoring.retention_action(df).select("retention_action").collect()]
    assert got == [L.ACTION_CRITICAL, L.ACTION_WARNING, L.ACTION_STABLE]


def test_churn_label(spark):
    df = spark.createDataFrame([(90,), (91,)], "recency int")
    assert [r[0] for r in scoring.churn_label(df).select("churn_label").collect()] == [0, 1]


def test_risk_bands_struct(spark):
    df = score_input(spark, [("a", 40, 4, 120, 1, 25, 4)])
    got = scoring.risk_bands(df, as_struct=True).first()["risk_factor_breakdown"]
    assert got.asDict() == {"recency_factor": "medium", "frequency_factor": "low",
                            "support_factor": "medium", "satisfaction_factor": "low"}
