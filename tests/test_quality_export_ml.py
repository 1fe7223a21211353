import csv
import glob
import json
import random
import tempfile

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from spendlens.operators import export, ml, quality
from spendlens.sources import schemas


def _violations(frame):
    return {(r["table_name"], r["column_name"]): r["violations"] for r in frame.collect()}


def test_quality_checks_find_planted_violations(spark):
    customers = spark.createDataFrame(
        [("c1", "A", "B", "a@x", "NA", None, "gold", "active"),
         ("c1", "A", None, "a@x", "NA", None, "diamond", "asleep"),
         ("c3" * 30, "E", "F", "e@x", "NA", None, "standard", "active")],
        "id string, first_name string, last_name string, email string, country string, signup_date date, "
        "loyalty_tier string, status string")
    orders = spark.createDataFrame([("o1", "c1", "completed"), ("o2", "ghost", "lost"), ("o3", None, None)],
                                   "id string, customer_id string, status string")
    tables = {"customers": customers, "orders": orders}
    nulls = _violations(quality.check_not_null(tables))
    assert nulls[("customers", "last_name")] == 1 and nulls[("customers", "signup_date")] == 3
    assert nulls[("orders", "customer_id")] == 1
    uniq = _violations(quality.check_unique(tables))
    assert uniq[("customers", "id")] == 1 and uniq[("customers", "email")] == 1
    fk = _violations(quality.check_foreign_keys(tables))
    assert fk[("orders", "customer_id->customers.id")] == 1
    dom = _violations(quality.check_domains(tables))
    assert dom[("customers", "loyalty_tier")] == 1 and dom[("customers", "status")] == 1
    assert dom[("orders", "status")] == 1
    lens = _violations(quality.check_lengths(tables))
    assert lens[("customers", "id")] == 1


def test_range_and_precision(spark):
    from decimal import Decimal
    seg = spark.createDataFrame([("a", 0, 5, 6, Decimal("101.00"), Decimal("99999999999999999.00"))],
                                "customer_id string, recency_score int, frequency_score int, monetary_score int, "
                                "churn_risk_probability decimal(5,2), monetary_spend decimal(20,2)")
    v = _violations(quality.check_ranges({"customer_segments": seg}))
    assert v[("customer_segments", "recency_score")] == 1 and v[("customer_segments", "monetary_score")] == 1
    assert v[("customer_segments", "frequency_score")] == 0
    assert v[("customer_segments", "churn_risk_probability")] == 1
    assert v[("customer_segments", "monetary_spend:decimal(15,2)")] == 1


def test_precision_of_values_before_the_cast(spark):
    orders = spark.createDataFrame(
        [("o1", "9999999999999.99"), ("o2", "10000000000000.00"), ("o3", "12x"), ("o4", None), ("o5", "9999999999999.999")],
        "id string, raw_total_amount string").withColumn("total_amount", F.expr("try_cast(raw_total_amount AS decimal(15,2))"))
    v = _violations(quality.check_ranges({"orders": orders}))
    assert v[("orders", "total_amount:decimal(15,2)")] == 3  # too large, no number, too large once rounded
    assert _violations(quality.check_not_null({"orders": orders}))[("orders", "total_amount")] == 1
    typed = _violations(quality.check_ranges({"orders": orders.drop("raw_total_amount")}))
    assert typed[("orders", "total_amount:decimal(15,2)")] == 0


def test_every_decimal_column_has_a_precision_rule():
    assert schemas.PRECISION == {
        ("products", "price"): (10, 2), ("products", "rating"): (3, 2),
        ("orders", "total_amount"): (15, 2), ("orders", "shipping_cost"): (10, 2), ("orders", "discount_amount"): (10, 2),
        ("order_items", "unit_price"): (10, 2), ("order_items", "discount_applied"): (10, 2),
        ("order_items", "line_amount"): (15, 2), ("payments", "amount"): (15, 2),
        ("customer_segments", "monetary_spend"): (15, 2), ("customer_segments", "clv_estimated"): (15, 2),
        ("customer_segments", "churn_risk_probability"): (5, 2)}


def test_planted_payments(spark):
    payments = spark.createDataFrame(
        [(1, "o1", "12.50", "PayPal", "captured"), (1, "ghost", "99999999999999", "barter", "lost"), (2, None, None, None, None)],
        "id int, order_id string, raw_amount string, payment_gateway string, transaction_status string"
    ).withColumn("amount", F.expr("try_cast(raw_amount AS decimal(15,2))"))
    tables = {"payments": payments, "orders": spark.createDataFrame([("o1",)], "id string")}
    found = {(r["rule"], r["column_name"]): r["violations"]
             for r in quality.check_all(tables).filter("table_name = 'payments'").collect()}
    assert found[("unique", "id")] == 1 and found[("foreign_key", "order_id->orders.id")] == 1
    assert found[("domain", "payment_gateway")] == 1 and found[("domain", "transaction_status")] == 1
    assert found[("range", "amount:decimal(15,2)")] == 1
    assert found[("not_null", "order_id")] == 1 and found[("not_null", "amount")] == 1


def test_export_csv_round_trip(spark):
    summary = spark.createDataFrame([(1, "champions", "Champions", 3, 12.5, 10.0, 8.5, 100.25, "d"),
                                     (2, "loyalists", "Loyalists, \"quoted\"", 5, 20.0, 3.0, 2.0, 10.0, "d")],
                                    "position int, id string, name string, size long, percentage double, "
                                    "avg_recency double, avg_frequency double, avg_monetary double, description string")
    frame = export.export_segments(summary)
    out = tempfile.mkdtemp(prefix="spendlens-export-")
    export.write_export(frame, out + "/csv", "csv", single_file=True)
    export.write_export(frame, out + "/json", "json", single_file=True)
    with open(glob.glob(out + "/csv/part-*.csv")[0], newline="") as fh:
        rows = list(csv.reader(fh))
    assert rows[0] == export.SEGMENT_HEADERS
    assert rows[1][3] == "12.5%" and rows[2][3] == "20%" and rows[2][1] == 'Loyalists, "quoted"'
    with open(glob.glob(out + "/json/part-*.json")[0]) as fh:
        first = json.loads(fh.readline())
    assert first["Segment ID"] == "champions"


def test_roc_auc_matches_mllib(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(400)]  # rounded scores -> ties
    df = spark.createDataFrame(rows, "id int, churn_label int, probability double")
    mine = ml.roc_auc(df).first()["roc_auc"]
    ref = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="churn_label",
                                        metricName="areaUnderROC", numBins=0).evaluate(
        df.withColumn("churn_label", F.col("churn_label").cast("double")))
    assert abs(mine - ref) < 1e-12


def test_classification_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "churn_label int, prediction int")
    rep = {r["class"]: r for r in ml.classification_report(df).collect()}
    assert (rep["1"]["precision"], rep["1"]["recall"]) == (1.0, 0.5)
    assert rep["0"]["precision"] == 0.666667 and rep["accuracy"]["f1_score"] == 0.75
    assert rep["weighted avg"]["support"] == 4


def test_stratified_split_exact_shares(spark):
    df = spark.createDataFrame([(f"c{i}", 1 if i % 4 == 0 else 0) for i in range(1000)],
                               "customer_id string, churn_label int")
    s = ml.stratified_split(df, "churn_label", "customer_id", 0.7, 42, num_partitions=4)
    got = {(r["churn_label"], r["is_train"]): r["count"] for r in s.groupBy("churn_label", "is_train").count().collect()}
    assert got[(1, True)] == 175 and got[(0, True)] == 525
    assert ml.split_quotas({0: 7, 1: 8}, 0.7) == {0: 5, 1: 5} and ml.split_quotas({0: 1429}, 0.7) == {0: 1000}
    assert ml.split_quotas({}, 0.7) == {} and sum(ml.split_quotas({0: 3, 1: 3, 2: 4}, 0.7).values()) == 7
    again = ml.stratified_split(df, "churn_label", "customer_id", 0.7, 42, num_partitions=3)
    assert sorted(s.filter("is_train").select("customer_id").collect()) == \
        sorted(again.filter("is_train").select("customer_id").collect())


def test_kmeans_labels_ordered_by_spend(spark):
    rnd = random.Random(5)
    rows = [(f"c{i}", float(rnd.randint(0, 300)), float(rnd.randint(1, 10)), float(rnd.randint(10, 5000)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "customer_id string, recency double, frequency double, monetary double")
    clustered, model = ml.cluster_customers(df, k=4, seed=42)
    prof = ml.cluster_profile(clustered).collect()
    # a fixed point: centres are their members' means, and every member is nearest to its own
    own = clustered.toPandas()
    x = own[ml.RFM_FEATURES].to_numpy(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    centres = np.stack([z[own.cluster_label == c].mean(axis=0) for c in range(4)])
    near = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert model.summary.numIter < 300 and (near == own.cluster_label).all()
    assert sorted(map(tuple, np.round(centres, 6))) == sorted(map(tuple, np.round(model.clusterCenters(), 6)))
    assert [r["cluster_label"] for r in prof] == [0, 1, 2, 3]
    means = [r["monetary_mean"] for r in prof]
    assert means == sorted(means, reverse=True) and sum(r["customers"] for r in prof) == 300


def test_roc_auc_without_a_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "churn_label int, probability double")
    assert ml.roc_auc(df).first()["roc_auc"] is None


def test_clv_without_orders(spark):
    from spendlens.operators import scoring
    df = spark.createDataFrame([("a", 0.0, 0), ("b", 30.0, 3)], "customer_id string, monetary double, frequency long")
    assert {r["customer_id"]: r["aov"] for r in scoring.clv_discounted(df).collect()} == {"a": 0.0, "b": 10.0}


def test_training_job_counts_whole_days(spark):
    from spendlens.sources.readers import orders_from_flat
    import datetime as dt
    from spendlens.operators import rfm
    flat = spark.createDataFrame([("o1", "c1", dt.datetime(2026, 5, 30, 10, 0), 5.0, "completed")],
                                 "order_id string, customer_id string, order_date timestamp, total_amount double, status string")
    base = rfm.rfm_base(orders_from_flat(flat, with_time=True), "2026-05-31", statuses=None, floor_timestamp=True)
    assert base.first()["recency"] == 0


def test_training_job_end_to_end(spark):
    import datetime as dt
    from spendlens.plans.training_job import run_training_job
    from spendlens.sources.readers import read_orders_csv
    rnd = random.Random(11)
    out = tempfile.mkdtemp(prefix="spendlens-orders-")
    with open(out + "/orders.csv", "w") as fh:
        fh.write("order_id,customer_id,order_date,total_amount,status\n")
        for i in range(600):
            day = dt.date(2026, 5, 31) - dt.timedelta(days=rnd.randint(1, 300))
            amount = "" if i % 50 == 0 else f"{rnd.uniform(15, 450):.2f}"
            status = "completed" if rnd.random() < 0.67 else "refunded"
            fh.write(f"ORD-{i},CUST-{rnd.randint(1, 60)},{day},{amount},{status}\n")
    flat = read_orders_csv(spark, out + "/orders.csv")
    behaviour = spark.createDataFrame([(f"CUST-{i}", i % 4, 5 - i % 5) for i in range(1, 61)],
                                      "customer_id string, support_tickets int, satisfaction_score int")
    res = run_training_job(flat, behaviour, "2026-05-31")
    n = res["rfm"].count()
    assert n == res["customers"].count() and sum(r["customers"] for r in res["cluster_profile"].collect()) == n
    assert res["predictions"].count() > 0 and res["coefficients"].count() == 5
    assert 0.0 <= res["roc_auc"].first()["roc_auc"] <= 1.0


def test_classification_report_skips_unknown_rows(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (None, 1), (1, None)], "churn_label int, prediction int")
    rep = {r["class"]: r for r in ml.classification_report(df).collect()}
    assert rep["accuracy"]["support"] == 2 and rep["accuracy"]["f1_score"] == 1.0


def test_export_frame_dispatch(spark):
    import datetime as dt
    from decimal import Decimal
    summary = spark.createDataFrame([(1, "champions", "Champions", 3, 12.5, 10.0, 8.5, 100.25, "d")],
                                    "position int, id string, name string, size long, percentage double, "
                                    "avg_recency double, avg_frequency double, avg_monetary double, description string")
    prof = spark.createDataFrame([("c1", "A B", "a@b", "N", dt.date(2026, 1, 1), "Champions", 10, 9,
                                   Decimal("10.00"), 18.2, 5.0, True, 3.0, 0, 5, dt.date(2026, 5, 1))],
                                 "customer_id string, name string, email string, country string, signup_date date, "
                                 "segment string, recency int, frequency long, monetary decimal(25,2), clv double, "
                                 "churn_risk double, active_status boolean, discount_usage double, "
                                 "support_tickets int, satisfaction_rating int, last_purchase_date date")
    assert export.export_frame("segments", "csv", summary=summary).columns == export.SEGMENT_HEADERS
    assert export.export_frame(None, "csv", profile=prof).first()["Churn Risk (%)"] == "5%"
    rec = export.export_frame(None, "json", profile=prof).first()
    assert rec["id"] == "c1" and rec["orders"] == [] and rec["churnRisk"] == 5.0
    assert export.export_frame("segments", "json", summary=summary).columns == [
        "id", "name", "size", "percentage", "avgRecency", "avgFrequency", "avgMonetary", "description"]
    lists = spark.createDataFrame([("c1", [(dt.date(2026, 5, 1), "o1", 10.0, 2)])], "customer_id string, orders " + export.ORDER_LIST)
    out = tempfile.mkdtemp(prefix="spendlens-export-")
    export.write_export(export.export_customer_records(prof, lists), out + "/json", "json", single_file=True)
    with open(glob.glob(out + "/json/part-*.json")[0]) as fh:
        assert json.loads(fh.readline())["orders"] == [{"date": "2026-05-01", "id": "o1", "amount": 10.0, "itemsCount": 2}]


def test_check_all_equals_union_of_checks(spark):
    customers = spark.createDataFrame(
        [("c1", "A", "B", "a@x", "NA", None, "gold", "active"), ("c1", "A", None, "a@x", "NA", None, "x", "y")],
        "id string, first_name string, last_name string, email string, country string, signup_date date, "
        "loyalty_tier string, status string")
    orders = spark.createDataFrame([("o1", "c1", "completed"), ("o2", "ghost", "lost")],
                                   "id string, customer_id string, status string")
    tables = {"customers": customers, "orders": orders}
    parts = [quality.check_not_null, quality.check_unique, quality.check_foreign_keys,
             quality.check_domains, quality.check_ranges, quality.check_lengths]
    expected = sorted(tuple(r) for f in parts for r in f(tables).collect())
    assert sorted(tuple(r) for r in quality.check_all(tables).collect()) == expected
