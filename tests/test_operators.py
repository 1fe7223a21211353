import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.functions import labels as L
from spendlens.operators import catalog, clean, cohort, pareto, revenue, search, summary
from spendlens.operators.profile import customer_profile
from spendlens.operators.rfm import flag_outliers, monetary_fence, rfm_base

D = dt.date


def orders_df(spark, rows):
    """rows: (id, customer_id, date, status, amount)"""
    return spark.createDataFrame(rows, "id string, customer_id string, order_date date, status string, "
                                       "total_amount decimal(15,2)")


def spends(spark, amounts):
    from decimal import Decimal
    rows = [(f"o{i}", f"c{i}", D(2026, 1, 1), "completed", Decimal(str(a))) for i, a in enumerate(amounts)]
    return orders_df(spark, rows)


def test_pareto_goldens(spark):
    s = {r["customer_cohort"]: r for r in pareto.pareto_summary(spends(spark, [40, 30, 20, 10])).collect()}
    assert s[L.CORE_BRACKET]["distinct_accounts"] == 1 and s[L.CORE_BRACKET]["contribution_percentage"] == 40.0
    s = {r["customer_cohort"]: r for r in pareto.pareto_summary(spends(spark, [5] * 5)).collect()}
    assert s[L.CORE_BRACKET]["distinct_accounts"] == 1 and s[L.CORE_BRACKET]["contribution_percentage"] == 20.0
    per = pareto.pareto_customers(spends(spark, [5] * 5)).filter(F.col("customer_cohort") == L.CORE_BRACKET)
    assert [r["customer_id"] for r in per.collect()] == ["c0"]


def test_running_spend_range_ties(spark):
    per = pareto.pareto_customers(spends(spark, [30, 20, 20, 10]))
    got = [r["running_spend"] for r in per.orderBy("customer_rank").collect()]
    assert got == [30.0, 70.0, 70.0, 80.0]


def test_bracket_revenues_sum_to_total(spark):
    s = pareto.pareto_summary(spends(spark, list(range(1, 41))))
    assert sum(r["bracket_revenue"] for r in s.collect()) == sum(range(1, 41))


def test_monetary_fence_golden(spark):
    df = spark.createDataFrame([(f"c{i}", float(v)) for i, v in enumerate([1, 2, 3, 4])],
                               "customer_id string, monetary double")
    f = monetary_fence(df).first()
    assert (f["q1"], f["q3"], f["upper_fence"]) == (1.75, 3.25, 5.5)
    assert monetary_fence(df, approx=True).first()["q1"] in (1.0, 2.0)
    flagged = flag_outliers(df.union(spark.createDataFrame([("big", 100.0)], df.schema)), monetary_fence(df))
    assert flagged.filter("is_outlier").count() == 1 and flagged.count() == 5


def test_forecast_golden(spark):
    monthly = spark.createDataFrame([("2026-01", 0, 10.0, 1), ("2026-02", 1, 20.0, 2), ("2026-03", 2, 30.0, 3)],
                                    "month string, month_index int, actual_revenue double, orders_count long")
    out = revenue.revenue_forecast(monthly, 10.0).filter(F.col("forecast_revenue").isNotNull())
    rows = out.orderBy("month_index").collect()
    assert [r["forecast_revenue"] for r in rows] == [40.0, 50.0, 60.0]
    assert [r["month"] for r in rows] == ["2026-04", "2026-05", "2026-06"]
    assert [r["orders_count"] for r in rows] == [4, 5, 6]


def test_monthly_revenue_zero_fills_months(spark):
    from decimal import Decimal
    o = orders_df(spark, [("a", "c", D(2026, 5, 3), "completed", Decimal("10")),
                          ("b", "c", D(2026, 2, 3), "completed", Decimal("5"))])
    m = revenue.monthly_revenue(o, "2026-05-31").collect()
    assert len(m) == 12 and m[-1]["month"] == "2026-05" and m[-1]["actual_revenue"] == 10.0
    assert sum(r["orders_count"] for r in m) == 2


def test_paging_and_stats(spark):
    df = spark.createDataFrame([(f"{i:03d}", f"Name {i}", f"n{i}@x.org", "S", "C", i, float(i), 10.0)
                                for i in range(21)],
                               "customer_id string, name string, email string, segment string, country string, "
                               "recency int, monetary double, churn_risk double")
    assert search.customer_page(df, 3, 10).count() == 1
    info = search.page_info(df, 3, 10).first()
    assert (info["total_items"], info["total_pages"]) == (21, 3)
    assert search.customer_page(df, 0, 0).count() == 10  # 0 -> defaults
    empty = search.filtered_stats(df.filter("false")).first()
    assert tuple(empty) == (0.0, 0.0, 0.0)


def test_pages_and_their_arguments(spark):
    df = spark.range(50).select(F.format_string("%03d", "id").alias("customer_id"))
    ids = lambda found: [r[0] for r in found.collect()]
    assert ids(search.customer_page(df, 4, 7, num_partitions=3)) == [f"{i:03d}" for i in range(21, 28)]
    assert ids(search.customer_page(df, "2abc", "2.5")) == ["002", "003"]
    assert search._page_args("12abc", "2.5") == (12, 2) and search._page_args(None, "x") == (1, 10)
    assert search._page_args("-3", "0") == (1, 10) and search._page_args(" 7", 3.9) == (7, 3)
    assert ids(search.customer_page_after(df, "020", 3)) == ["021", "022", "023"] and len(ids(search.customer_page_after(df))) == 10


def test_search_is_literal(spark):
    df = spark.createDataFrame([("1", "a%b", "x@y", "S", "C"), ("2", "ab", "z@y", "S", "C")],
                               "customer_id string, name string, email string, segment string, country string")
    assert [r[0] for r in search.customer_search(df, "%").collect()] == ["1"]
    assert search.customer_search(df, "").count() == 2
    assert search.customer_search(df, "AB").count() == 1


def test_segment_summary_keeps_empty_segments(spark):
    from decimal import Decimal
    prof = spark.createDataFrame([("a", L.CHAMPIONS, 10, 9, Decimal("100.00")),
                                  ("b", L.CHAMPIONS, 20, 8, Decimal("50.00"))],
                                 "customer_id string, segment string, recency int, frequency long, "
                                 "monetary decimal(25,2)")
    rows = summary.segment_summary(prof).collect()
    assert [r["name"] for r in rows] == [s[1] for s in L.SEGMENTS]
    champ = rows[0]
    assert (champ["size"], champ["percentage"], champ["avg_recency"], champ["avg_monetary"]) == (2, 100.0, 15.0, 75.0)
    assert all(r["size"] == 0 and r["avg_recency"] == 0.0 for r in rows[1:])
    assert summary.largest_segment(summary.segment_summary(prof)).first()["name"] == L.CHAMPIONS


def test_kpis_zero_orders(spark):
    from decimal import Decimal
    prof = spark.createDataFrame([("a", 200, 0, Decimal("0.00"))],
                                 "customer_id string, recency int, frequency long, monetary decimal(25,2)")
    k = summary.kpi_stats(prof).first()
    assert (k["average_order_value"], k["churn_rate"], k["customer_retention_rate"]) == (0.0, 100.0, 0.0)


def test_clean_fill_precedes_dedupe(spark):
    df = spark.createDataFrame([("a", "completed", None), ("a", "completed", 0.0), ("b", "refunded", 1.0)],
                               "order_id string, status string, total_amount double")
    got = clean.clean_orders(df).collect()
    assert [tuple(r) for r in got] == [("a", "completed", 0.0)]


def test_cohort_retention_small(spark):
    from decimal import Decimal
    cust = spark.createDataFrame([("c1", D(2025, 11, 30)), ("c2", D(2025, 11, 2))], "id string, signup_date date")
    o = orders_df(spark, [("o1", "c1", D(2026, 2, 1), "completed", Decimal("1")),
                          ("o2", "c2", D(2025, 11, 5), "completed", Decimal("1")),
                          ("o3", "c2", D(2025, 11, 6), "refunded", Decimal("1"))])
    got = [(r["cohort_month"], r["month_index"], r["retained_customers"], r["retention_rate"])
           for r in cohort.cohort_retention(cust, o).collect()]
    assert got == [("2025-11", 0, 1, 50.0), ("2025-11", 3, 1, 50.0)]


def test_cohort_matrix_zero_revenue_base(spark):
    from decimal import Decimal
    cust = spark.createDataFrame([("c1", D(2026, 4, 10))], "id string, signup_date date")
    o = orders_df(spark, [("o1", "c1", D(2026, 4, 10), "completed", Decimal("0")),
                          ("o2", "c1", D(2026, 5, 2), "completed", Decimal("5"))])
    m = {r["cohort_month"]: r for r in cohort.cohort_matrix(cust, o, "2026-05-31").collect()}
    assert len(m) == 12 and m["2025-06"]["initial_count"] == 0 and m["2025-06"]["retention"] == [0.0] * 12
    r = m["2026-04"]
    assert r["retention"][:2] == [100.0, 100.0] and r["retention"][2:] == [0.0] * 10
    assert r["revenue_retention"] == [0.0] * 12


def test_product_and_category_metrics(spark):
    from decimal import Decimal
    items = spark.createDataFrame([("o1", "p1", 1, Decimal("2.00"), Decimal("2.00"), False),
                                   ("o2", "p1", 1, Decimal("2.00"), Decimal("2.00"), True),
                                   ("o2", "p2", 3, Decimal("1.00"), Decimal("3.00"), False)],
                                  "order_id string, product_id string, quantity int, unit_price decimal(10,2), "
                                  "line_amount decimal(15,2), is_returned boolean")
    products = spark.createDataFrame([("p1", "A", "X", Decimal("2.00"), Decimal("5.00")),
                                      ("p2", "B", "Y", Decimal("1.00"), Decimal("5.00")),
                                      ("p3", "C", "Y", Decimal("9.00"), Decimal("5.00"))],
                                     "id string, name string, category string, price decimal(10,2), "
                                     "rating decimal(3,2)")
    pm = {r["id"]: r for r in catalog.product_metrics(items, products).collect()}
    assert (pm["p1"]["orders_count"], pm["p1"]["revenue"], pm["p1"]["refund_rate"]) == (2, 4.0, 0.5)
    assert (pm["p3"]["orders_count"], pm["p3"]["revenue"]) == (0, 0.0)
    cm = [tuple(r) for r in catalog.category_metrics(items, products).collect()]
    assert cm == [("X", 4.0, 2, 2.0, 57.1), ("Y", 3.0, 1, 3.0, 42.9)]


def test_profile_signup_fallback(spark):
    from decimal import Decimal
    cust = spark.createDataFrame([("c1", "A", "B", "a@b", "N", D(2026, 1, 1), "active"),
                                  ("c2", "C", "D", "c@d", "N", D(2026, 5, 1), "active")],
                                 "id string, first_name string, last_name string, email string, country string, "
                                 "signup_date date, status string")
    o = orders_df(spark, [("o1", "c1", D(2026, 5, 21), "completed", Decimal("10.00"))])
    p = {r["customer_id"]: r for r in customer_profile(cust, o, None, "2026-05-31").collect()}
    assert p["c1"]["recency"] == 10 and p["c1"]["frequency"] == 1
    assert p["c2"]["recency"] == 30 and p["c2"]["frequency"] == 0 and float(p["c2"]["monetary"]) == 0.0
    assert p["c2"]["last_purchase_date"] == D(2026, 5, 1) and p["c2"]["name"] == "C D"


def test_rfm_base_floor_timestamp(spark):
    rows = [("o1", "c1", dt.datetime(2026, 5, 30, 10, 0), "completed", 10.0), ("o2", None, dt.datetime(2026, 5, 21), "completed", 10.0),
            ("o3", "c2", dt.datetime(2026, 5, 30, 0, 0), "completed", 10.0)]
    o = spark.createDataFrame(rows, "id string, customer_id string, order_date timestamp_ntz, status string, total_amount double")
    assert {r["customer_id"]: r["recency"] for r in rfm_base(o, "2026-05-31").collect()} == {"c1": 1, "c2": 1}
    floored = rfm_base(o, "2026-05-31", floor_timestamp=True)
    assert {r["customer_id"]: r["recency"] for r in floored.collect()} == {"c1": 0, "c2": 1}


def test_order_lists_and_rows(spark):
    from decimal import Decimal
    from spendlens.operators.profile import order_lists, order_rows
    o = orders_df(spark, [("o2", "c1", D(2026, 5, 2), "completed", Decimal("2.00")),
                          ("o1", "c1", D(2026, 5, 1), "completed", Decimal("1.00")),
                          ("o3", "c2", D(2026, 5, 1), "completed", Decimal("1.00"))])
    items = spark.createDataFrame([("o1",), ("o1",), ("o2",)], "order_id string")
    page = spark.createDataFrame([("c1",), ("c9",)], "customer_id string")
    got = order_lists(o, items, page).collect()
    assert len(got) == 1 and [(e["id"], e["itemsCount"]) for e in got[0]["orders"]] == [("o1", 2), ("o2", 1)]
    rows = sorted((r["customer_id"], r["position"], r["id"], r["items_count"]) for r in order_rows(o, items).collect())
    assert rows == [("c1", 0, "o1", 2), ("c1", 1, "o2", 1), ("c2", 0, "o3", 0)]


def test_orders_by_month_split_a_big_month(spark, tmp_path):
    from spendlens.plans.refresh import read_orders_by_month, write_orders_by_month
    o = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("note"),
                                   F.when(F.col("id") % 10 == 0, F.lit("2026-04-01")).otherwise(F.lit("2026-05-01")).cast("date").alias("order_date"))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        write_orders_by_month(o.repartition(8), str(tmp_path / "m"))
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "m" / "order_month=2026-05-01").glob("*.parquet"))) > 2
    assert read_orders_by_month(spark, str(tmp_path / "m")).count() == 60_000


def test_rfm_scores_unknown_recency_ranks_last(spark):
    from decimal import Decimal
    from spendlens.operators.rfm import rfm_scores
    rows = [(f"c{i}", i * 10, 3, Decimal(100 + i)) for i in range(1, 10)] + [("c0", None, 0, Decimal(0))]
    df = spark.createDataFrame(rows, "customer_id string, recency int, frequency long, monetary decimal(25,2)")
    got = {r["customer_id"]: r["recency_score"] for r in rfm_scores(df, num_partitions=3).collect()}
    assert got["c0"] == 1 and got["c1"] == 5
