import tempfile

import pytest

from spendlens.sources import readers


def _write(text, name):
    d = tempfile.mkdtemp(prefix="spendlens-read-")
    with open(f"{d}/{name}", "w") as fh:
        fh.write(text)
    return f"{d}/{name}"


def test_read_table_csv_applies_defaults(spark):
    path = _write("id,customer_id,order_date,status,total_amount,shipping_cost,discount_amount,payment_method,"
                  "created_at\n"
                  "o1,c1,2026-05-01,,12.50,,,card,\n", "orders.csv")
    r = readers.read_table(spark, path, "orders", "csv").first()
    assert r["status"] == "completed" and float(r["shipping_cost"]) == 0.0 and float(r["total_amount"]) == 12.5


def test_orders_csv_malformed_date_fails(spark):
    good = _write("order_id,customer_id,order_date,total_amount,status\nA,c1,2026-05-01,1.0,completed\n", "o.csv")
    assert readers.read_orders_csv(spark, good).first()["order_date"].year == 2026
    bad = _write("order_id,customer_id,order_date,total_amount,status\nA,c1,not-a-date,1.0,completed\n", "o.csv")
    with pytest.raises(Exception):
        readers.read_orders_csv(spark, bad).collect()


def test_scoring_input_json(spark):
    from spendlens.operators import scoring
    path = _write('{"customer_id": "a", "recency": 40, "frequency": 4, "avg_order_value": 120, '
                  '"support_tickets": 1, "discount_usage": 25, "satisfaction": 4}\n', "s.json")
    df = scoring.churn_logistic_score(readers.read_scoring_input(spark, path))
    assert df.first()["churn_probability"] == 38


def test_write_table_partitioned(spark):
    import datetime as dt
    df = spark.createDataFrame([("o1", dt.date(2026, 1, 3), "2026-01"), ("o2", dt.date(2026, 2, 3), "2026-02")],
                               "id string, order_date date, order_month string")
    out = tempfile.mkdtemp(prefix="spendlens-write-") + "/orders"
    readers.write_table(df, out, partition_by=["order_month"])
    back = spark.read.parquet(out).filter("order_month = '2026-02'")
    assert [r["id"] for r in back.collect()] == ["o2"]


def test_malformed_numbers_fail_the_read(spark, tmp_path):
    import pytest
    from spendlens.sources import readers
    (tmp_path / "o.csv").write_text("order_id,customer_id,order_date,total_amount,status\na,c,2026-01-01,12x,completed\n")
    with pytest.raises(Exception):
        readers.read_orders_csv(spark, str(tmp_path / "o.csv")).collect()
    (tmp_path / "s.json").write_text('{"customer_id": "a", "recency": "x"}\n')
    with pytest.raises(Exception):
        readers.read_scoring_input(spark, str(tmp_path / "s.json")).collect()


def test_load_times_are_filled(spark):
    from spendlens.operators.clean import apply_defaults
    df = spark.createDataFrame([("a", None)], "id string, created_at timestamp")
    assert apply_defaults(df, "orders").first()["created_at"] is not None
