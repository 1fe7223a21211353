import re

from pyspark.sql import functions as F

from paths import SF0001
from spendlens.operators import profile, quality
from spendlens.plans import registry
from spendlens.sources import schemas
from spendlens.sources.testdata import load_tables


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scans(df, table):
    return len(re.findall(rf"Location: [^\n]*/{table}\.parquet", formatted(df)))


def test_profile_reads_orders_and_lines_once(spark):
    t = load_tables(spark, SF0001)
    p = registry._profile(t)
    assert (scans(p, "orders"), scans(p, "lineitem"), scans(p, "events")) == (1, 1, 1)
    lean = p.select("customer_id", "recency", "frequency", "monetary")
    assert (scans(lean, "orders"), scans(lean, "lineitem"), scans(lean, "events")) == (1, 0, 0)
    assert scans(registry.QUERIES["churn_watchlist"](spark, SF0001), "orders") == 2


def test_one_pass_profile_equals_the_separate_frames(spark):
    t = load_tables(spark, SF0001)
    apart = profile.customer_profile(t.customers, t.orders, t.feature_frames, t.snapshot).join(
        profile.order_activity(t.orders, t.order_items), "customer_id", "left").fillna(0, ["orders_listed", "items_listed"])
    once = registry._profile(t).select(apart.columns)
    assert once.exceptAll(apart).count() == 0 and apart.exceptAll(once).count() == 0


def test_facts_without_lines_or_statuses(spark):
    rows = [("1", "a", "completed", 2.0, "2024-01-01"), ("2", "a", "shipped", 3.0, "2024-02-01"), ("3", None, "completed", 9.0, "2024-01-01")]
    orders = (spark.createDataFrame(rows, "id string, customer_id string, status string, total_amount double, d string")
              .withColumn("order_date", F.col("d").cast("date")))
    done = profile.customer_facts(orders).collect()
    assert [(r.customer_id, r.frequency, r.monetary, str(r.last_order_date), str(r.last_date)) for r in done] == [
        ("a", 1, 2.0, "2024-01-01", "2024-02-01")]
    assert [(r.frequency, r.monetary) for r in profile.customer_facts(orders, statuses=None).collect()] == [(2, 5.0)]
    assert profile.customer_facts(orders.limit(0)).count() == 0


def test_foreign_keys_need_one_shuffle_for_each_parent(spark):
    made = {}
    for child, ccol, parent, pcol in schemas.FOREIGN_KEYS:
        made.setdefault(parent, {})[pcol] = ["p1", "p2", "p2", None]
        made.setdefault(child, {})[ccol] = ["p1", "gone", None, "gone"]
    tables = {t: spark.createDataFrame(list(zip(*c.values())), ", ".join(f"{name} string" for name in c)) for t, c in made.items()}
    report = quality.check_foreign_keys(tables)
    assert {(r.table_name, r.column_name): (r.checked_rows, r.violations) for r in report.collect()} == {
        (child, f"{ccol}->{parent}.{pcol}"): (3, 2) for child, ccol, parent, pcol in schemas.FOREIGN_KEYS}
    parents = len({p for _, _, p, _ in schemas.FOREIGN_KEYS})
    plan = quality.check_foreign_keys(tables)._jdf.queryExecution().executedPlan().toString()  # not run yet: one plan
    assert plan.count("hashpartitioning") == parents and "Join" not in plan


def test_checks_are_metrics_of_the_write(spark):
    rows = [("c1", 3, None, 9), ("c2", None, 1, 2), ("c2", -4, 2, 5)]
    df = spark.createDataFrame(rows, "customer_id string, recency_days int, recency_score int, frequency_score int")
    checked = quality.write_checked("customer_segments", df, "checked")
    for check in (quality.check_not_null, quality.check_ranges, quality.check_lengths, quality.check_domains, quality.check_unique):
        a, b = (sorted(map(tuple, check({"customer_segments": x}).collect())) for x in (checked, df))
        assert a == b
    assert checked.frame.count() == 3
    plan = formatted(quality.check_not_null({"customer_segments": checked}))
    assert "parquet" not in plan  # the stored table isn't read for it
    empty = quality.write_checked("customer_segments", df.filter("recency_days > 100"), "checked")
    assert all(r.checked_rows == 0 and r.violations == 0 for r in empty.report.collect()) and empty.frame.count() == 0
