"""Property tests."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from paths import SF0001
from spendlens.operators import search
from spendlens.operators.ranking import with_global_ntile

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(n=st.integers(min_value=1, max_value=60), k=st.integers(min_value=1, max_value=7),
       parts=st.integers(min_value=1, max_value=5))
def test_ntile_sizes_differ_by_at_most_one(spark, n, k, parts):
    df = spark.range(n).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") % 3).alias("v"))
    got = with_global_ntile(df, [F.col("v").asc(), F.col("customer_id").asc()], k, "b", num_partitions=parts)
    sizes = [r["count"] for r in got.groupBy("b").count().orderBy("b").collect()]
    assert sum(sizes) == n and len(sizes) == min(n, k)
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


@SETTINGS
@given(limit=st.integers(min_value=1, max_value=40))
def test_pages_concatenate_to_filtered_set(spark, limit):
    prof = E.queries()["customer_search"](spark, SF0001)
    total = prof.count()
    pages = (total + limit - 1) // limit
    seen = []
    for p in range(1, pages + 1):
        seen += [r["customer_id"] for r in search.customer_page(prof, p, limit).collect()]
    assert seen == sorted(r["customer_id"] for r in prof.collect())


def test_segment_sizes_sum_to_customers(spark):
    q = E.queries()
    sizes = sum(r["size"] for r in q["segment_summary"](spark, SF0001).collect())
    assert sizes == q["kpi_stats"](spark, SF0001).first()["total_customers"]
    pct = sum(r["percentage"] for r in q["segment_summary"](spark, SF0001).collect())
    assert abs(pct - 100.0) <= 0.35


def test_retention_bounds(spark):
    q = E.queries()
    for r in q["cohort_retention"](spark, SF0001).collect():
        assert 0.0 <= r["retention_rate"] <= 100.0 and r["retained_customers"] <= r["cohort_size"]
    for r in q["cohort_matrix"](spark, SF0001).collect():
        assert all(0.0 <= x <= 100.0 for x in r["retention"]) and len(r["retention"]) == 12


def test_scores_cover_all_buckets(spark):
    rows = E.queries()["rfm_scores"](spark, SF0001).collect()
    for col in ("recency_score", "frequency_score", "monetary_score"):
        counts = {}
        for r in rows:
            counts[r[col]] = counts.get(r[col], 0) + 1
        assert set(counts) == {1, 2, 3, 4, 5} and max(counts.values()) - min(counts.values()) <= 1
