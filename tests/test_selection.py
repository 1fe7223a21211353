import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendlens.operators import rfm, selection


@pytest.mark.parametrize("bins,listed", [(1024, 4096), (2, 1), (3, 5), (16, 0)])
@pytest.mark.parametrize("kind", ["decimal(20,2)", "double", "long"])
def test_every_rank_equals_a_sort(spark, monkeypatch, bins, listed, kind):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "LISTED", listed)
    rnd = random.Random(bins)
    pool = [7, 7, 7, 7, 0, -3] + [rnd.randrange(-10 ** 9, 10 ** 9) for _ in range(5)] + list(range(40))
    rows = [None if rnd.random() < .1 else rnd.choice(pool) for _ in range(300)]
    make = {"decimal(20,2)": lambda v: Decimal(v) / 4, "double": lambda v: v / 4, "long": lambda v: v}[kind]
    rows = [None if v is None else make(v) for v in rows]
    df = spark.createDataFrame([(v,) for v in rows], f"v {kind}")
    expected = sorted(v for v in rows if v is not None)
    ranks = [-1, 0, 1, 50, 100, 133, 134, 200, len(expected) - 1, len(expected)]
    n, found = selection.order_statistics(df, "v", lambda n: ranks)
    assert n == len(expected) and found == {r: expected[r] for r in ranks if 0 <= r < n}


def test_ends_ties_and_no_values(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert selection.order_statistics(empty, "v", lambda n: [0]) == (0, {})
    same = spark.range(50_000).select(F.lit(2.5).alias("v"))
    assert selection.order_statistics(same, "v", lambda n: [0, n // 2, n - 1]) == (50_000, {0: 2.5, 25_000: 2.5, 49_999: 2.5})
    close = spark.createDataFrame([(1.0,), (1.0000000000000002,), (1.0000000000000004,)] * 2000, "v double")
    assert selection.order_statistics(close, "v", lambda n: [1999, 2000, 5999])[1] == {
        1999: 1.0, 2000: 1.0000000000000002, 5999: 1.0000000000000004}


def test_fence_and_outliers_need_no_sort(spark):
    rnd = random.Random(4)
    rows = [(f"c{i}", Decimal(rnd.randrange(100, 90_000)) / 100) for i in range(5000)] + [("big", Decimal(10_000))]
    df = spark.createDataFrame(rows, "customer_id string, monetary decimal(15,2)")
    fence = rfm.monetary_fence(df).first()
    exact = df.select(F.percentile("monetary", 0.25), F.percentile("monetary", 0.75)).first()
    assert (fence.q1, fence.q3) == pytest.approx(tuple(exact), abs=1e-9)
    flagged = rfm.spend_outliers(df)
    assert [r.customer_id for r in flagged.filter("is_outlier").collect()] == ["big"]
    plan = flagged._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # orders are aggregated once, into the stored rows
    assert rfm.monetary_fence(df.limit(0)).first().upper_fence is None
    assert rfm.spend_outliers(df.limit(0)).count() == 0
