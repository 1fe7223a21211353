import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlens.operators.ranking import with_global_ntile, with_global_row_number, with_global_running_sum


def frame(spark, n, distinct, seed=7):
    rnd = random.Random(seed)
    rows = [(f"c{i:05d}", rnd.randrange(distinct), float(rnd.randrange(1000))) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id string, k int, v double")


@pytest.mark.parametrize("n,distinct,parts", [(1, 1, 4), (3, 2, 4), (7, 3, 3), (1000, 4, 6), (997, 500, 5)])
def test_distributed_ntile_equals_window(spark, n, distinct, parts):
    df = frame(spark, n, distinct)
    order = [F.col("k").desc(), F.col("customer_id").asc()]
    mine = with_global_ntile(df, order, 5, "b", num_partitions=parts).select("customer_id", "b")
    ref = df.select("customer_id", F.ntile(5).over(Window.orderBy(*order)).alias("b"))
    assert sorted(mine.collect()) == sorted(ref.collect())


def test_ntile_sizes(spark):
    df = frame(spark, 7, 7)
    got = with_global_ntile(df, [F.col("customer_id").asc()], 5, "b", num_partitions=3)
    sizes = [r["count"] for r in got.groupBy("b").count().orderBy("b").collect()]
    assert sizes == [2, 2, 1, 1, 1]


def test_row_number_hot_key_spread_over_partitions(spark):
    # a third of all rows share one key value: the tie-break splits them
    rows = [(f"c{i:05d}", 0 if i % 3 == 0 else i, 1.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "customer_id string, k int, v double")
    order = [F.col("k").asc(), F.col("customer_id").asc()]
    got = with_global_row_number(df, order, "rn", "n", num_partitions=6)
    ref = df.select("customer_id", F.row_number().over(Window.orderBy(*order)).alias("rn"))
    assert sorted(got.select("customer_id", "rn").collect()) == sorted(ref.collect())
    assert {r["n"] for r in got.select("n").distinct().collect()} == {3000}


def test_running_sum_equals_window(spark):
    df = frame(spark, 500, 1000).dropDuplicates(["v"])
    got = with_global_running_sum(df, [F.col("v").desc()], "v", "run", num_partitions=4)
    ref = df.select("customer_id", F.sum("v").over(
        Window.orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    assert sorted(got.select("customer_id", "run").collect()) == sorted(ref.collect())


def test_no_single_partition_exchange(spark):
    df = frame(spark, 100, 10)
    got = with_global_row_number(df, [F.col("k").asc(), F.col("customer_id").asc()], "rn")
    plan = got._jdf.queryExecution().executedPlan().toString()
    # offsets arrive as a small local frame: no single-partition step at all
    assert "SinglePartition" not in plan


def test_empty_input(spark):
    df = frame(spark, 5, 3).filter("false")
    assert with_global_ntile(df, [F.col("k").asc(), F.col("customer_id").asc()], 5, "b").count() == 0
    assert with_global_running_sum(df, [F.col("v").asc()], "v", "run").count() == 0


def test_hot_key_partitions_stay_balanced(spark):
    # a third of all rows carry the same key value; the customer-id tie-break
    # lets the range partitioner split that value across partitions
    from spendlens.operators.ranking import _PID, range_tagged
    rows = [(f"c{i:06d}", 7 if i % 3 == 0 else i % 500, 1.0) for i in range(30000)]
    df = spark.createDataFrame(rows, "customer_id string, k int, v double")
    tagged = range_tagged(df, [F.col("k").asc(), F.col("customer_id").asc()], num_partitions=10)
    sizes = [r["count"] for r in tagged.groupBy(_PID).count().collect()]
    assert sum(sizes) == 30000 and len(sizes) >= 8
    assert max(sizes) <= 2 * (30000 / len(sizes))



def test_ranges_follow_rows_not_shuffle_partitions(spark, monkeypatch):
    """10^6 rows under spark.sql.shuffle.partitions = 4: ranges of bounded size, a third of the rows on one value."""
    from spendlens.operators import ranking
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50_000)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("customer_id"))
    order = [F.col("k").asc(), F.col("customer_id").asc()]
    sizes = [r["count"] for r in ranking.range_tagged(df, order).groupBy(ranking._PID).count().collect()]
    assert sum(sizes) == n and len(sizes) >= 18 and max(sizes) <= 100_000
    got = with_global_row_number(df, order, "rn", "n")
    ref = df.withColumn("ref", F.row_number().over(Window.orderBy(*order)))
    wrong = got.join(ref, "customer_id").filter((F.col("rn") != F.col("ref")) | (F.col("n") != n))
    assert got.count() == n and wrong.count() == 0
    assert ranking.range_count(df) == 20 and ranking.range_count(df, 3) == 3 and ranking.range_count(df.limit(0)) == 1
    monkeypatch.setattr(ranking, "RANGE_BYTES", 1 << 20)
    assert ranking.range_count(df) == 23  # 24 bytes a row


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4), (3, 9), (4, 40)])
def test_tied_running_sum_equals_range_window(spark, seed, parts):
    """90 % of the values tie, over several ranges; nulls; decimals."""
    from decimal import Decimal
    from spendlens.operators.ranking import with_tied_running_sum
    rnd = random.Random(seed)
    rows = [(f"c{i:05d}", None if rnd.random() < .02 else Decimal("50.25") if rnd.random() < .9 else Decimal(rnd.randrange(10000)) / 100)
            for i in range(700)]
    df = spark.createDataFrame(rows, "customer_id string, v decimal(12,2)")
    got = with_tied_running_sum(df, "v", "customer_id", "run", "rank", "n", "total", num_partitions=parts)
    w = Window.orderBy(F.col("v").desc())
    ref = df.select("customer_id", "v", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("run"),
                    F.row_number().over(Window.orderBy(F.col("v").desc(), "customer_id")).cast("long").alias("rank"))
    assert sorted(map(str, got.select("customer_id", "v", F.col("run").cast("double"), "rank").collect())) == sorted(
        map(str, ref.select("customer_id", "v", F.col("run").cast("double"), "rank").collect()))
    assert {(r.n, r.total) for r in got.select("n", "total").distinct().collect()} == {(700, sum(v for _, v in rows if v is not None))}
    assert with_tied_running_sum(df.limit(0), "v", "customer_id", "run", "rank", "n", "total").count() == 0


def test_pareto_has_no_join_on_spend(spark):
    from decimal import Decimal
    from spendlens.operators.pareto import pareto_customers
    rows = [(str(i), f"c{i % 400}", "completed", Decimal(5 if i % 400 < 360 else i)) for i in range(800)]
    orders = spark.createDataFrame(rows, "id string, customer_id string, status string, total_amount decimal(15,2)")
    got = pareto_customers(orders, num_partitions=7)
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "SinglePartition" not in plan
    tied = got.filter("total_spend = 10.0").select("running_spend", "cumulative_revenue").distinct().collect()
    assert len(tied) == 1 and tied[0].running_spend == tied[0].cumulative_revenue


@pytest.mark.parametrize("parts", [1, 3, 25])
def test_group_positions_equal_window_with_one_hot_group(spark, parts):
    """80 % of the rows are one group's: it fills many ranges, and its positions go on over them."""
    from spendlens.operators import ranking
    rnd = random.Random(parts)
    rows = [("hot" if rnd.random() < .8 else rnd.choice(["a", "b", "zz", "hos", "hou"]), rnd.randrange(30), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, id long")
    got = ranking.with_group_position(df, "g", ["k", "id"], "position", num_partitions=parts)
    ref = df.select("g", "k", "id", (F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1).cast("long").alias("position"))
    assert sorted(map(tuple, got.select("g", "k", "id", "position").collect())) == sorted(map(tuple, ref.collect()))
    tagged = ranking.range_tagged(df, [F.col("g").asc(), F.col("k").asc(), F.col("id").asc()], parts)
    assert tagged.filter("g = 'hot'").select(ranking._PID).distinct().count() >= 0.7 * parts
    assert ranking.with_group_position(df.limit(0), "g", ["k", "id"], "position").count() == 0


def test_order_rows_have_no_join_on_the_customer(spark):
    from spendlens.operators.profile import order_rows
    rows = [(str(i), "hot" if i % 5 else f"c{i}", "completed", None, i % 7) for i in range(400)]
    orders = (spark.createDataFrame(rows, "id string, customer_id string, status string, total_amount decimal(15,2), d int")
              .withColumn("order_date", F.date_add(F.lit("2024-01-01"), F.col("d"))))
    got = order_rows(orders, num_partitions=6)
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    assert sorted(r.position for r in got.filter("customer_id = 'hot'").collect()) == list(range(320))
