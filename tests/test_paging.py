import random

import pytest
from pyspark.sql import functions as F

from paths import SF0001
from spendlens.operators import search


def profile(spark, n=700, seed=3):
    rnd = random.Random(seed)
    alphabet = "abé日\U0001F600-0"
    keys = {"".join(rnd.choices(alphabet, k=rnd.randint(1, 6))) for _ in range(n)} | {f"same-prefix-{i:05d}" for i in range(n)}
    rows = [(k, f"n{k}", "e", rnd.choice(["gold", "new"]), rnd.choice(["DE", "FR", "US"])) for k in keys]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "customer_id string, name string, email string, segment string, country string"), rows


def expected(rows, segment, country, page, limit):
    keys = sorted((r[0] for r in rows if segment in ("All", r[3]) and country in ("All", r[4])), key=str.encode)
    return keys[(page - 1) * limit:page * limit]


def ids(df):
    return [r["customer_id"] for r in df.collect()]


@pytest.mark.parametrize("top", [10_000, 40, 1])
def test_near_and_far_pages(spark, monkeypatch, top):
    monkeypatch.setattr(search, "TOP_ROWS", top)
    df, rows = profile(spark)
    df = df.repartition(5).cache()
    for page, limit in [(1, 10), (2, 7), (9, 30), (60, 11), (len(rows), 1), (400, 10), (1, 5000)]:
        assert ids(search.customer_page(df, page, limit)) == expected(rows, "All", "All", page, limit)
    numbers = spark.range(0, 3000, 3).withColumnRenamed("id", "customer_id")
    assert ids(search.customer_page(numbers, 90, 10)) == list(range(2670, 2700, 3))
    assert ids(search.customer_page(numbers, 900, 10)) == [] and ids(search.customer_page(df.limit(0), 900, 10)) == []


@pytest.mark.parametrize("block,parts", [(100_000, None), (50, 4), (7, 9)])
def test_pages_of_the_index(spark, monkeypatch, tmp_path, block, parts):
    monkeypatch.setattr(search, "BLOCK_ROWS", block)
    df, rows = profile(spark, 300)
    search.paged_profile(df, num_partitions=parts).write.parquet(str(tmp_path / "p"))
    paged = spark.read.parquet(str(tmp_path / "p"))
    index = search.page_index(paged).cache()
    assert index.agg(F.sum("rows")).first()[0] == len(rows)
    for segment, country, page, limit in [("All", "All", 3, 20), ("gold", "All", 5, 9), ("new", "FR", 1, 10), ("new", "FR", 8, 10),
                                          ("All", "US", 2, 100), ("All", "", 1, 9999), ("gold", "XX", 1, 10), ("gold", "DE", 999, 10)]:
        got = search.customer_page_indexed(paged, index, segment, country, page, limit)
        assert got.columns == df.columns
        assert ids(got) == expected(rows, segment, country or "All", page, limit)


def test_a_page_reads_a_key_range_and_ranks_nothing(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(search, "BLOCK_ROWS", 100)
    df, _ = profile(spark)
    search.paged_profile(df).write.parquet(str(tmp_path / "p"))
    paged = spark.read.parquet(str(tmp_path / "p"))
    got = search.customer_page_indexed(paged, search.page_index(paged), "gold", "DE", 20, 5)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(customer_id" in plan and "LessThanOrEqual(customer_id" in plan
    assert "Window" not in plan and "Exchange" not in plan
    near = search.customer_page(df, 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in near and "rangepartitioning" not in near


def test_refreshed_tables_serve_pages(spark, tmp_path):
    from spendlens.plans import refresh, registry
    from spendlens.sources.testdata import load_tables
    t = load_tables(spark, SF0001)
    folder = refresh.refresh_tables(t, str(tmp_path / "tables"))
    got = refresh.customer_page(t, folder, registry.PAGE_SEGMENT, registry.PAGE_COUNTRY, 1, 10)
    direct = search.customer_page(registry._found(t), 1, 10)
    assert sorted(map(str, got.select(direct.columns).collect())) == sorted(map(str, direct.collect()))
