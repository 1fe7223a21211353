"""Typed readers and the table writer.

Reads never infer a schema: the canonical StructTypes of ``schemas`` are
applied, so a large CSV is not scanned twice and types are stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators.clean import apply_defaults, cast_dates
from spendlens.sources import schemas


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet",
               defaults: bool = True) -> DataFrame:
    """One canonical table (``schemas.TABLES[table]``) from parquet, csv
    (with header) or json lines; missing values get the column defaults."""
    schema = schemas.TABLES[table]
    reader = spark.read.schema(schema)
    if fmt == "parquet":
        df = reader.parquet(path)
    elif fmt == "csv":
        df = reader.option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    elif fmt == "json":
        df = reader.option("mode", "FAILFAST").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return apply_defaults(df, table) if defaults else df


def read_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat order file (order_id, customer_id, order_date, total_amount,
    status) with the date parsed; a malformed date or number fails the read."""
    df = spark.read.schema(schemas.ORDERS_CSV).option("header", True).option("mode", "FAILFAST").csv(path)
    return cast_dates(df, ("order_date",))


def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flat customer file (customer_id, signup_date, country)."""
    df = spark.read.schema(schemas.CUSTOMERS_CSV).option("header", True).option("mode", "FAILFAST").csv(path)
    return cast_dates(df, ("signup_date",))


def read_scoring_input(spark: SparkSession, path: str) -> DataFrame:
    """Batch scoring records (JSON lines with the six numeric inputs); a malformed record fails the read."""
    return spark.read.schema(schemas.SCORING_INPUT).option("mode", "FAILFAST").json(path)


def orders_from_flat(flat: DataFrame, with_time: bool = False) -> DataFrame:
    """Flat order rows -> the canonical order columns used by the operators;
    ``with_time`` keeps the time of day of the order."""
    kind = "timestamp_ntz" if with_time else "date"
    return flat.select(F.col("order_id").alias("id"), "customer_id",
                       F.col("order_date").cast(kind).alias("order_date"), "status",
                       F.col("total_amount").cast("decimal(15,2)").alias("total_amount"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a result table (e.g. ``customer_segments``) as Parquet, optionally
    partitioned (e.g. orders by month) so later reads prune partitions."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
