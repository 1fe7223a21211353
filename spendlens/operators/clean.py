"""Cleaning: typed dates, status filter, missing amounts, duplicate rows, defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.sources import schemas


def cast_dates(df: DataFrame, columns=("order_date",), fmt: str | None = None) -> DataFrame:
    """Parse date/time text to timestamps; under ANSI mode a malformed value
    raises instead of becoming NULL."""
    out = df
    for c in columns:
        if c in df.columns:
            out = out.withColumn(c, F.to_timestamp(F.col(c), fmt) if fmt else F.to_timestamp(F.col(c)))
    return out


def clean_orders(orders: DataFrame, statuses=("completed",), amount: str = "total_amount") -> DataFrame:
    """Keep orders in ``statuses``, fill a missing (NULL or NaN) amount with
    0, then drop exact duplicate rows (the fill comes first, so a NULL and a
    0 amount count as the same row)."""
    out = orders
    if statuses is not None:
        out = out.filter(F.col("status").isin(list(statuses)))
    typ = dict(out.dtypes)[amount]
    filled = F.coalesce(F.col(amount), F.lit(0).cast(typ))
    if typ in ("double", "float"):
        filled = F.nanvl(filled, F.lit(0.0))
    return out.withColumn(amount, filled).dropDuplicates()


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill missing values with the column defaults of ``table``."""
    out = df
    for col, value in schemas.DEFAULTS.get(table, {}).items():
        if col in df.columns:
            typ = dict(df.dtypes)[col]
            out = out.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(typ)))
    for col in schemas.LOAD_TIMES.get(table, []):
        if col in df.columns:
            out = out.withColumn(col, F.coalesce(F.col(col), F.current_timestamp()))
    return out
