"""Recency / frequency / monetary features, quintile scores and the spend fence."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions import as_date, dbl
from spendlens.operators.ranking import with_global_row_number
from spendlens.operators.selection import order_statistics
from spendlens.session import stored

COMPLETED = ("completed",)


def completed_orders(orders: DataFrame, statuses=COMPLETED) -> DataFrame:
    """Orders whose status is in ``statuses`` (None keeps every order) and
    that carry a customer key (a NULL key would otherwise form its own group)."""
    out = orders.filter(F.col("customer_id").isNotNull())
    if statuses is not None:
        out = out.filter(F.col("status").isin(list(statuses)))
    return out


def rfm_base(orders: DataFrame, snapshot, statuses=COMPLETED, floor_timestamp: bool = False) -> DataFrame:
    """One row per customer: recency (days from the last order to the
    snapshot), frequency (count of order ids) and monetary (sum of totals).

    ``floor_timestamp=True`` measures recency as floored whole days between
    timestamps (order times with a time of day); the default is a date diff.
    Money is summed exactly as decimal.
    """
    last = F.max("order_date")
    recency = F.datediff(as_date(snapshot), last)
    if floor_timestamp:  # a day isn't whole if the order came after midnight; free of time zones
        stamp = last.cast("timestamp_ntz")
        recency = recency - F.when(stamp > stamp.cast("date").cast("timestamp_ntz"), 1).otherwise(0)
    return (completed_orders(orders, statuses)
            .groupBy("customer_id")
            .agg(recency.cast("int").alias("recency"),
                 F.count("id").alias("frequency"),
                 F.sum("total_amount").alias("monetary")))


def _sort_values(rfm: DataFrame) -> list:
    """(measure, unknown, sort value) of the three measures: ascending is best
    first, an unknown value comes last."""
    kinds = dict(rfm.dtypes)
    exact = not any(kinds[m] in ("double", "float") for m in ("recency", "frequency", "monetary"))
    kind = "decimal(38,6)" if exact else "double"
    out = []
    for name, sign in (("recency", 1), ("frequency", -1), ("monetary", -1)):
        v = F.col(name)
        value = F.coalesce((v * F.lit(sign)).cast(kind), F.lit(0).cast(kind))
        out.append((name, v.isNull().cast("int"), value))
    return out


def rfm_scores(rfm: DataFrame, buckets: int = 5, num_partitions: int | None = None) -> DataFrame:
    """Quintile scores (``buckets`` + 1 - NTILE, so ``buckets`` is best) for
    recency (ascending), frequency and monetary (descending), and the
    three-digit ``rfm_code``.  Ties are broken by ascending customer id; a
    missing value ranks last.

    An NTILE is known from the last row of each bucket.  One narrow frame
    (measure, value, id) of all three measures is ranked, distributed; its
    3 * (buckets - 1) cut rows come to the driver, and every customer's
    buckets follow from comparisons with them: the wide rows aren't sorted."""
    measures = _sort_values(rfm)
    narrow = rfm.select("customer_id", F.inline(F.array(*(
        F.struct(F.lit(i).alias("measure"), unknown.alias("unknown"), value.alias("value"))
        for i, (_, unknown, value) in enumerate(measures)))))
    order = [F.col(c).asc() for c in ("measure", "unknown", "value", "customer_id")]
    ranked = with_global_row_number(narrow, order, "__rn", "__n", num_partitions)
    n = F.floor(F.col("__n") / len(measures))
    q, r = F.floor(n / buckets), n % buckets
    ends = F.array(*(F.lit(b) * q + F.least(F.lit(b), r) for b in range(1, buckets)))
    cuts = (ranked.filter(F.array_contains(ends, F.col("__rn") - F.col("measure") * n))
            .select("measure", "unknown", "value", "customer_id").collect())
    out = rfm
    for i, (name, unknown, value) in enumerate(measures):
        bucket = F.lit(1)
        for c in (c for c in cuts if c["measure"] == i):
            after = ((unknown > c["unknown"]) | ((unknown == c["unknown"]) & (
                (value > F.lit(c["value"])) | ((value == F.lit(c["value"])) & (F.col("customer_id") > F.lit(c["customer_id"]))))))
            bucket = bucket + F.when(after, 1).otherwise(0)
        out = out.withColumn(f"{name}_score", (F.lit(buckets + 1) - bucket).cast("int"))
    return out.withColumn("rfm_code", F.concat(*(F.col(f"{name}_score").cast("string") for name, _, _ in measures)))


def monetary_fence(rfm: DataFrame, k: float = 1.5, approx: bool = False, column: str = "monetary") -> DataFrame:
    """Box-plot upper fence of spend: q1, q3 (linear interpolation between
    order statistics), iqr and ``q3 + k * iqr`` in one row (nulls without values).

    The column is stored once; the at most four order statistics come from
    histogram refinement over it (``selection``): no sort, no range shuffle.
    ``approx=True`` uses ``percentile_approx`` instead.
    """
    if approx:
        q = rfm.agg(F.percentile_approx(column, [0.25, 0.75], 100000).alias("q"))
        q = q.select(F.col("q")[0].cast("double").alias("q1"), F.col("q")[1].cast("double").alias("q3"))
    else:
        q1, q3 = quartiles(stored(rfm.select(column), "spend"), column)
        q = rfm.sparkSession.createDataFrame([(q1, q3)], "q1 double, q3 double")
    return _fence(q, k)


def _fence(q: DataFrame, k: float) -> DataFrame:
    return (q.withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("upper_fence", F.col("q3") + F.lit(float(k)) * F.col("iqr")))


def quartiles(values: DataFrame, column: str) -> tuple[float | None, float | None]:
    """First and third quartile of a stored column, interpolated linearly."""
    places = (0.25, 0.75)
    n, found = order_statistics(values, column, lambda n: [
        r for p in places for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))])
    if not n:
        return None, None
    out = []
    for p in places:
        at = (n - 1) * p
        low, high = (float(found[r]) for r in (math.floor(at), math.ceil(at)))
        out.append(low + (high - low) * (at - math.floor(at)))
    return out[0], out[1]


def spend_outliers(rfm: DataFrame, k: float = 1.5, column: str = "monetary") -> DataFrame:
    """``rfm`` with ``is_outlier`` (spend above its upper fence).  ``rfm`` is computed and stored once: the fence and
    the flags both read the stored rows."""
    kept = stored(rfm, "rfm")
    q1, q3 = quartiles(kept, column)
    limit = None if q1 is None else q3 + float(k) * (q3 - q1)
    return kept.withColumn("is_outlier", dbl(column) > F.lit(limit).cast("double"))


def flag_outliers(rfm: DataFrame, fence: DataFrame, column: str = "monetary") -> DataFrame:
    """Add ``is_outlier`` (spend above the given fence).  Rows are never dropped."""
    limit = fence.select("upper_fence").scalar()
    return rfm.withColumn("is_outlier", dbl(column) > limit)
