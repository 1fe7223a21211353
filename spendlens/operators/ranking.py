"""Distributed global ordering: row numbers, NTILE buckets, running sums, positions within groups.

A window without ``PARTITION BY`` (``ntile(5) OVER (ORDER BY x)``) plans as
``Exchange SinglePartition``: every row of the table goes through one task.
These helpers give the same numbers with the work spread over many tasks:

1. a counting pass (which reads only what the number of rows depends on) sets
   how many ranges there are, so that a range holds at most about ``RANGE_ROWS``
   rows and ``RANGE_BYTES``, whatever ``spark.sql.shuffle.partitions`` says;
2. ``repartitionByRange`` on the full sort key (the caller always appends a
   unique tie-break column, so the order is total and a hot value is split
   across ranges like any other), its bounds from Spark's sample of the keys;
3. ``sortWithinPartitions``;
4. the position inside the partition is the low 33 bits of
   ``monotonically_increasing_id`` (the high bits are the partition index);
5. the frame is cut off its lineage with a reliable ``checkpoint`` into
   ``spark.checkpoint.dir`` – the range bounds come from sampling, so both
   uses below must read one materialisation, and a lost executor re-reads
   the checkpoint instead of re-sampling;
6. one summary row per range comes to the driver, is turned into what the
   ranges before it (or behind it) carry into each, and is broadcast back.

Step 6 is a prefix scan over ranges.  What is carried may also depend on a
segment that runs over a boundary: the tied values at a range's end for sums
with RANGE semantics, the rows of one group for positions within groups.  So
neither needs a join on a value that may be hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spendlens.session import ensure_checkpoint_dir

RANGE_ROWS = 1_000_000          #: rows of a range, about
RANGE_BYTES = 64 * 1024 * 1024  #: bytes of a range, about

_POS_BITS = 33
_PID, _POS = "__pid", "__pos"


def _sort_cols(order: list) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c).asc() for c in order]


def _width(schema: T.StructType) -> int:
    """Bytes of a row, roughly."""
    size = {T.StringType: 32, T.BinaryType: 32, T.DecimalType: 16}
    return 8 + sum(size.get(type(f.dataType), 8 if isinstance(f.dataType, T.AtomicType) else 256) for f in schema.fields)


def range_count(df: DataFrame, num_partitions: int | None = None) -> int:
    """Ranges to cut ``df`` into: ``num_partitions``, or as many as its rows and their width ask for."""
    if num_partitions:
        return int(num_partitions)
    rows = df.count()
    return max(1, math.ceil(rows / RANGE_ROWS), math.ceil(rows * _width(df.schema) / RANGE_BYTES))


def _ranged(df: DataFrame, order: list, num_partitions: int | None) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    cols = _sort_cols(order)
    tagged = (df.repartitionByRange(range_count(df, num_partitions), *cols)
                .sortWithinPartitions(*cols)
                .withColumn("__mid", F.monotonically_increasing_id()))
    return (tagged.withColumn(_PID, F.shiftright("__mid", _POS_BITS).cast("int"))
                  .withColumn(_POS, F.col("__mid").bitwiseAND((1 << _POS_BITS) - 1))
                  .drop("__mid"))


def range_tagged(df: DataFrame, order: list, num_partitions: int | None = None) -> DataFrame:
    """Range-partition and sort ``df`` by ``order``; add partition index and
    in-partition position; checkpoint.  ``order`` must be a total order."""
    return _ranged(df, order, num_partitions).checkpoint(eager=True)


def _offsets(tagged: DataFrame, value: str | None = None) -> DataFrame:
    """Per range partition: rows (and value sums) of all earlier partitions,
    plus the grand totals, as a small local frame for a broadcast join.

    The per-partition counts are collected to the driver: one row per range
    partition, a size fixed by the partition count (not by the data), so the
    prefix sums cost no extra window / broadcast stages."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    if value is not None:
        aggs.append(F.sum(value).alias("__s"))
    per_part = tagged.groupBy(_PID).agg(*aggs)
    sum_type = per_part.schema["__s"].dataType if value is not None else None
    rows = sorted(per_part.collect(), key=lambda r: r[_PID])
    total = sum(r["__n"] for r in rows)
    out, n_before, s_before = [], 0, 0
    for r in rows:
        out.append((r[_PID], n_before, total) + ((s_before,) if value is not None else ()))
        n_before += r["__n"]
        if value is not None and r["__s"] is not None:
            s_before = s_before + r["__s"]
    fields = [T.StructField(_PID, T.IntegerType()), T.StructField("__n_before", T.LongType()),
              T.StructField("__n_total", T.LongType())]
    if value is not None:
        fields.append(T.StructField("__s_before", sum_type))
        out = [o[:3] + (_as_type(o[3], sum_type),) for o in out]
    return F.broadcast(tagged.sparkSession.createDataFrame(out, T.StructType(fields)))


def _as_type(v, typ):
    if isinstance(typ, T.DecimalType):
        import decimal
        return decimal.Decimal(v)
    if isinstance(typ, (T.DoubleType, T.FloatType)):
        return float(v)
    return int(v)


def with_global_row_number(df: DataFrame, order: list, out: str = "row_number",
                           total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (ORDER BY order)`` (1-based, long) without a single
    partition.  ``total`` optionally names a column carrying ``count(*)``."""
    tagged = range_tagged(df, order, num_partitions)
    off = _offsets(tagged)
    res = tagged.join(off, _PID).withColumn(out, F.col("__n_before") + F.col(_POS) + 1)
    if total:
        res = res.withColumn(total, F.col("__n_total"))
    return res.drop(_PID, _POS, "__n_before", "__n_total")


def ntile_expr(rank: Column, total: Column, k: int) -> Column:
    """SQL NTILE bucket of a 1-based row number among ``total`` rows: the
    first ``total % k`` buckets hold one extra row."""
    i = rank - 1
    q = F.floor(total / F.lit(k)).cast("long")
    r = (total % F.lit(k)).cast("long")
    big = r * (q + 1)
    return (F.when(q == 0, rank)
             .when(i < big, F.floor(i / (q + 1)) + 1)
             .otherwise(r + F.floor((i - big) / F.greatest(q, F.lit(1))) + 1)).cast("int")


def with_global_ntile(df: DataFrame, order: list, k: int, out: str,
                      num_partitions: int | None = None) -> DataFrame:
    """``ntile(k) OVER (ORDER BY order)`` computed distributed."""
    ranked = with_global_row_number(df, order, "__rn", "__cnt", num_partitions)
    return ranked.withColumn(out, ntile_expr(F.col("__rn"), F.col("__cnt"), k)).drop("__rn", "__cnt")


def with_global_running_sum(df: DataFrame, order: list, value: str, out: str,
                            num_partitions: int | None = None) -> DataFrame:
    """``sum(value) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING)`` computed
    distributed: in-partition running sums plus the sums of earlier ranges."""
    tagged = range_tagged(df, order, num_partitions)
    off = _offsets(tagged, value)
    w = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (tagged.withColumn("__run", F.sum(value).over(w))
                  .join(off, _PID)
                  .withColumn(out, F.col("__s_before") + F.col("__run"))
                  .drop(_PID, _POS, "__run", "__n_before", "__n_total", "__s_before"))


def with_tied_running_sum(df: DataFrame, value: str, tie_break: str, out: str, rank: str, rows: str, total: str,
                          num_partitions: int | None = None) -> DataFrame:
    """``sum(value) OVER (ORDER BY value DESC RANGE UNBOUNDED PRECEDING)`` as ``out`` (tied values share it: the sum
    of all values at least as large), with the row number ``rank`` (ties by ``tie_break``), the number of ``rows`` and
    the ``total`` of the values, all from one ordered frame.

    Inside a range a window gives the sum with ties; the values tied with a
    range's last one that lie in the ranges behind it are carried back, however
    many ranges they fill.  Null values come last and add nothing."""
    inside = Window.partitionBy(_PID).orderBy(F.col(value).desc())
    tagged = (_ranged(df, [F.col(value).desc(), F.col(tie_break).asc()], num_partitions)
              .withColumn("__run", F.sum(value).over(inside)).checkpoint(eager=True))
    parts = sorted(tagged.groupBy(_PID).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.min_by(value, _POS).alias("first"), F.max_by(value, _POS).alias("last"),
        F.min_by("__run", _POS).alias("head")).collect(), key=lambda r: r[_PID])
    kind = tagged.schema["__run"].dataType
    zero = _as_type(0, kind)
    behind = [zero] * len(parts)  # sum of the values behind a range that tie with its last one
    for i in range(len(parts) - 2, -1, -1):
        then = parts[i + 1]
        if then["first"] == parts[i]["last"] and then["head"] is not None:
            behind[i] = then["head"] + (behind[i + 1] if then["first"] == then["last"] else zero)
    carried, n, s = [], 0, zero
    for p, tied in zip(parts, behind):
        carried.append((p[_PID], n, s, p["last"], tied))
        n, s = n + p["n"], s + (p["s"] if p["s"] is not None else zero)
    schema = T.StructType([T.StructField(_PID, T.IntegerType()), T.StructField("__n", T.LongType()), T.StructField("__s", kind),
                           T.StructField("__last", tagged.schema[value].dataType), T.StructField("__tied", kind)])
    small = F.broadcast(tagged.sparkSession.createDataFrame(carried, schema))  # one row for each range
    tied = F.when(F.col(value) == F.col("__last"), F.col("__tied")).otherwise(F.lit(zero).cast(kind))
    return (tagged.join(small, _PID)
            .withColumn(out, (F.col("__s") + F.coalesce(F.col("__run"), F.lit(zero).cast(kind)) + tied).cast(kind))
            .withColumn(rank, F.col("__n") + F.col(_POS) + 1).withColumn(rows, F.lit(n).cast("long"))
            .withColumn(total, F.lit(s).cast(kind))
            .drop(_PID, _POS, "__run", "__n", "__s", "__last", "__tied"))


def with_group_position(df: DataFrame, group: str, order: list, out: str, num_partitions: int | None = None) -> DataFrame:
    """Position (from 0) of each row within its ``group`` (not null) by ``order`` (total within the group).

    A group of any size is spread over the ranges it fills: positions count
    from its first row in the range, and what it has in the ranges before is
    carried in.  No task holds a group and no join meets its key."""
    inside = Window.partitionBy(_PID, group).orderBy(_POS)
    tagged = (_ranged(df, [F.col(group).asc(), *_sort_cols(order)], num_partitions)
              .withColumn("__at", F.row_number().over(inside).cast("long")).checkpoint(eager=True))
    parts = sorted(tagged.groupBy(_PID).agg(F.min_by(group, _POS).alias("first"), F.max_by(group, _POS).alias("last"),
                                            F.max_by("__at", _POS).alias("tail")).collect(), key=lambda r: r[_PID])
    carried, before, group_before = [], 0, None
    for p in parts:
        before = before if p["first"] == group_before else 0
        carried.append((p[_PID], p["first"], before))
        before, group_before = p["tail"] + (before if p["first"] == p["last"] else 0), p["last"]
    schema = T.StructType([T.StructField(_PID, T.IntegerType()), T.StructField("__first", tagged.schema[group].dataType),
                           T.StructField("__before", T.LongType())])
    small = F.broadcast(tagged.sparkSession.createDataFrame(carried, schema))  # one row for each range
    carry = F.when(F.col(group) == F.col("__first"), F.col("__before")).otherwise(0)
    return (tagged.join(small, _PID).withColumn(out, F.col("__at") - 1 + carry)
            .drop(_PID, _POS, "__at", "__first", "__before"))


def global_rank(df: DataFrame, keys: list, partitions: int | None = None, out: str = "rank") -> DataFrame:
    """Row number over ``keys`` (a total order), computed distributed."""
    return with_global_row_number(df, keys, out, None, partitions)


def global_ntile(df: DataFrame, keys: list, k: int, partitions: int | None = None,
                 out: str = "ntile") -> DataFrame:
    """NTILE(k) over ``keys`` (a total order), computed distributed."""
    return with_global_ntile(df, keys, k, out, partitions)
