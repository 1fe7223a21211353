"""Exact order statistics without a sort: histograms refined around the wanted ranks.

A pass counts the values in equal-width bins, with each bin's least and largest
value; the bins that hold a wanted rank are cut into bins again, until one is a
single value or holds few enough rows to list its values with their counts.
What comes to the driver is bounded by the bins and the wanted ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024     #: of each interval that is refined
LISTED = 4096   #: an interval of at most so many rows is listed value by value


def _bin(v: Column, low: float, high: float) -> Column:
    """Bin of a value of [low, high]; doubles only place values, and never against their order."""
    width = (high - low) / BINS
    place = F.floor((v.cast("double") - F.lit(low)) / F.lit(width)) if width > 0 else F.lit(0)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int")


def order_statistics(df: DataFrame, column: str, ranks) -> tuple[int, dict[int, object]]:
    """(number of values, value by rank) of the non-null, finite values of a numeric column; ``ranks`` (from 0) is a
    function of the number.  Ranks outside give no entry.

    Each pass reads ``column`` of ``df`` once with a partial aggregation, so
    ``df`` should be a stored table.  A value that holds most rows is one bin,
    found as soon as a bin's least and largest value are equal.
    """
    values = df.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    whole = values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    n = whole["n"]
    wanted = sorted({r for r in ranks(n) if 0 <= r < n})
    found: dict[int, object] = {}
    open_ = [(0, n, whole["low"], whole["high"])] if wanted else []  # (rank of the first row, rows, least, largest value)
    while open_:
        parts: list[tuple[int, int, object, object]] = []
        listed, binned = [], []
        for i, (first, rows, low, high) in enumerate(open_):
            inside = F.col("v").between(F.lit(low), F.lit(high))
            if low == high:
                parts.append((first, rows, low, high))
            elif rows <= LISTED or float(high) - float(low) <= 0 or (float(high) - float(low)) / BINS == 0:
                listed.append((i, inside))
            else:
                binned.append((i, inside, low, high))
        for group in ((listed, None), (binned, True)):
            if not group[0]:
                continue
            interval = place = None
            for i, inside, *ends in group[0]:
                key = F.col("v") if group[1] is None else _bin(F.col("v"), float(ends[0]), float(ends[1]))
                interval = F.when(inside, i) if interval is None else interval.when(inside, i)
                place = F.when(inside, key) if place is None else place.when(inside, key)
            counted = (values.select("v", interval.alias("i"), place.alias("p")).filter("i IS NOT NULL").groupBy("i", "p")
                       .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
            before = {i: open_[i][0] for i, *_ in group[0]}
            for r in sorted(counted, key=lambda r: (r["i"], r["p"])):
                parts.append((before[r["i"]], r["n"], r["low"], r["high"]))
                before[r["i"]] += r["n"]
        open_ = []
        for first, rows, low, high in parts:
            own = [r for r in wanted if first <= r < first + rows]
            if own and low == high:
                found.update((r, low) for r in own)
            elif own:
                open_.append((first, rows, low, high))
    return n, found
