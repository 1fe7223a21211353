"""Column-level numeric helpers.

Three rounding rules meet in this domain (all written as plain double
arithmetic so that any SQL engine doing the same IEEE operations agrees):

* ``js_round``   – ``floor(x * 10^d + 0.5) / 10^d`` (half up toward +inf),
                   the rule of the dashboard figures;
* ``half_even``  – ``rint(x * 10^d) / 10^d`` (banker's rounding on the scaled
                   double), the rule of the modelling notebook;
* ``bracket``    – clamp into ``[lo, hi]``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """Name -> column, Column -> itself, anything else -> literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def as_date(x) -> Column:
    """A snapshot given as 'YYYY-MM-DD', date, datetime or Column -> date column."""
    if isinstance(x, Column):
        return x.cast("date")
    if isinstance(x, _dt.datetime):
        return F.lit(x.date())
    if isinstance(x, _dt.date):
        return F.lit(x)
    return F.to_date(F.lit(str(x)))


def dbl(c) -> Column:
    return as_col(c).cast("double")


def js_round(c, digits: int = 0) -> Column:
    scale = float(10 ** digits)
    if digits == 0:
        return F.floor(dbl(c) + F.lit(0.5)).cast("double")
    return F.floor(dbl(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def half_even(c, digits: int = 0) -> Column:
    scale = float(10 ** digits)
    if digits == 0:
        return F.rint(dbl(c))
    return F.rint(dbl(c) * F.lit(scale)) / F.lit(scale)


def clamp(c, lo, hi) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(lo)), F.lit(hi))


def safe_ratio(num, den) -> Column:
    """num / max(1, den) as double (the zero-guard used for averages)."""
    return dbl(num) / F.greatest(dbl(den), F.lit(1.0))


def month_start(c) -> Column:
    return F.trunc(as_col(c).cast("date"), "month")


def month_diff(later, earlier) -> Column:
    """Calendar-month difference (year*12 + month), ignoring the day."""
    a, b = as_col(later), as_col(earlier)
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("int")


def pct_tenths(part, whole) -> Column:
    """round(part / whole * 1000) / 10 – a percentage with one decimal,
    0 when ``whole`` is 0 (no ANSI division error)."""
    ratio = dbl(part) / F.nullif(dbl(whole), F.lit(0.0))
    return F.coalesce(F.floor(ratio * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0), F.lit(0.0))


def js_number_text(c) -> Column:
    """Text of a number the way a JavaScript template literal prints it for
    values already rounded to at most 4 decimals: no exponent, no trailing
    zeros, no trailing dot ("12", "0.5", "1234567.25")."""
    txt = dbl(c).cast("decimal(38,4)").cast("string")
    txt = F.regexp_replace(txt, r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(txt, r"\.$", "")
