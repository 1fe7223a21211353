"""Data-quality checks derived from the relational constraints.

Each check returns a violation frame ``(rule, table_name, column_name,
checked_rows, violations)`` with one row per constrained column (zero
violations included), so the frames union into one report.  Every table is
scanned once per check with all its columns folded into a single aggregate; a
table that is being written is checked by that write (``write_checked``).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spendlens.session import stored
from spendlens.sources import schemas

REPORT_COLS = ["rule", "table_name", "column_name", "checked_rows", "violations"]


#: A column of this prefix holds a column's value as it was read, before the cast to its type.
RAW = "raw_"


def _raw(df: DataFrame, c: str) -> Column:
    return F.col(RAW + c) if RAW + c in df.columns else F.col(c)


def _row_tests(t: str, df: DataFrame) -> list[tuple[str, str, Column]]:
    """(rule, column, failing-row test) of every per-row check on one table."""
    if t not in schemas.TABLES:
        return []
    tests = [("not_null", c, _raw(df, c).isNull()) for c in schemas.not_null_columns(t) if c in df.columns]
    tests += [("domain", c, F.col(c).isNotNull() & ~F.col(c).isin(vals))
              for (tt, c), vals in schemas.ENUMS.items() if tt == t and c in df.columns]
    for (tt, c), (lo, hi) in schemas.RANGES.items():
        if tt == t and c in df.columns:
            cond = F.lit(False)
            if lo is not None:
                cond = cond | (F.col(c) < lo)
            if hi is not None:
                cond = cond | (F.col(c) > hi)
            tests.append(("range", c, F.coalesce(cond, F.lit(False))))
    tests += [("range", f"{c}:decimal({p},{sc})",
               _raw(df, c).isNotNull() & _raw(df, c).try_cast(f"decimal({p},{sc})").isNull())
              for (tt, c), (p, sc) in schemas.PRECISION.items() if tt == t and c in df.columns]
    tests += [("length", c, F.coalesce(F.char_length(c) > n, F.lit(False)))
              for (tt, c), n in schemas.MAX_LENGTHS.items() if tt == t and c in df.columns]
    return tests


class Checked(NamedTuple):
    """A stored table with the report of its per-row checks, gathered while it was written."""

    frame: DataFrame
    report: DataFrame


Table = DataFrame | Checked


def _frame(table: Table) -> DataFrame:
    return table.frame if isinstance(table, Checked) else table


def write_checked(t: str, df: DataFrame, name: str) -> Checked:
    """Store ``df`` (table ``t``) and run its per-row checks as metrics of that very write: the stored table isn't
    read to be checked, nor computed twice."""
    tests = _row_tests(t, df)
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("n"), *(F.count_if(cond).alias(f"v{i}") for i, (_, _, cond) in enumerate(tests))]
    frame = stored(df.observe(seen, *metrics), name)
    counts = seen.get
    rows = [(rule, t, c, counts["n"], counts[f"v{i}"]) for i, (rule, c, _) in enumerate(tests)]
    return Checked(frame, df.sparkSession.createDataFrame(rows, REPORT_SCHEMA))


def _row_report(t: str, df: Table, rules: set[str]) -> DataFrame | None:
    """One pass over ``df``: count of rows and of rows failing each test of ``rules``."""
    if isinstance(df, Checked):
        return df.report.filter(F.col("rule").isin(sorted(rules)))
    tests = [test for test in _row_tests(t, df) if test[0] in rules]
    if not tests:
        return None
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count_if(cond).alias(f"__v{i}") for i, (_, _, cond) in enumerate(tests)])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column_name"),
                 F.col(f"__v{i}").cast("long").alias("violations"))
        for i, (rule, c, _) in enumerate(tests)]))
    return (row.select(F.col("__n").cast("long").alias("checked_rows"), stacked.alias("s"))
            .select("s.rule", F.lit(t).alias("table_name"), "s.column_name", "checked_rows", "s.violations"))


REPORT_SCHEMA = "rule string, table_name string, column_name string, checked_rows long, violations long"


def _union(frames, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    frames = [f.select(*REPORT_COLS) for f in frames if f is not None]
    if not frames:  # nothing to check: an empty report
        spark = _frame(next(iter(tables.values()))).sparkSession
        return spark.createDataFrame([], REPORT_SCHEMA)
    return reduce(lambda a, b: a.unionByName(b), frames)


def check_not_null(tables: dict[str, Table]) -> DataFrame:
    """NOT NULL columns that hold NULLs (as read, where the frame has the raw column)."""
    return _union([_row_report(t, df, {"not_null"}) for t, df in tables.items()], tables)


def check_unique(tables: dict[str, Table]) -> DataFrame:
    """Primary-key / UNIQUE columns: violations = rows beyond the first of
    each repeated non-NULL key (partial aggregation per key, so a hot key
    costs one row per map task)."""
    frames = []
    for t, df in ((t, _frame(table)) for t, table in tables.items()):
        for c in schemas.UNIQUE_KEYS.get(t, []):
            if c not in df.columns:
                continue
            per = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("k"))
            frames.append(per.agg(F.sum("k").alias("n"), F.sum(F.col("k") - 1).alias("v")).select(
                F.lit("unique").alias("rule"), F.lit(t).alias("table_name"), F.lit(c).alias("column_name"),
                F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("checked_rows"),
                F.coalesce(F.col("v"), F.lit(0)).cast("long").alias("violations")))
    return _union(frames, tables)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """The repeated keys themselves with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def check_foreign_keys(tables: dict[str, Table]) -> DataFrame:
    """Child rows whose non-NULL key has no parent (checked_rows = child rows
    with a key).

    The keys of a parent and of all its children go into one tagged union,
    folded by key: one shuffle for each parent, whatever the number of its
    children, without a distinct or a join.  Partial aggregation sends a key
    once from each map task, however hot it is."""
    frames = []
    for parent, pcol in dict.fromkeys((p, c) for _, _, p, c in schemas.FOREIGN_KEYS):
        children = [(child, ccol) for child, ccol, *key in schemas.FOREIGN_KEYS if key == [parent, pcol] and child in tables]
        if parent not in tables or not children:
            continue
        counts = lambda own: [F.lit(int(i == own)).cast("long").alias(f"__c{i}") for i in range(len(children))]
        keys = [_frame(tables[parent]).select(F.col(pcol).alias("__k"), F.lit(True).alias("__hit"), *counts(None))]
        keys += [_frame(tables[child]).select(F.col(ccol).alias("__k"), F.lit(False).alias("__hit"), *counts(i))
                 for i, (child, ccol) in enumerate(children)]
        folded = (reduce(lambda a, b: a.unionByName(b), keys).filter("__k IS NOT NULL").groupBy("__k")
                  .agg(F.max("__hit").alias("__hit"), *(F.sum(f"__c{i}").alias(f"__c{i}") for i in range(len(children)))))
        row = folded.agg(*(F.sum(f"__c{i}").alias(f"n{i}") for i in range(len(children))),
                         *(F.sum(F.when(~F.col("__hit"), F.col(f"__c{i}"))).alias(f"v{i}") for i in range(len(children))))
        frames.append(row.select(F.explode(F.array(*(F.struct(
            F.lit("foreign_key").alias("rule"), F.lit(child).alias("table_name"), F.lit(f"{ccol}->{parent}.{pcol}").alias("column_name"),
            F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("long").alias("checked_rows"),
            F.coalesce(F.col(f"v{i}"), F.lit(0)).cast("long").alias("violations"))
            for i, (child, ccol) in enumerate(children)))).alias("s")).select("s.*"))
    return _union(frames, tables)


def check_domains(tables: dict[str, Table]) -> DataFrame:
    """Enumerated columns holding a value outside the allowed set (NULLs are
    the not-null check's business)."""
    return _union([_row_report(t, df, {"domain"}) for t, df in tables.items()], tables)


def check_ranges(tables: dict[str, Table]) -> DataFrame:
    """Numeric bounds and decimal precision: a value that does not fit the declared
    DECIMAL(p, s) once rounded to s digits, or is no number.  A typed column
    always fits its own type, so precision is tested on ``raw_<column>`` (the
    value before the cast: text, double or a wider decimal) where the frame has it."""
    return _union([_row_report(t, df, {"range"}) for t, df in tables.items()], tables)


def check_lengths(tables: dict[str, Table]) -> DataFrame:
    """VARCHAR(n) columns holding longer text."""
    return _union([_row_report(t, df, {"length"}) for t, df in tables.items()], tables)


def check_all(tables: dict[str, Table]) -> DataFrame:
    """Every check in one report (not-null, unique, foreign keys, domains,
    ranges, lengths).  The per-row checks of a table share one aggregate
    pass over it; key and foreign-key checks group by key."""
    rows = [_row_report(t, df, {"not_null", "domain", "range", "length"}) for t, df in tables.items()]
    return _union(rows + [check_unique(tables), check_foreign_keys(tables)], tables)
