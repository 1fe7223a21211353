"""spendlens: customer-behaviour analytics as Spark DataFrame operators.

Every operator is a function ``(DataFrame, ..., params) -> DataFrame`` built
from Catalyst expressions (and MLlib for the two fitted models).  Nothing is
collected to the driver except bounded scalars (a snapshot date, per-partition
offsets, model statistics).

Layout
------
``sources``    canonical schemas, typed readers, the adapter for the test tables
``functions``  column-level helpers (rounding rules, month arithmetic, fixed labels)
``operators``  the analytics operators (RFM, cohorts, Pareto, scoring, ...)
``plans``      query registry (``__spark_entry__``), DuckDB oracle SQL, the refresh job
               (stored profile / segment / product tables, month-partitioned orders)
               and the end-to-end modelling job
``streaming``  (empty: the reference has no streaming operator)
"""

__all__ = ["session"]
