"""Explain every query of the customer-analytics operators and flag plan shapes that do not scale.

A checkpoint hides the plan of what it holds, so the plan of every frame that a
query checkpoints is taken before the checkpoint and counted with the query's own.

Flags:
  single-partition  an ``Exchange SinglePartition`` whose input is not a
                    bounded frame (per-partition counts, class counts, the
                    months series, segment / bracket / category rows)
  cartesian / BNLJ  a cartesian product or broadcast nested-loop join
  python            BatchEvalPython / ArrowEvalPython / FlatMapGroupsInPandas

    python tools/plan_audit.py [sf_dir] [--dump DIR]
"""

from __future__ import annotations

import contextlib
import os
import re
import sys
from collections.abc import Iterator

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql.classic.dataframe import DataFrame  # noqa: E402

from spendlens.plans.registry import QUERIES  # noqa: E402
from spendlens.session import get_session  # noqa: E402

# Inputs of a single-partition step that are bounded by construction.
BOUNDED = ("__pid", "__nc", "raw_cluster", "bracket_revenue", "regr_", "size#", "revenue#",
           "sum(size", "__n#", "__m#", "__b#", "LocalTableScan", "name#")


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def before_checkpoints() -> Iterator[list[str]]:
    """The plans of the frames that are checkpointed inside, as they are before it."""
    plans: list[str] = []
    checkpoint = DataFrame.checkpoint

    def noted(df: DataFrame, *args, **kwargs) -> DataFrame:
        plans.append(physical(df))
        return checkpoint(df, *args, **kwargs)

    DataFrame.checkpoint = noted
    try:
        yield plans
    finally:
        DataFrame.checkpoint = checkpoint


def audit(plan: str) -> list[str]:
    lines = plan.splitlines()
    issues = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = " ".join(lines[i:i + 4])
            # a global aggregate ships one partial row per map task
            partial_global = "HashAggregate(keys=[], functions=[partial_" in lines[i + 1]
            if not partial_global and not any(b in below for b in BOUNDED):
                issues.append("single-partition: " + lines[i + 1].strip()[:140])
        if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", line):
            issues.append("nested-loop: " + line.strip()[:140])
        if re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", line):
            issues.append("python: " + line.strip()[:140])
    return issues


def summary(plan: str) -> dict:
    """Counts of the operators that decide cost at scale."""
    def n(pat):
        return len(re.findall(pat, plan))
    return {
        "hash_shuffles": n(r"Exchange hashpartitioning"),
        "range_shuffles": n(r"Exchange rangepartitioning"),
        "single_partition": n(r"Exchange SinglePartition"),
        "broadcasts": n(r"BroadcastExchange"),
        "smj": n(r"SortMergeJoin"),
        "bhj": n(r"BroadcastHashJoin"),
        "rdd_scans": n(r"Scan ExistingRDD"),
        "pushed_filters": n(r"PushedFilters: \[[^\]]"),
    }


def write_plans_md(rows: list[tuple[str, dict]], path: str) -> None:
    cols = list(rows[0][1])
    lines = ["# Physical plans (sf0.01, AQE initial plan)", "",
             "Generated by `python tools/plan_audit.py --plans-md PLANS.md`. Single-partition exchanges",
             "are all over bounded frames (partial global aggregates, one row per range partition or",
             "class, the 7 segments, 12 months, 2 brackets, category rows); RDD scans are the",
             "checkpointed distributed rankings (and the 7-row label table). Counts include the plans of the",
             "`checkpoints` frames as they are before their checkpoint.", "",
             "| query | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for name, d in rows:
        lines.append(f"| {name} | " + " | ".join(str(d[c]) for c in cols) + " |")
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def main():
    args = sys.argv[1:]
    sf = next((a for a in args if a.startswith("/root/testdata")), "/root/testdata/sf0.01")
    dump = args[args.index("--dump") + 1] if "--dump" in args else None
    plans_md = args[args.index("--plans-md") + 1] if "--plans-md" in args else None
    rows = []
    spark = get_session()
    total = 0
    for name, fn in sorted(QUERIES.items()):
        with before_checkpoints() as hidden:
            df = fn(spark, sf)
        plan = "\n".join([*hidden, physical(df)])
        if dump:
            os.makedirs(dump, exist_ok=True)
            with open(os.path.join(dump, f"{name}.txt"), "w") as fh:
                fh.write("\n".join([*hidden, df._jdf.queryExecution().explainString(
                    spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))]))
        rows.append((name, {"checkpoints": len(hidden), **summary(plan)}))
        issues = audit(plan)
        total += len(issues)
        print(f"{name:26s} {'ok' if not issues else ''}")
        for it in issues:
            print("    " + it)
    print(f"{total} issue(s)")
    if plans_md:
        write_plans_md(rows, plans_md)
    spark.stop()


if __name__ == "__main__":
    main()
