"""Summarise the executed physical plan of every registered query.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
Counts, per query, the shuffles (Exchange), join strategies, aggregates,
windows and whole-stage-codegen spans of the final (AQE) plan after running
the query, and flags Python evaluation nodes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = {
    "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning|Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "shj": r"ShuffledHashJoin",
    "agg": r"HashAggregate|ObjectHashAggregate|SortAggregate",
    "sort_agg": r"SortAggregate",
    "window": r"\bWindow\b",
    "group_limit": r"WindowGroupLimit",
    "topk": r"TakeOrderedAndProject",
    "codegen": r"WholeStageCodegen|^\s*[:+-]*\s*\*\(\d+\)",
    "python": r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas",
    "single_partition": r"Exchange SinglePartition",
}


def summarise(plan: str) -> dict[str, int]:
    out = {}
    for k, pat in NODES.items():
        if k == "codegen":
            out[k] = len(set(re.findall(r"\*\((\d+)\)", plan)))
        else:
            out[k] = len(re.findall(pat, plan))
    return out


def main() -> None:
    from casework.plans.registry import load_all
    from casework.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    reg = load_all()
    cols = ["shuffle", "broadcast", "bhj", "smj", "agg", "sort_agg", "window", "group_limit", "topk",
            "codegen", "single_partition", "python"]
    print(f"# Physical plans ({sf}, local[8], AQE final plans)\n")
    print("Generated by `python tests/plan_report.py`. Counts of physical operators in the executed")
    print("plan of each registered query (after it ran). `single_partition` counts global")
    print("`Exchange SinglePartition` (only over bounded aggregates: see README).\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, (fn, _) in sorted(reg.items()):
        df = fn(spark, sf)
        df.collect()  # runs this DataFrame's own execution, so AQE's final plan is shown
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        s = summarise(plan)
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
