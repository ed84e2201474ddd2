"""Summarise the physical plans of the headline queries.

For each query: parquet scans (and whether filters were pushed), shuffle exchanges,
broadcast exchanges, join strategies, Python nodes, and any nested-loop or cartesian
join.  Prints a markdown table.  Usage: ``python tests/plan_audit.py [sf_dir]``.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def audit(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {
        "parquet_scans": len(re.findall(r"FileScan parquet", plan)),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "bhj": len(re.findall(r"BroadcastHashJoin", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "nested_or_cartesian": len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", plan)),
        "windows": len(re.findall(r"\bWindow\b", plan)),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    import bench
    import __spark_entry__ as E
    from tidemark.session import local_session
    spark = local_session(8, 16)
    qs = E.queries()
    cols = ["parquet_scans", "pushed", "shuffles", "broadcasts", "bhj", "smj", "nested_or_cartesian",
            "python", "windows"]
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name in bench.HEADLINE:
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        a = audit(df)
        print(f"| {name} | " + " | ".join(str(a[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main(sys.argv)
