"""Physical-plan summary of every registered query: exchanges, broadcasts,
window group limits, scans and the columns they read.  Usage:
python tools/plan_report.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuskit.session import build_session  # noqa: E402
from corpuskit.queries import all_queries  # noqa: E402

SKIP = {"connected_components", "cycle_edges", "contract_graph", "subtree_totals"}  # iterative: eager rounds


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    print("| query | shuffle exchanges | broadcasts | window group limit | scans (columns read) |")
    print("|---|---|---|---|---|")
    for name, fn in all_queries().items():
        if name in SKIP:
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        bcast = plan.count("BroadcastExchange")
        wgl = "yes" if "WindowGroupLimit" in plan else ""
        scans = []
        for m in re.finditer(r"FileScan parquet [^\[]*\[([^\]]*)\][^\n]*?Location: [^\[]*\[file:[^\]]*/(\w+)\.parquet\]", plan):
            cols = [c.split("#")[0] for c in m.group(1).split(",")]
            scans.append(f"{m.group(2)}({', '.join(cols)})")
        print(f"| {name} | {shuffles} | {bcast} | {wgl} | {'; '.join(sorted(set(scans)))} |")
    spark.stop()


if __name__ == "__main__":
    main()
