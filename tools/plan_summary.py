"""Summarise the physical plan of every registered query (sf0.01): shuffle
exchanges, broadcast exchanges, scans (columns read, pushed filters), partial
window group limits and Python stages. Prints a markdown table."""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tablecare.plans.registry import QUERIES, load_all  # noqa: E402
from tablecare.session import get_spark  # noqa: E402


def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"^\(\d+\) Exchange\b", plan, re.M)),   # broadcasts and reuses have other names
        "broadcasts": len(re.findall(r"^\(\d+\) BroadcastExchange", plan, re.M)),
        "scans": len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)),
        "max_cols_read": max([len(m.split(",")) for m in re.findall(r"ReadSchema: struct<(.*)>", plan)] or [0]),
        "pushed": sorted(set(x for x in re.findall(r"PushedFilters: \[(.*)\]", plan) if x)),
        "wgl": len(re.findall(r"WindowGroupLimit", plan)),
        "python": bool(re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython", plan)),
        "smj": len(re.findall(r"SortMergeJoin", plan)),
        "nlj": len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)),
    }


def main(names=None, sf="/root/testdata/sf0.01"):
    load_all()
    spark = get_spark()
    print("| query | shuffles | broadcasts | scans | max cols read | partial top-k | python | sort-merge joins "
          "| nested-loop/cartesian |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name in names or sorted(QUERIES):
        df = QUERIES[name](spark, sf)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        s = summarise(plan)
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {s['scans']} | {s['max_cols_read']} | "
              f"{s['wgl'] > 0} | {s['python']} | {s['smj']} | {s['nlj']} |")


if __name__ == "__main__":
    main(sys.argv[1:] or None)
