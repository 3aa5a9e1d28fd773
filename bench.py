"""Headline benchmark: prints ONE JSON line.

(default /root/testdata/sf0.1) on local[$BENCH_CPUS]: full column profile,
safe + recommended cleaning, correlation matrix, baseline model fit, plus
name reconciliation and the exploration results. Each result is fully
executed (noop sink or collect of a small result) and timed separately.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tablecare.operators import explore as X  # noqa: E402
from tablecare.operators.clean import safe_clean  # noqa: E402
from tablecare.operators.model import train_baseline  # noqa: E402
from tablecare.operators.profile import profile  # noqa: E402
from tablecare.operators.recommend import recommended_clean  # noqa: E402
from tablecare.plans.registry import QUERIES, load_all  # noqa: E402
from tablecare.session import get_spark  # noqa: E402
from tablecare.sources.tables import dirty_orders, load_table  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    load_all()
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    li = load_table(spark, sf_dir, "lineitem")
    timed("warmup", lambda: li.agg(F.count(F.lit(1))).collect())
    state = {}
    timed("profile_lineitem", lambda: state.__setitem__("p", profile(li, "lineitem")))

    def clean_both():
        res = safe_clean(li)
        cleaned = res.df.persist()
        res.log.collect()
        out, log, _ = recommended_clean(cleaned)
        run(out)
        log.collect()
        cleaned.unpersist()
    timed("clean_lineitem", clean_both)
    timed("safe_clean_dirty_orders", lambda: run(safe_clean(dirty_orders(spark, sf_dir)).df))
    timed("correlation_lineitem", lambda: X.correlation_matrix(li).collect())
    timed("box_stats_lineitem", lambda: X.box_stats(li).collect())
    timed("histogram_lineitem", lambda: X.histogram(li, "l_extendedprice").collect())

    def fit():
        cols = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                "l_returnflag", "l_linestatus"]
        d = li.select(*cols)
        p = state["p"]
        p2 = type(p)(p.table_name, p.n_rows, len(cols), p.duplicates_count,
                     [c for c in p.columns if c["name"] in cols[2:]])
        res = train_baseline(d, "l_extendedprice", p2, ["l_orderkey", "l_linenumber"], run_id="bench")
        run(res.predictions)
    timed("model_fit_lineitem", fit)
    timed("reconcile_names", lambda: run(QUERIES["reconcile_names"](spark, sf_dir)))
    timed("unordered_dedup", lambda: run(QUERIES["unordered_dedup"](spark, sf_dir)))
    timed("target_candidates", lambda: QUERIES["supplemented_candidates"](spark, sf_dir).collect())

    q = {k: v for k, v in times.items() if k != "warmup"}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(q.values()), 3), "unit": "sec",
                      "queries": q, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
