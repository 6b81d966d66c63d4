"""Benchmark the headline queries; prints ONE JSON line.

8 shuffle partitions, one warm-up run of every query, then per query the median of three, each run a full
``noop`` write (``count`` would let the planner drop columns).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roomrank.plans.fixture import fixture  # noqa: E402
from roomrank.plans.queries import registry  # noqa: E402
from roomrank.session import get_spark  # noqa: E402

HEADLINE = ["mrr_all", "top10_wide", "mrr_matched", "target_rank", "user_features", "loss_softmax",
            "review_vector", "hashed_text_vector", "drift_summary", "value_frequencies"]


def run_once(fn, spark, sf_dir) -> float:
    t = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_spark(f"local[{cpus}]", 8, extra={"spark.driver.memory": "16g"})
    reg = registry()
    t = time.perf_counter()  # deriving and writing the prepared tables, in a new session and folder
    fx = fixture(spark, sf_dir)
    for table in (fx.users, fx.review_keys, fx.matches):
        table.count()
    cold = round(time.perf_counter() - t, 3)
    for name in names:  # one warm-up run of every query first (JIT, Python workers, prepared tables)
        run_once(reg[name], spark, sf_dir)
    times = {}
    for name in names:
        fn = reg[name]
        runs = [run_once(fn, spark, sf_dir) for _ in range(reps)]
        print(name, [round(t, 3) for t in runs], file=sys.stderr, flush=True)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_query_median_sum", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "prepare_cold": cold, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
