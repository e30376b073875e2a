"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list of query ids).
Each query is executed in full with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A01", "A02", "A05", "A10", "A14", "A15", "A22", "V01", "V05", "F18", "F19", "J01",
    "P01", "R01", "W01", "W02", "W04", "W10", "M01", "M02", "M05", "D01", "D02", "D04",
    "K02", "K03", "S13", "C02", "T03", "T05", "L04",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    ids = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from riskweave.plans.registry import load_all
    from riskweave.session import build_session
    spark = build_session(
        f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="riskweave-bench",
        extra={"spark.driver.memory": "16g",
               "spark.checkpoint.dir": tempfile.mkdtemp(prefix="rw-bench-ckpt-")})
    reg = load_all()
    reg["A01"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up, untimed
    times, rows = {}, {}
    for qid in ids:
        t = time.perf_counter()
        df = reg[qid].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[qid] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
