"""Run registered queries on Spark and their oracle SQL on DuckDB; print a report.

usage: python scripts/check_oracle.py [sf_dir] [ID ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests"))

from oracle import compare, duck  # noqa: E402

from riskweave.plans.registry import load_all  # noqa: E402
from riskweave.session import build_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    ids = [a for a in args if not os.path.isdir(a)]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    reg = load_all()
    bad = 0
    for qid, q in reg.items():
        if ids and qid not in ids:
            continue
        t = time.time()
        try:
            df = q.build(spark, sf_dir)
            if q.sql is None:
                n = df.count()
                res = {"ok": True, "rows_spark": n, "rows_oracle": None, "detail": "rows-only"}
            else:
                res = compare(df, con, q.sql)
        except Exception as e:  # report and continue
            res = {"ok": False, "detail": f"{type(e).__name__}: {str(e)[:400]}"}
        res["sec"] = round(time.time() - t, 2)
        bad += 0 if res["ok"] else 1
        print(qid, json.dumps(res, default=str), flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
