"""Run registered queries against their SQL: ``python tests/check_queries.py [folder] [name part ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

from rowmill import build_session  # noqa: E402
from rowmill.plans import load  # noqa: E402


def main(folder="/root/testdata/sf0.001", *parts):
    queries, sql = load()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            if name in sql:
                problems = oracle.compare(spark, con, folder, fn, sql[name])
            else:
                problems = [] if fn(spark, folder).count() else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:900]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.2f}s{'' if name in sql else ' (no sql)'}", flush=True)
        for p in problems:
            print("     ", p)
    print(f"{bad} failed")


main(*sys.argv[1:])
