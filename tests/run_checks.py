"""Runs registered queries against their checking SQL: python tests/run_checks.py [sf_dir] [name part...]"""

from __future__ import annotations

import importlib
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import compare, connection  # noqa: E402

from tideline.plans.catalog import load_all  # noqa: E402
from tideline.session import local_session  # noqa: E402


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    con = connection(sf_dir)
    failures = 0
    for name, q in load_all().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = q.run(spark, sf_dir)
            problem = compare(df, q.sql, con) if q.sql else f"rows only: {df.count()}"
            ok = problem is None or q.sql is None
        except Exception as error:
            text = str(error) if not os.environ.get("TRACE") else traceback.format_exc()
            problem, ok = f"error {type(error).__name__}: {text[:1500]}", False
        failures += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    importlib.invalidate_caches()
    sys.exit(1 if main(sys.argv[1:]) else 0)
