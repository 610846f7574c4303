"""Check registered queries against their SQL: ``python tests/run_check.py [sf_dir] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry
from oracle_compare import compare, connect
from traitspark.session import build_session

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(qs)
    failed = []
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in sql:
                msg = compare(df, con, sql[n]) or "ok"
            else:
                msg = f"rows-only {len(df.collect())}"
        except Exception as e:
            msg = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if msg != "ok" and not msg.startswith("rows-only"):
            failed.append(n)
        print(f"{n:28s} {time.time() - t:6.1f}s {msg}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine; failed: {failed}")
