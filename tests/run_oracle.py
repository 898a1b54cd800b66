"""Run every registered query against its DuckDB oracle: python tests/run_oracle.py [sf_dir] [name...]"""

import os
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from lucerna.session import get_session  # noqa: E402
from lucerna.plans.catalog import oracle_queries, spark_queries  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]")
    qs, sqls = spark_queries(), oracle_queries()
    con = duck(sf_dir)
    bad = 0
    for n in sorted(qs):
        if names and not any(n.startswith(x) for x in names):
            continue
        t = time.time()
        if n not in sqls:
            if os.environ.get("SQL_ONLY"):
                continue
            try:
                cnt = qs[n](spark, sf_dir).count()
                print(f"ROWS  {n:38s} {cnt} rows {time.time()-t:.1f}s", flush=True)
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERROR {n:38s} {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        try:
            ok, msg = compare(spark, n, qs[n], sqls[n], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK   ' if ok else 'FAIL '} {n:38s} {msg[:400]} {time.time()-t:.1f}s", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
