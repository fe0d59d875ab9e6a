"""Compare named queries with their SQL twins: ``python tests/check_queries.py SF [name-prefix ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from metricloom.session import local_session  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main() -> None:
    sf, wanted = sys.argv[1], sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, d)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if problem is None else "DIFF " + problem
            else:
                note = f"rows {df.count()}"
                problem = None
        except Exception as e:  # noqa: BLE001 - the report must go on
            problem = note = f"FAIL {type(e).__name__} {str(e)[:700]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {note[:900]}", flush=True)
    print("problems:", bad)


main()
