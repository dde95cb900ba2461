"""Time every oracle SQL in DuckDB (single process) at $BENCH_SF_DIR for comparison with bench.py.

Prints one JSON line; a query over the time limit is interrupted and reported as null.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import duck_connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    limit = float(os.environ.get("DUCK_LIMIT_SEC", "120"))
    threads = os.environ.get("BENCH_CPUS", "8")
    con = duck_connect(sf_dir)
    con.execute(f"SET threads = {threads}")
    out = {}
    for name, sql in sorted(entry.oracle_sql().items()):
        timer = threading.Timer(limit, con.interrupt)
        timer.start()
        t = time.perf_counter()
        try:
            con.execute(sql).fetchall()
            out[name] = round(time.perf_counter() - t, 3)
        except Exception:  # noqa: BLE001
            out[name] = None
        finally:
            timer.cancel()
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "limit_sec": limit, "queries": out}))


if __name__ == "__main__":
    main()
