"""CLI: compare every registered query (or the named ones) with its oracle.

python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_compare import compare, duck_connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from sparkdq.session import get_session  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", shuffle_partitions=8)
    q = entry.queries()
    o = entry.oracle_sql()
    con = duck_connect(sf_dir)
    bad = 0
    for name in names or sorted(q):
        t = time.time()
        if name not in o:
            n = q[name](spark, sf_dir).count()
            print(f"{name:40s} ROWS-ONLY {n} rows ({time.time()-t:.1f}s)", flush=True)
            continue
        try:
            ok, msg = compare(spark, con, name, q[name], o[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{name:40s} {'OK ' if ok else 'BAD'} {msg} ({time.time()-t:.1f}s)", flush=True)
    print(f"{bad} mismatches")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
