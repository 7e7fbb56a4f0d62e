"""python -m leafmill.checks [-s SF] [name-prefix ...]: run queries against their check SQL."""

import argparse
import sys
import time

from leafmill.checks.compare import compare, duck
from leafmill.plans import all_checks, all_queries
from leafmill.session import local_session

if __name__ == "__main__":
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", "--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    con = duck(sf_dir)
    queries, checks = all_queries(), all_checks()
    bad = 0
    for name in queries:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            print("...", name, end="\r", flush=True)
            df = queries[name](spark, sf_dir)
            if name in checks:
                ok, msg = compare(df, con, checks[name])
            else:
                n = len(df.collect())
                ok, msg = n > 0, f"{n} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    sys.exit(bad > 0)
