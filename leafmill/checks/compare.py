"""Side-by-side run of a query and its check SQL; rows compared whatever their order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(_value(x) for x in v.values())
    return v if isinstance(v, (int, str)) else str(v)


def compare(df, con, sql: str) -> tuple[bool, str]:
    names = sorted(df.columns)
    left = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    if sorted(got) != names:
        return False, f"columns {names} vs {sorted(got)}"
    order = [got.index(n) for n in names]
    right = Counter(tuple(_value(r[i]) for i in order) for r in cur.fetchall())
    if left == right:
        return True, f"{sum(left.values())} rows"
    only_l, only_r = left - right, right - left
    return False, (
        f"rows {sum(left.values())} vs {sum(right.values())}; cols {names}\n"
        f"   spark only ({sum(only_l.values())}): {list(only_l)[:2]}\n"
        f"   duck only ({sum(only_r.values())}): {list(only_r)[:2]}"
    )
