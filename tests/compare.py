"""Side-by-side run of the registered queries and their SQL, for tests and by hand:
python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def plain(x):
    import datetime

    import numpy as np

    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, (np.integer,)):
        return int(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = bag(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}", got, want
    return None if got == want else f"{sum((got - want).values())} rows too many, {sum((want - got).values())} missing", got, want


if __name__ == "__main__":
    import __spark_entry__ as entry
    from palimpsest.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = build_session(cpus=8), duck(sf_dir)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            if name not in sqls:
                print(f"{name}: {query(spark, sf_dir).count()} rows, no SQL, {time.time() - began:.1f} s", flush=True)
                continue
            wrong, got, want = differences(spark, con, query, sqls[name], sf_dir)
            print(f"{name}: {'ok' if not wrong else wrong} {sum(got.values())} rows {time.time() - began:.1f} s", flush=True)
            if wrong:
                print("   spark:", list((got - want).items())[:3], "\n   sql:  ", list((want - got).items())[:3])
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {str(e)[:1500]}", flush=True)
