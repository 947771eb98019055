"""Run registered queries against their SQL counterparts: ``python tests/check_against_sql.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from gridspark.fixtures import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(float(v))
    return str(v)


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty when equal, else what differs."""
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = normalised(want_cols, cur.fetchall())
    got = normalised(df.columns, df.collect())
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} differ, first {bad[0]}" if bad else ""


def main() -> int:
    from gridspark.registry import ORACLE, QUERIES
    from gridspark.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args[1:] or any(n.startswith(a) for a in args[1:])]
    spark = local_session(8)
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                problem = compare(df, con, ORACLE[name])
            else:
                problem = "" if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = "ERROR " + str(e).split("JVM stacktrace")[0][:700]
        failed += bool(problem)
        state = problem or ("ok" if name in ORACLE else "ok (rows only)")
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
