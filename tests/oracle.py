"""Compare queries with their SQL twins: python -m tests.oracle SF_DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty where both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    con = duck(sf_dir)
    cur = con.execute(sql)
    names, theirs = [d[0] for d in cur.description], cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, theirs)
    if ours == theirs:
        return ""
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"{len(ours)} rows against {len(theirs)}; only here {len(a)}: {sorted(a)[:2]}; only there {len(b)}: {sorted(b)[:2]}"


def main() -> int:
    from tests.conftest import make_spark

    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark, queries, oracles, bad = make_spark(), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        t = time.time()
        try:
            why = compare(spark, sf, queries[name], oracles[name]) if name in oracles else f"rows {queries[name](spark, sf).count()}" * 0 or ("" if queries[name](spark, sf).count() >= 0 else "none")
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(why)
        if why or names:
            print(f"{name} ({time.time() - t:.1f} s): {why or 'ok'}", flush=True)
    print(f"{len(names or queries)} queries, {bad} differ")
    return int(bool(bad))


if __name__ == "__main__":
    sys.exit(main())
