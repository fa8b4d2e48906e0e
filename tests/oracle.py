"""Runs registered queries beside their DuckDB SQL: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return v


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(spark, sf_dir: str, query, sql: str | None) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"{len(rows)} rows, no SQL"
    names, want = duck_rows(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = canonical(df.columns, rows), canonical(names, want)
    if a == b:
        return True, f"{len(a)} rows"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{len(a)} rows against {len(b)}; columns {sorted(names)}; first differences {diff}"


def main() -> int:
    from tests.conftest import make_spark

    import __spark_entry__ as entry

    spark = make_spark()
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            ok, what = compare(spark, sys.argv[1], queries[name], sql.get(name))
        except Exception as e:
            ok, what = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - t:.1f}s", what, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
