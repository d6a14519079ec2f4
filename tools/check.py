"""Run the catalog against its SQL: python tools/check.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from shelfcast.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(t) -> list[tuple]:
    cols = [t.column(c).to_pylist() for c in sorted(t.column_names)]
    rows = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in zip(*cols)]
    return sorted(rows, key=repr)


def compare(a, b) -> str:
    """Tables with the same column names, the same number of rows and equal values; NaN is not null."""
    if sorted(a.column_names) != sorted(b.column_names):
        x, y = set(a.column_names), set(b.column_names)
        return f"COLUMNS spark-only {sorted(x - y)} sql-only {sorted(y - x)}"
    if a.num_rows != b.num_rows:
        return f"ROWS spark {a.num_rows} sql {b.num_rows}"
    bad = [(x, y) for x, y in zip(canonical(a), canonical(b)) if x != y]
    if bad:
        x, y = bad[0]
        diff = [f"{c}: {p!r} / {q!r}" for c, p, q in zip(sorted(a.column_names), x, y) if p != q]
        return f"VALUES {len(bad)} rows differ, first {diff[:4]} in {x}"[:700]
    return "ok"


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    from catalog import QUERIES, SQL

    spark = local_session("check", cpus=int(os.environ.get("CHECK_CPUS", "8")))
    con = connect(folder)
    failed = []
    for name in args or QUERIES:
        t0 = time.time()
        try:
            got = QUERIES[name](spark, folder)
            types = dict(got.dtypes)
            a = got.toArrow()
            t1 = time.time()
            if name in SQL:
                rel = con.sql(SQL[name])
                kinds = dict(zip(rel.columns, map(str, rel.types)))
                b = rel.to_arrow_table()
                out = compare(a, b)
                odd = {c: (types[c], kinds[c]) for c in types if c in kinds and not same_type(types[c], kinds[c])}
                if out == "ok" and odd:
                    out = f"TYPES {odd}"
            else:
                out = "ok (rows only)" if a.num_rows else "EMPTY"
            t2 = time.time()
            print(f"{name:28s} {t1 - t0:6.2f}s {t2 - t1:6.2f}s {a.num_rows:8d} {out}", flush=True)
            if not out.startswith("ok"):
                failed.append(name)
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


def same_type(spark_type: str, sql_type: str) -> bool:
    pairs = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}
    return pairs.get(spark_type, "?") == sql_type


if __name__ == "__main__":
    sys.exit(main())
