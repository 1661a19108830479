"""Compare registered queries with their checking SQL: python tests/compare.py <folder> [name prefix ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402


def connect(folder: str):
    c = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"create view {path.stem} as select * from '{path}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in values), key=repr)


def compare(spark, c, folder, name, make, sql):
    at = time.time()
    df = make(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - at
    if sql is None:
        return "rows only", len(mine), took, ""
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(mine), took, f"{sorted(set(df.columns) ^ set(names))}"
    if mine == theirs:
        return "ok", len(mine), took, ""
    note = f"{len(mine)} vs {len(theirs)} rows; columns {sorted(names)}"
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    note += f"\n    only spark: {sorted(a - b)[:2]}\n    only sql:   {sorted(b - a)[:2]}  ({len(a - b)}/{len(b - a)})"
    return "DIFFERENT", len(mine), took, note


def main(folder: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from punctual.session import local_session

    spark = local_session(8)
    c = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, make in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            state, n, took, note = compare(spark, c, folder, name, make, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            state, n, took, note = "ERROR", 0, 0, str(e)[:900]
        bad += state not in ("ok", "rows only")
        print(f"{state:10} {name:40} {n:8} rows {took:6.1f} s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) and 1)
