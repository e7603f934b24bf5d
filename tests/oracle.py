"""Compare registered queries with their SQL in DuckDB (also runnable as a script)."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "tinyint": "i", "smallint": "i", "int": "i", "integer": "i", "bigint": "i", "hugeint": "huge",
    "double": "d", "float": "d", "varchar": "s", "string": "s", "boolean": "b",
    "timestamp_ntz": "t", "timestamp": "t",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return repr(v)


def _table(columns, kinds, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    types = [KINDS.get(kinds[i].lower(), kinds[i].lower()) for i in order]
    return names, types, sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(plan, spark, con, folder) -> tuple[bool, str]:
    df = plan.run(spark, folder)
    rows = df.collect()
    if plan.sql is None:
        return True, f"rows={len(rows)}, ran only: no SQL to compare with"
    mine = _table(df.columns, [t for _, t in df.dtypes], rows)
    found = con.execute(plan.sql)
    columns = [d[0] for d in found.description]
    kinds = [str(d[1]) for d in found.description]
    other = _table(columns, kinds, found.fetchall())
    if mine[0] != other[0]:
        return False, f"columns {mine[0]} != {other[0]}"
    if mine[1] != other[1]:
        return False, f"types {list(zip(mine[0], mine[1], other[1]))}"
    if len(mine[2]) != len(other[2]):
        return False, f"rows {len(mine[2])} != {len(other[2])}"
    for a, b in zip(mine[2], other[2]):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(mine[0], a, b) if x != y]
            return False, f"row differs: {diff} in {a}"
    return True, f"rows={len(rows)}"


def main(folder: str, names: list[str]) -> int:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    from conftest import make_session

    from tablewright.plans import REGISTRY

    spark, con = make_session(), duck(folder)
    bad = unchecked = 0
    for name, plan in REGISTRY.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            ok, note = compare(plan, spark, con, folder)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        unchecked += ok and plan.sql is None
        print(f"{'FAIL' if not ok else 'ran ' if plan.sql is None else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", bad, "without SQL:", unchecked)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
