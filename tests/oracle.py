"""Compare registered queries with their SQL: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return repr([_plain(x) for x in v])
    return repr(v)


def _rows(table) -> tuple[list[tuple], dict[str, str]]:
    names = sorted(table.column_names)
    kinds = {n: str(table.schema.field(n).type).replace("large_", "") for n in names}
    columns = [[_plain(v) for v in table[n].to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True)) if columns else [], kinds


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    mine, my_kinds = _rows(df.toArrow())
    theirs, their_kinds = _rows(con.sql(sql).to_arrow_table())
    if my_kinds != their_kinds:
        return f"schema {my_kinds} vs {their_kinds}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else None


def main() -> int:
    from tests.conftest import make_session
    from tabprep.queries import QUERIES, SQL
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == p or (p.endswith("*") and n.startswith(p[:-1]))
                                       for p in names)]
    spark, con = make_session(), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                problem = compare(df, con, SQL[name])
                note = "ok" if problem is None else problem
            else:
                problem, note = None, f"rows only: {df.toArrow().num_rows}"
        except Exception as e:  # report every query, whatever happens to one
            problem = note = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
