"""Run registered queries next to their check SQL in DuckDB and compare the rows.

    python -m tests.check_queries [--sf sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

TESTDATA = os.environ.get("BANKSPARK_TESTDATA", "/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(repr(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return f"bool:{v}"
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def compare(spark_rows, duck_rows):
    """'' when equal, else a short account of the first difference."""
    (sn, sr), (dn, dr) = spark_rows, duck_rows
    if sn != dn:
        return f"columns differ: {sn} vs {dn}"
    if len(sr) != len(dr):
        return f"row counts differ: {len(sr)} vs {len(dr)}"
    if sr == dr:
        return ""
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    return f"{len(bad)} of {len(sr)} rows differ; columns {sn}; first {bad[0][0]} vs {bad[0][1]}"


_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}


def compare_types(df, description):
    """'' when every column has the same type on both sides."""
    spark_types = dict(df.dtypes)
    odd = [
        f"{d[0]}: {spark_types.get(d[0])} vs {d[1]}"
        for d in description
        if _TYPES.get(str(d[1]), str(d[1])) != spark_types.get(d[0])
    ]
    return f"types differ: {odd}" if odd else ""


def check(spark, con, query, folder):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return len(got[1]), ""
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    types = compare_types(df, cur.description)
    return len(got[1]), compare(got, rows_of(names, cur.fetchall())) or types


def main(argv):
    from bankspark.plans import all_queries
    from bankspark.session import local_session

    sf = "sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    folder = f"{TESTDATA}/{sf}"
    spark = local_session("check")
    con = duck(folder)
    failed = []
    for name, q in all_queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            n, problem = check(spark, con, q, folder)
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        mark = "FAIL" if problem else ("ok  " if q.sql else "rows")
        if problem or n == 0:
            failed.append(name)
        print(f"{mark} {name:45s} rows={n:<7d} {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{len(failed)} to look at: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
