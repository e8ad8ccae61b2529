"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from answerlens.catalog.fixtures import TABLES


def duck_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    return [d[0] for d in cur.description], cur.fetchall(), types


# Result types that must agree.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr
    )


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cols, rows, types = duck_rows(sql, sf_dir)
    want_cols, want = normal(cols, rows)
    assert got_cols == want_cols, (got_cols, want_cols)
    wrong = {c: (t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]}
    assert not wrong, f"types differ: {wrong}"
    if got != want:
        g, w = set(got), set(want)
        extra, lacking = [r for r in got if r not in w][:3], [r for r in want if r not in g][:3]
        raise AssertionError(f"{len(got)} rows against {len(want)}; extra {extra}; lacking {lacking}")
    return len(got)


def main():
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from answerlens.session import get_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                n = compare(spark, sf, fn, sqls[name])
                status = "ok"
            else:
                n, status = len(fn(spark, sf).collect()), "rows only"
        except Exception as e:  # noqa: BLE001
            bad += 1
            n, status = -1, "FAIL " + str(e)[:1500]
        print(f"{name:32s} {time.time() - t:6.2f}s {n:7d} {status}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
