"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def _cell(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name: str, path: str) -> dict:
    import __spark_entry__ as entry

    t0 = time.time()
    df = entry.queries()[name](spark, path)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    res = {"name": name, "rows": len(got), "spark_s": round(t1 - t0, 2)}
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return {**res, "ok": None}
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    res["sql_s"] = round(time.time() - t1, 2)
    res["ok"] = sorted(cols) == sorted(df.columns) and got == want
    if not res["ok"]:
        res["cols"] = (sorted(df.columns), sorted(cols))
        res["want_rows"] = len(want)
        g, w = set(got), set(want)
        res["only_spark"] = sorted(g - w, key=repr)[:3]
        res["only_sql"] = sorted(w - g, key=repr)[:3]
    return res


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from quire.session import get_session

    folder = sys.argv[1]
    only = sys.argv[2:] or list(entry.queries())
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in only:
        try:
            r = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "error": repr(e)[:1500]}
        print(r, flush=True)
