"""Runs queries on Spark and their SQL on DuckDB and compares the rows. `python -m tests.compare sf_dir NAME...`"""

from __future__ import annotations

import sys
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float | Decimal):
        return f"{float(v):.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> str | None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if got[1] != want[1]:
        return f"{sum(got[1].values())} rows against {sum(want[1].values())}; only here {list((got[1] - want[1]).items())[:3]}; only there {list((want[1] - got[1]).items())[:3]}"
    return None if want[1] else "no rows to compare"


if __name__ == "__main__":
    import time
    import traceback

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sorted(queries):
        start = time.time()
        try:
            said = compare(spark, sys.argv[1], queries[name], oracles[name]) if name in oracles else f"no SQL; {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:
            said = "ERROR " + str(e)[:600].replace("\n", " ")
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"RES {name}: {said or 'equal'} ({time.time() - start:.1f} s)", flush=True)
