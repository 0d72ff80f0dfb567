"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        a, b = set(mine), set(theirs)
        return f"rows {len(mine)} / {len(theirs)}: {list(a - b)[:1]} {list(b - a)[:1]}"
    bad = [(x, y) for x, y in zip(mine, theirs) if x != y]
    return f"{len(bad)} of {len(mine)} differ: {bad[0]}" if bad else f"ok {len(mine)}"


def main(sf_dir: str, only: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "10g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, con, name, query, sqls[name], sf_dir)
            else:
                result = f"no sql, {query(spark, sf_dir).count()} rows"
        except Exception as problem:  # noqa: BLE001
            result = "ERROR " + str(problem).split("\n\n")[0][:700]
        print(f"{name:45s} {time.time() - start:6.1f}s {result}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
