"""Run queries and their SQL twins side by side: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, name: str, query, sql: str, sf: str) -> str:
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    wanted = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if got == wanted:
        return f"ok {len(got)}"
    extra = [r for r in got if r not in set(wanted)][:2]
    missing = [r for r in wanted if r not in set(got)][:2]
    return f"DIFF spark={len(got)} duckdb={len(wanted)}\n   extra {extra}\n   missing {missing}"


def main() -> None:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in wanted:
        start = time.time()
        try:
            outcome = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
        except Exception as error:  # noqa: BLE001 - every query gets its line
            outcome = "ERROR " + "".join(traceback.format_exception_only(error))[:700]
        print(f"{name}: {outcome} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
