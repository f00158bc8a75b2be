"""Run registered queries beside their SQL in DuckDB and compare the rows.

Usage: python -m tests.compare [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from cohortlens.session import START_SETTINGS  # noqa: E402


def session(cpus: str = "8") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cohortlens")
    for key, value in START_SETTINGS.items():
        builder = builder.config(key, value)
    spark = (builder
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def lines(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = lines(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = lines(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return f"rows {len(got)} / {len(want)}; {odd}"
    kinds = {n: str(d[1]) for n, d in zip(names, result.description)}
    whole = {"BIGINT", "INTEGER", "HUGEINT", "DOUBLE", "VARCHAR", "BOOLEAN"}
    odd_types = {n: (t, df.schema[n].dataType.simpleString()) for n, t in kinds.items()
                 if (t == "HUGEINT") or (t in whole and {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                                                        "BOOLEAN": "boolean"}.get(t) != df.schema[n].dataType.simpleString())
                 or t not in whole}
    return f"types {odd_types}" if odd_types else None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), database(folder)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql" if name in entry.oracle_sql() else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
