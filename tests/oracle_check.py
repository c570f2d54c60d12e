"""Run every query on Spark and its SQL on DuckDB and compare rows and types.

``python tests/oracle_check.py [sf_dir] [query ...]``
"""

import glob
import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def view(con, sql: str) -> pa.Table:
    """The result of a statement that must be storable as a view."""
    con.execute(f"CREATE OR REPLACE TEMP VIEW checked AS {sql}")
    return con.sql("SELECT * FROM checked").to_arrow_table()


def rows_of(table: pa.Table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    columns = [table.column(c).to_pylist() for c in table.column_names]
    return sorted(zip(*columns), key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """None if equal, else what differs."""
    a, b = sorted(spark_table.column_names), sorted(sql_table.column_names)
    if a != b:
        return f"columns {set(a) ^ set(b)}"
    kinds = [
        (c, str(spark_table.schema.field(c).type), str(sql_table.schema.field(c).type))
        for c in a
    ]
    differ = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    left, right = rows_of(spark_table), rows_of(sql_table)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    wrong = [(x, y) for x, y in zip(left, right) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows, first {wrong[0]} by {a}"
    if differ:
        return f"types {differ}"
    return None


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    queries = entry.queries()
    assert set(sql) <= set(queries), set(sql) - set(queries)
    bad = 0
    for name in only or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toArrow()
            took = time.time() - start
            if name not in sql:
                print(f"{name:28} {took:6.2f}s {got.num_rows:8} rows only", flush=True)
                continue
            want = view(con, sql[name])
            problem = compare(got, want)
        except Exception as e:  # report and go on with the next query
            took, problem, got = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}", None
        bad += problem is not None
        n = got.num_rows if got is not None else -1
        print(f"{name:28} {took:6.2f}s {n:8} {problem or 'ok'}", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
