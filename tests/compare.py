"""Run registered queries and their SQL on the same tables and compare the rows.

`python tests/compare.py [prefix ...] [--sf 0.01]` prints one line per query.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _shown(value):
    if isinstance(value, float):
        return "NULL" if value != value else f"{value:.9g}"
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_shown(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_shown(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, build, sql):
    """(error or None, number of rows)"""

    df = build(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(ours)
    con.execute(sql)
    names = [d[0] for d in con.description]
    theirs = rows_of(names, con.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(ours)
    if ours != theirs:
        only = [r for r in ours if r not in set(theirs)][:2]
        other = [r for r in theirs if r not in set(ours)][:2]
        return f"{len(ours)} rows against {len(theirs)}; ours {only}; theirs {other}", len(ours)
    return None, len(ours)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("prefix", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--hot", help="rows above which a group counts as hot")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    if args.hot:
        spark.conf.set("witspark.hotRows", args.hot)
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        start = time.time()
        try:
            problem, count = compare(spark, con, sf_dir, build, oracles.get(name))
        except Exception as exc:  # one bad query must not hide the others
            problem, count = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{mark} {name} {kind} rows={count} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("     ", problem[:1500], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
