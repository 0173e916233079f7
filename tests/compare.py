"""Run registered queries beside their SQL twins: ``python -m tests.compare [sf_dir] [names...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of texts, columns by name; numbers compare by value."""

    def text(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, str):
            return v
        try:
            return repr(float(v))
        except (TypeError, ValueError):
            return str(v)

    ordered = pdf[sorted(pdf.columns)]
    return sorted(tuple(text(v) for v in row) for row in ordered.itertuples(index=False, name=None))


def compare(spark, con, sf: str, query, sql: str | None) -> tuple[bool, str]:
    got = query(spark, sf).toPandas()
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return True, f"{len(a)} rows"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return False, f"{len(a)} / {len(b)} rows; spark only {only_a[:3]}; sql only {only_b[:3]}"


def main() -> int:
    import __spark_entry__ as contract
    from granary.session import build_session, release_intermediates

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    if os.environ.get("PLAIN_SESSION"):  # Spark's own defaults
        builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        spark = builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = build_session(
            "compare", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="12g",
            spark__ui__showConsoleProgress="false",
        )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(sf), contract.queries(), contract.oracle_sql()
    names = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, detail = compare(spark, con, sf, queries[name], oracles.get(name))
        except Exception as exc:
            ok, detail = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {detail}", flush=True)
    release_intermediates(spark)
    print(f"{len(names) - bad} of {len(names)} match")
    return int(bad > 0)


if __name__ == "__main__":
    raise SystemExit(main())
