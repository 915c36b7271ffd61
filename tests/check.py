"""Compare every query with its SQL: `python tests/check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry_points  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int = 8, partitions: int | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} against {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    mine, theirs = canonical(mine), canonical(theirs)
    for column in mine.columns:
        a, b = mine[column], theirs[column]
        if a.dtype.kind != b.dtype.kind:
            return f"{column}: type {a.dtype} against {b.dtype}"
        wrong = (a != b) & ~(a.isna() & b.isna())
        if wrong.any():
            i = wrong.idxmax()
            return f"{column}: {wrong.sum()} of {len(a)} differ, first {a[i]!r} against {b[i]!r}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(), database(sf_dir)
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            mine = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracle:
                start = time.time()
                result = difference(mine, con.execute(oracle[name]).df())
                note = f"sql {time.time() - start:.1f}s"
            else:
                result, note = None if len(mine) else "no rows", "rows only"
        except Exception as error:  # noqa: BLE001
            result, took, note, mine = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, "", []
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name:26} {took:6.1f}s {len(mine):7} rows {note} {result or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
