"""Run registered queries on Spark and their SQL on DuckDB and compare columns, types and rows.

Usage: python tools/check_oracle.py [--sf FOLDER] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from govspark.plans import ORACLE, QUERIES  # noqa: E402
from govspark.session import get_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in frame.columns}


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple("∅" if pd.isna(v) else repr(v) if isinstance(v, float) else str(v) for v in r)
                  for r in ordered.itertuples(index=False, name=None))


def compare(spark_rows: pd.DataFrame, duck_rows: pd.DataFrame) -> str:
    if sorted(spark_rows.columns) != sorted(duck_rows.columns):
        return f"columns differ: {sorted(spark_rows.columns)} / {sorted(duck_rows.columns)}"
    left, right = kinds(spark_rows), kinds(duck_rows)
    different = {c: (left[c], right[c]) for c in left if left[c] != right[c]}
    if different:
        return f"types differ: {different}"
    if len(spark_rows) != len(duck_rows):
        return f"row counts differ: {len(spark_rows)} / {len(duck_rows)}"
    a, b = rows(spark_rows), rows(duck_rows)
    if a != b:
        pairs = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(pairs)} rows differ, first: {pairs[0]}"
    return ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("prefixes", nargs="*")
    options = parser.parse_args()
    spark = get_session("check", "local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(options.sf)
    bad = 0
    for name, function in QUERIES.items():
        if options.prefixes and not any(name.startswith(p) for p in options.prefixes):
            continue
        started = time.time()
        try:
            got = function(spark, options.sf).toPandas()
            spent = time.time() - started
            started = time.time()
            verdict = compare(got, connection.execute(ORACLE[name]).df()) if name in ORACLE else "no SQL"
            note = f"{len(got)} rows, spark {spent:.1f}s, duck {time.time() - started:.1f}s"
        except Exception as error:  # noqa: BLE001
            verdict, note = "".join(traceback.format_exception_only(error))[:1500], ""
        ok = verdict in ("", "no SQL")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {verdict or 'equal'} ({note})", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
