"""Run queries and their SQL side by side and compare the rows.

    python -m checks.compare [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import threading
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from series_rank.session import LOCAL_SETTINGS, get_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> dict[str, list]:
    """Columns by name, rows sorted, missing values as None."""
    df = df[sorted(df.columns)]
    cells = ([None if pd.isna(v) else v for v in df[c].tolist()] for c in df.columns)
    rows = sorted(zip(*cells), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    return {c: list(v) for c, v in zip(df.columns, zip(*rows))}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when both hold the same columns and the same rows in any order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    if not len(got):
        return "no rows"
    got, want = canonical(got), canonical(want)
    for c in got:
        bad = [(i, a, b) for i, (a, b) in enumerate(zip(got[c], want[c])) if a != b or (type(a) is not type(b) and isinstance(a, bool))]
        if bad:
            return f"column {c}: {len(bad)} differ, first {bad[0]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--limit", type=float, default=60.0, help="seconds for one SQL statement")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = get_session("compare", "local[8]", 8, LOCAL_SETTINGS)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got = df.toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"\nROWS {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            stop = threading.Timer(args.limit, con.interrupt)
            stop.start()
            try:
                result = con.execute(ORACLES[name])
                types = {d[0]: str(d[1]) for d in result.description}
                want = result.fetchdf()
            finally:
                stop.cancel()
            why = difference(got, want)
            kinds = {c: (t, types[c]) for c, t in df.dtypes if c in types and not same_kind(t, types[c])}
            if kinds and not why:
                why = f"types {kinds}"
        except Exception as error:  # report and go on with the other queries
            why, took = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start
        failed += why is not None
        print(f"\n{'FAIL' if why else 'ok'} {name} {took:.1f}s/{time.time() - start:.1f}s {why or len(got)}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


def same_kind(spark_type: str, duck_type: str) -> bool:
    groups = [("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN")]
    return any(spark_type == a and duck_type.upper() in (b, "NUMBER", "STRING", "BOOL") for a, b in groups)


if __name__ == "__main__":
    sys.exit(main())
