"""Run registered queries and compare each with its SQL text on DuckDB.

usage: python tools/check_results.py <table dir> [name prefix ...]
"""

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from weirgauge.catalog import ORACLES, QUERIES  # noqa: E402
from weirgauge.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6g}" if value != int(value) else str(int(value))
    if type(value).__name__ == "Decimal":
        return cell(float(value))
    return str(value)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple("" if x is None else x for x in r))


def connect(directory):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def compare(spark, con, directory, name):
    started = time.time()
    df = QUERIES[name](spark, directory)
    got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if name not in ORACLES:
        return f"rows-only {len(got[1])}", took, True
    result = con.execute(ORACLES[name])
    want = table_rows([c[0] for c in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", took, False
    if got[1] != want[1]:
        miss = [r for r in want[1] if r not in set(got[1])][:2]
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        return f"VALUES {len(got[1])} vs {len(want[1])}\n   {got[0]}\n   want {miss}\n   got  {extra}", took, False
    return f"ok {len(got[1])}", took, True


def main():
    directory, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(directory), 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            text, took, good = compare(spark, con, directory, name)
        except Exception as error:  # noqa: BLE001
            text, took, good = f"ERROR {type(error).__name__}: {str(error)[:700]}", 0.0, False
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not good
        print(f"{'  ' if good else '! '}{name:40s} {took:6.2f}s {text}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
