"""Compare every query with its SQL on a folder of tables: python tests/check_oracles.py FOLDER [NAME ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v for v in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def same(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(canonical(got), canonical(want)):
        if a != b:
            return f"{a} != {b}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import get_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = get_session(**{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            note = f"{len(got)} rows only"
            if name in sql:
                note = same(got, con.execute(sql[name]).df()) or "ok"
                note += f" {len(got)}"
        except Exception as error:
            took, note = time.time() - start, "ERROR " + " ".join(str(error).split())[:400]
        bad += not (note.startswith("ok") or note.endswith("only"))
        print(f"{took:6.1f}s {name}: {note}", flush=True)
    print("failed:", bad)
