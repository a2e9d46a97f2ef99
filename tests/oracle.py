"""Run a query and its oracle side by side and compare all values.

``python tests/oracle.py /root/testdata/sf0.01 [name ...]`` checks from the shell.
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("documents", "embeddings", "events", "conversations", "benchmark", "labels", "pages")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows in order."""
    df = df[sorted(df.columns)].copy()
    for column in df.columns:
        values = df[column]
        if values.dtype.kind == "f":
            values = values.round(9)
        df[column] = values.map(lambda v: "<null>" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float)
                                else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    a, b = normal(ours), normal(theirs)
    for column in a.columns:
        wrong = a[column] != b[column]
        if wrong.any():
            at = wrong.idxmax()
            return f"{column}: {wrong.sum()} values differ, e.g. {a.loc[at].to_dict()} / {b.loc[at].to_dict()}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from factlake.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, run, oracles = connect(sf_dir), queries(), oracle_sql()
    good = bad = 0
    for name in names or run:
        start = time.time()
        try:
            ours = run[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            problem = None
            if name in oracles:
                problem = difference(ours, con.execute(oracles[name]).df())
            label = "rows only" if name not in oracles else "same"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, spent, ours = f"{type(error).__name__}: {str(error)[:700]}", time.time() - start, []
        good, bad = good + (problem is None), bad + (problem is not None)
        print(f"{name}: {problem or label} ({len(ours)} rows, {spent:.1f} s, "
              f"total {time.time() - start:.1f} s)", flush=True)
    print(f"{good} good, {bad} bad")


if __name__ == "__main__":
    main()
