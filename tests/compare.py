"""Runs registered queries next to their checking SQL and compares whole results."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet{'/*.parquet' if Path(sf_dir, name + '.parquet').is_dir() else ''}'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return decimal.Decimal(value).normalize()
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def kind(value):
    return "number" if isinstance(value, (int, decimal.Decimal)) and not isinstance(
        value, bool) else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else a description of the difference."""
    frame = queries()[name](spark, sf_dir)
    mine = frame.collect()
    if name not in oracle_sql():
        return None if mine else "no rows"
    cursor = con.execute(oracle_sql()[name])
    theirs_columns = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(frame.columns) != sorted(theirs_columns):
        return f"columns {sorted(frame.columns)} / {sorted(theirs_columns)}"
    left, right = rows_of(frame.columns, mine), rows_of(theirs_columns, theirs)
    if not mine:
        return "both empty" if not theirs else "no rows"
    if left != right:
        only_left, only_right = left - right, right - left
        return (f"rows {len(mine)} / {len(theirs)}; only here {list(only_left)[:2]};"
                f" only there {list(only_right)[:2]}")
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from fraudloom.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or list(queries()):
        begin = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        state = "ok" if problem is None else f"DIFFERS {problem}"
        checked = "" if name in oracle_sql() else " (rows only)"
        print(f"{name:28s} {time.time() - begin:6.2f}s {state}{checked}", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
