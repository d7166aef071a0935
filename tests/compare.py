"""Run queries beside their SQL and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(sf_dir, f"{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is not None, str(type(x)) if x is None else "", x if x is not None else 0) for x in r)
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=key)


def differences(spark, con, name, query, sql, sf_dir):
    """None if equal, else a short report."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows, SQL {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{name}: {len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for n in names:
        t = time.time()
        try:
            bad = differences(spark, con, n, entry.queries()[n], entry.oracle_sql()[n], sf_dir)
        except Exception as e:  # report and go on
            bad = f"{n}: {type(e).__name__} {str(e)[:600]}"
        print(f"{'ok  ' if not bad else 'BAD '}{n} {time.time() - t:.1f}s", bad or "", flush=True)
