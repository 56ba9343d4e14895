"""Run registered queries against their SQL on DuckDB: ``python tests/compare.py [pattern] [sf]``."""

from __future__ import annotations

import math
import re
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
KINDS = [
    ("int", r"^(tinyint|smallint|int|bigint|integer|hugeint)$"), ("real", r"^(float|double)$"),
    ("text", r"^(string|varchar)$"), ("bool", r"^boolean$"), ("date", r"^date$"), ("time", r"^timestamp"),
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def kind(name: str) -> str:
    return next((k for k, p in KINDS if re.match(p, name.lower())), name.lower())


def tidy(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return 0.0 if v == 0 and isinstance(v, float) else v


def bag(rows, order) -> Counter:
    return Counter(tuple(tidy(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when the two results agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    theirs = {n: kind(str(d[1])) for n, d in zip(names, cur.description, strict=True)}
    ours = {n: kind(t) for n, t in df.dtypes}
    expected = bag(cur.fetchall(), [names.index(n) for n in sorted(names)])
    rows = df.collect()
    got = bag(rows, [df.columns.index(n) for n in sorted(names)])
    if ours != theirs:
        return f"types { {n: (ours[n], theirs[n]) for n in ours if ours[n] != theirs[n]} }"
    if got != expected:
        extra, missing = got - expected, expected - got
        return (f"rows {sum(got.values())} vs {sum(expected.values())}; "
                f"only here {list(extra)[:2]}; only there {list(missing)[:2]}")
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    folder = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if not pattern.search(name):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                verdict = differences(df, con, oracles[name])
                n = ""
            else:
                verdict, n = None, f"{df.count()} rows, no oracle"
        except Exception as e:  # noqa: BLE001
            verdict, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += verdict is not None
        print(f"{'ok ' if verdict is None else 'BAD'} {name} {time.time() - start:.1f}s {n} {verdict or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
