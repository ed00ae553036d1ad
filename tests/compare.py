"""Run registered queries beside their DuckDB SQL: row count, schema and sorted values.

python -m tests.compare SF_DIR [NAME...] prints a line for each query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty text if the Spark result and the SQL agree."""
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    if sorted(df.columns) != names:
        return f"columns: only Spark {sorted(set(df.columns) - set(names))}, only SQL {sorted(set(names) - set(df.columns))}"
    kinds = {d[0]: str(d[1]) for d in want.description}
    bad = [(c, t, kinds[c]) for c, t in df.dtypes if KINDS.get(t) != kinds[c]]
    if bad:
        return f"types: {bad[:6]}"
    place = {d[0]: i for i, d in enumerate(want.description)}
    right = sorted((tuple(r[place[c]] for c in names) for r in want.fetchall()), key=repr)
    left = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    if len(left) != len(right):
        return f"rows: {len(left)} and {len(right)}"
    for a, b in zip(left, right):
        for c, x, y in zip(names, a, b):
            if x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1.5e-6):
                return f"values: {c}: {x!r} and {y!r} in {a} and {b}"[:600]
    close = sum(a != b for a, b in zip(left, right))
    return f"close: {close} rows differ in the last digit" if close else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = query(spark, sf_dir)
            said = differences(df, con, oracles[name]) if name in oracles else f"{df.count()} rows, no SQL"
        except Exception as e:
            said = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
