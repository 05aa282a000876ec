"""Run registered queries on Spark and their SQL on DuckDB and compare.

    python tests/crosscheck.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


_FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "binary": "BLOB", "smallint": "SMALLINT",
}


def compare(spark, con, name, sf_dir, fn, sql):
    """None if equal, otherwise a message."""
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    right = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    types = {d[0]: str(d[1]) for d in result.description}
    for column, kind in df.dtypes:
        if _FAMILY.get(kind, kind) != types[column]:
            return f"type of {column}: {kind} vs {types[column]}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} differ, e.g. {bad[:2]}"[:900] if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from inkprint.runtime import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        begin = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, sf_dir, fn, sqls[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                rows = fn(spark, sf_dir).count()
                state, problem = f"rows only: {rows}", None
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = state = "ERROR " + str(error)[:1500]
        if problem:
            failed.append(name)
        print(f"{name:32s} {time.time() - begin:6.1f}s  {state}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
