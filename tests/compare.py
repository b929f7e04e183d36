"""Run registered queries and their SQL side by side: python -m tests.compare FOLDER [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    """One spelling for values both engines write differently."""
    if isinstance(value, (decimal.Decimal, float)):
        value = float(value)
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def plan_problems(frame) -> list[str]:
    """Steps that do not hold up on large tables: all pairs, and Python row by row."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [s for s in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if s in plan]


def compare(spark, con, folder, function, sql):
    frame = function(spark, folder)
    problems = plan_problems(frame)
    if problems:
        return -1, False, f"plan has {problems}"
    ours, names = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return len(ours), None, ""
    result = con.execute(sql)
    theirs, their_names = rows_of([c[0] for c in result.description], result.fetchall())
    if names != their_names:
        return len(ours), False, f"columns {names} / {their_names}"
    if ours == theirs:
        return len(ours), True, ""
    mine, other = set(ours) - set(theirs), set(theirs) - set(ours)
    return len(ours), False, f"rows {len(ours)} / {len(theirs)}\n   ours {sorted(mine, key=repr)[:3]}\n   sql  {sorted(other, key=repr)[:3]}"


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from replyloom.session import get_spark

    spark = get_spark("compare", "local[8]", spark__sql__shuffle__partitions="8",
                      spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            n, same, note = compare(spark, con, folder, queries[name], oracles.get(name))
        except Exception as problem:  # shown per query, the rest still runs
            n, same, note = -1, False, f"{type(problem).__name__}: {str(problem)[:700]}"
        spark.catalog.clearCache()
        bad += same is False
        state = {True: "same", False: "DIFFERENT", None: "rows only"}[same]
        print(f"{name:34s} {state:10s} {n:8d} rows {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{bad} of {len(names or queries)} differ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
