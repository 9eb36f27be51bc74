"""Run registered queries against their DuckDB counterparts.

    python tests/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in rows)


def differences(frame, con, sql) -> list[str]:
    """Problems between a Spark result and the SQL result; empty when equal."""
    got = frame.collect()
    answer = con.execute(sql)
    described = {d[0]: str(d[1]) for d in answer.description}
    want = answer.fetchall()
    problems = []
    if sorted(frame.columns) != sorted(described):
        return [f"columns {frame.columns} != {list(described)}"]
    for name, kind in frame.dtypes:
        if SAME_TYPE.get(kind, kind) != described[name]:
            problems.append(f"type of {name}: {kind} != {described[name]}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    a = _rows(frame.columns, got)
    b = _rows(list(described), want)
    if a != b:
        left, right = set(a), set(b)
        only_a, only_b = sorted(left - right), sorted(right - left)
        problems.append(f"{len(only_a)} rows differ, e.g. {only_a[:3]} != {only_b[:3]}")
    return problems


def main():
    import __spark_entry__ as entry
    from tabloom.session import build_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                  "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            if name in oracles:
                problems = differences(frame, con, oracles[name])
                note = f"ok {frame.count()} rows" if not problems else "; ".join(problems)
            else:
                problems, note = [], f"rows only: {len(frame.collect())}"
        except Exception as error:  # report and go on
            problems, note = ["error"], f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'pass'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
