"""Run registered queries beside their SQL in DuckDB and compare rows.

    python tests/oracle.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = round(float(value), 6)
        return 0.0 if number == 0 else number
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(frame, con, sql) -> str | None:
    """None when equal, else what differs."""
    got_rows = [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want_rows = cursor.fetchall()
    if sorted(frame.columns) != sorted(want_columns):
        return f"columns {sorted(frame.columns)} != {sorted(want_columns)}"
    got, want = normal_rows(frame.columns, got_rows), normal_rows(want_columns, want_rows)
    if len(got) != len(want):
        extra, lacking = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows != {len(want)}; extra {sorted(extra, key=repr)[:2]} lacking {sorted(lacking, key=repr)[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} != {b}"
    return None if want else "no rows on either side"


def main() -> None:
    from scholarloom.session import build_session
    import __spark_entry__ as e

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = e.oracle_sql()
    bad = 0
    for name, function in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            frame = function(spark, sf_dir)
            problem = compare(frame, con, oracles[name]) if name in oracles else f"rows only: {frame.count()}"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
