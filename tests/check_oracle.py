"""Runs queries next to their SQL and compares rows. Usage: check_oracle.py SF [name ...]"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from ticketloom.session import build_session  # noqa: E402

STORE = os.environ.get("STORE") == "1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int,)):
        return float(value)
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(v is None, str(type(v)), v if v is not None else "") for v in r])


def compare(spark, con, name, fn, check, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if check is None:
        return "rows-only", len(got), took, ""
    res = con.execute(check)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return "COLUMNS", len(got), took, f"{got_cols} vs {want_cols}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return "VALUES", len(got), took, f"{len(got)} vs {len(want)} {diff}"
    return "ok", len(got), took, ""


def main() -> int:
    sf_dir, names = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        **({"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ticketloom-")} if STORE else {})})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    checks = oracle_sql()
    for name, fn in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            status, n, took, note = compare(spark, con, name, fn, checks.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, str(e)[:600]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:36} rows={n:<7} {took:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
