"""Run registered queries next to their SQL twins and report mismatches.

python tests/check_queries.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return sorted((k, plain(v)) for k, v in value.items())
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, sql, con):
    """Empty text when equal, else what differs."""
    cols, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    ocols, orows = canonical([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns {cols} vs {ocols}", len(rows)
    if len(rows) != len(orows):
        return f"rows {len(rows)} vs {len(orows)}\n   spark {rows[:2]}\n   sql   {orows[:2]}", len(rows)
    if rows != orows:
        bad = [(a, b) for a, b in zip(rows, orows) if a != b]
        return f"{len(bad)} of {len(rows)} rows differ; cols {cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", len(rows)
    types = {type(v).__name__ for r in rows[:50] for v in r}
    otypes = {type(v).__name__ for r in orows[:50] for v in r}
    if types != otypes:
        return f"types {types} vs {otypes}", len(rows)
    return "", len(rows)


def main() -> int:
    from boursecraft.plans import ORACLES, QUERIES
    from boursecraft.session import build_session, ensure_checkpoint_dir

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="sf0.01")
    parser.add_argument("--since", help="start at this query")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    sf_dir = f"/root/testdata/{args.sf}"
    con = connect(sf_dir)
    names = args.names or list(QUERIES)
    names = [n for q in names for n in QUERIES if n == q or (q.endswith("*") and n.startswith(q[:-1]))]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem, n = compare(df, ORACLES[name], con)
            else:
                n, problem = df.count(), ""
        except Exception as exc:  # noqa: BLE001
            problem, n = "".join(traceback.format_exception_only(exc))[:1500], -1
        took = time.time() - start
        mark = "ok  " if not problem else "FAIL"
        note = "" if name in ORACLES else " (rows only)"
        print(f"{mark} {name:28s} rows={n:7d} {took:5.1f}s{note} {problem}", flush=True)
        if problem or n == 0:
            failed.append(name if problem else f"{name}(empty)")
    print(f"{len(names)} checked, {len(failed)} to look at: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
