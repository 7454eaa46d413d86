"""Run registered queries against their SQL in DuckDB and report differences.

    python tools/check_oracle.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from shardline.gallery import ORACLE, QUERIES  # noqa: E402
from shardline.gallery.base import BASE  # noqa: E402
from shardline.session import build_session  # noqa: E402


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return ("f", v)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


def compare(spark, name, folder, con):
    started = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in ORACLE:
        return f"rows-only {len(got)}", took, True
    rel = con.sql(ORACLE[name])
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(rel.columns)}", took, False
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    wide = [c for c, k in kinds.items() if k == "HUGEINT" or k.startswith("DECIMAL")]
    note = f" TYPES {wide}" if wide else ""
    if a == b:
        return f"ok {len(a)}{note}", took, not wide
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return f"DIFF rows {len(a)} vs {len(b)}{note}\n   spark {only_a}\n   sql   {only_b}", took, False


def main() -> int:
    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            text, took, good = compare(spark, name, folder, con)
        except Exception as e:  # noqa: BLE001
            text, took, good = f"ERROR {type(e).__name__} {str(e)[:600]}", 0.0, False
        bad += not good
        print(f"{'' if good else '!! '}{name} [{took:.1f}s] {text}", flush=True)
    print("bad:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
