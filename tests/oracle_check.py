"""Compares queries() with oracle_sql() on one data directory: rows, columns and an order-free hash of values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings canonical_docs chunks run_results sync_records bundle_registry eval_items mix_targets review_labels".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def canon(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, (int, str)) else str(value)


def rows(columns: list[str], data) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(canon(r[i]) for i in order)) for r in data)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} {len(want[1])}; only here {list(a - b)[:2]}; only there {list(b - a)[:2]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from sheafline.session import build_session

    spark = build_session(**{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    con = connect(sf)
    sqls = entry.oracle_sql()
    wanted = sys.argv[2:]
    bad = 0
    for name, q in entry.queries().items():
        if (wanted and name not in wanted) or (not wanted and name.startswith("p") and name[1:2].isdigit() and name[2:3] == "_"):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, name, q, sqls[name]) if name in sqls else f"(no SQL) {q(spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:300]}"
        bad += bool(said) and not said.startswith("(no")
        if said or len(wanted) > 0:
            print(f"{name}: {said or 'ok'} [{time.time() - t:.1f}s]", flush=True)
    print("differences:", bad)
