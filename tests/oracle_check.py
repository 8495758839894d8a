"""Runs queries beside their SQL twins. `python tests/oracle_check.py SF_DIR [name ...]`."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else what differs."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got_cols)}, first {bad[0]}" if bad else None


def main():
    import __spark_entry__ as entry
    from tallyrank.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            msg = compare(df, con, oracles[name]) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e)[:600]
        ok = msg is None or msg.startswith("rows only")
        if not ok:
            failed.append(name)
        msg = msg and msg[:900]
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
