"""Runs queries against their oracles: python tests/oracle.py [sf] [name...]."""

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def difference(spark, name: str, run, sql: str, sf_dir: str) -> str:
    """'' if rows and column names agree."""
    got = run(spark, sf_dir)
    names = sorted(got.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=repr)
    cur = connect(sf_dir).execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"{name}: columns {names} and {sorted(cols)}"
    want = sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in cur.fetchall()), key=repr)
    if mine != want:
        a, b = set(mine), set(want)
        return f"{name}: {len(mine)} and {len(want)} rows; only here {sorted(a - b, key=repr)[:2]}; only there {sorted(b - a, key=repr)[:2]}"
    return ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from parchmill.session import build_session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = build_session("local[4]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in sys.argv[2:] or [n for n in queries if n in oracles]:
        t = time.time()
        try:
            said = difference(spark, name, queries[name], oracles[name], sf_dir) if name in oracles else f"{queries[name](spark, sf_dir).count()} rows, no oracle"
        except Exception as e:  # noqa: BLE001  one failure must not hide the others
            said = f"{name}: {type(e).__name__} {str(e)[:400]}"
        bad += bool(said)
        print(f"{name}: {'ok' if not said else said} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bool(bad))
