"""Run registered queries and their SQL side by side: python tests/oracle_compare.py [sf] [names...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, bool):
            return str(int(x))
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        return repr(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, con, sf_dir, name, queries, oracle):
    t = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if name not in oracle:
        return "rows-only", len(rows), took, ""
    got, cols = canon(rows, df.columns)
    rel = con.execute(oracle[name])
    want_cols = [d[0] for d in rel.description]
    want, wcols = canon(rel.fetchall(), want_cols)
    if cols != wcols:
        return "COLUMNS", len(rows), took, f"{cols} vs {wcols}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return "VALUES", len(rows), took, f"{len(got)} vs {len(want)}\n   {cols}\n   spark {a}\n   sql   {b}"
    return "ok", len(rows), took, ""


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    q, o = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(q)
    con, bad = duck(sf_dir), 0
    for name in names:
        try:
            status, n, took, note = compare(spark, con, sf_dir, name, q, o)
        except Exception as e:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0, str(e)[:600]
        bad += status not in ("ok", "rows-only")
        print(f"{name:32s} {status:10s} rows={n:<7d} {took:6.2f}s {note}", flush=True)
    print("bad", bad, "missing oracle", [k for k in q if k not in o], "orphans", [k for k in o if k not in q])


if __name__ == "__main__":
    main()
