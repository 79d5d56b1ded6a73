"""Compare queries with their oracle: ``python tools/check.py [-s SF] [-p SPAN] [name...]``."""

import argparse
import math
import sys
import time

sys.path.insert(0, "/root/repo")
import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session():
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or isinstance(v, (int, str)):
        return v
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((repr([norm(r[i]) for i in order]) for r in rows))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("-p", default=None)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from sessionledger.catalog import ORACLES, QUERIES

    d = f"/root/testdata/sf{a.s}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.p:
        spark.conf.set("sessionledger.scan.span", a.p)
        spark.conf.set("sessionledger.fold.span", a.p)
    bad = 0
    for name in a.names or list(QUERIES):
        t = time.time()
        try:
            df = QUERIES[name](spark, d)
            cols = df.columns
            got = df.collect()
            dt = time.time() - t
            if name not in ORACLES:
                print(f"rows  {name} {len(got)} {dt:.1f}s", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            ocols = [c[0] for c in cur.description]
            otypes = {c[0]: str(c[1]) for c in cur.description}
            exp = cur.fetchall()
            if sorted(cols) != sorted(ocols):
                bad += 1
                print(f"COLS  {name} spark={cols} duck={ocols}", flush=True)
                continue
            kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
            for c, ty in df.dtypes:
                if kinds.get(ty) != otypes[c]:
                    print(f"TYPE  {name}.{c} spark={ty} duck={otypes[c]}", flush=True)
            g, e = rows_of(cols, got), rows_of(ocols, exp)
            if g == e:
                print(f"ok    {name} {len(g)} {dt:.1f}s", flush=True)
            else:
                bad += 1
                gs, es = set(g) - set(e), set(e) - set(g)
                print(f"DIFF  {name} spark={len(g)} duck={len(e)} cols={sorted(cols)}", flush=True)
                print("   only spark:", *sorted(gs)[:4], sep="\n     ", flush=True)
                print("   only duck:", *sorted(es)[:4], sep="\n     ", flush=True)
        except Exception as ex:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {str(ex)[:900]}", flush=True)
    print("bad:", bad)


main()
