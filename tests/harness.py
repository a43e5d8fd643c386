"""Spark-vs-DuckDB comparison used by the tests and by ``python -m tests.harness``.

Columns are compared by name (sorted), types by Arrow type, values as an
order-insensitive multiset of rows.
"""
from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
import pyarrow as pa

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(tbl: pa.Table):
    names = sorted(tbl.column_names)
    cols = [tbl.column(n).to_pylist() for n in names]
    return names, [tuple(_norm(c[i]) for c in cols) for i in range(tbl.num_rows)]


def _type_family(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return str(t)


def compare(spark_tbl: pa.Table, duck_tbl: pa.Table) -> dict:
    out = {"rows_spark": spark_tbl.num_rows, "rows_oracle": duck_tbl.num_rows}
    sn, sr = _rows(spark_tbl)
    dn, dr = _rows(duck_tbl)
    out["names_match"] = sn == dn
    st = {f.name: _type_family(f.type) for f in spark_tbl.schema}
    dt = {f.name: _type_family(f.type) for f in duck_tbl.schema}
    out["type_diffs"] = {k: (st.get(k), dt.get(k)) for k in set(st) | set(dt) if st.get(k) != dt.get(k)}
    if out["names_match"]:
        cs, cd = Counter(sr), Counter(dr)
        out["values_match"] = cs == cd
        if cs != cd:
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            out["sample_spark_only"] = [tuple(str(x)[:80] for x in r) for r in only_s]
            out["sample_oracle_only"] = [tuple(str(x)[:80] for x in r) for r in only_d]
    else:
        out["values_match"] = False
        out["names"] = (sn, dn)
    out["ok"] = out["names_match"] and out["values_match"] and not out["type_diffs"]
    return out


def run_key(spark, key: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as entry
    qs, sqls = entry.queries(), entry.oracle_sql()
    t0 = time.time()
    sdf = qs[key](spark, sf_dir)
    stbl = sdf.toArrow()
    t1 = time.time()
    res = {"key": key, "spark_sec": round(t1 - t0, 2)}
    if key not in sqls:
        res.update({"rows_spark": stbl.num_rows, "ok": True, "oracle": "rows-only"})
        return res
    con = con or duck_connect(sf_dir)
    dtbl = con.sql(sqls[key]).to_arrow_table()
    res["oracle_sec"] = round(time.time() - t1, 2)
    res.update(compare(stbl, dtbl))
    return res


def main(argv):
    sys.path.insert(0, ".")
    from assaykit.session import get_session
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = get_session()
    spark.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as entry
    keys = keys or list(entry.queries())
    con = duck_connect(sf)
    bad = 0
    for k in keys:
        try:
            r = run_key(spark, k, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "ok": False, "error": repr(e)[:600]}
        bad += not r.get("ok")
        print(r, flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main(sys.argv)
