"""Compares queries with their SQL twins, as sorted rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(canonical, v))
    return v


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def differences(spark, con, q, sf_dir):
    """What is wrong with a query, or an empty list."""
    df = q.build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if q.sql is None:
        return [] if df.columns else ["no columns"]
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    kinds = dict(df.dtypes)
    for d in cur.description:
        if (k := KINDS.get(str(d[1]))) and k != kinds[d[0]] or str(d[1]) == "HUGEINT":
            out.append(f"{d[0]}: {kinds[d[0]]} and {d[1]}")
    order = [df.columns.index(n) for n in names]
    got = sorted(str(tuple(canonical(r[i]) for i in order)) for r in rows)
    want = sorted(str(tuple(map(canonical, r))) for r in want)
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        out.append(f"rows {len(got)} and {len(want)}; only here {a}; only there {b}")
    return out
