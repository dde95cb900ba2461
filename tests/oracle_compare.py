"""Run a registered query in Spark and its oracle SQL in DuckDB; compare rows."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

from sparkdq.sources.tables import TABLES, table_path


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    duck_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    for f in sdf.schema.fields:
        t = f.dataType.simpleString()
        if t in SPARK_TO_DUCK and duck_types.get(f.name) != SPARK_TO_DUCK[t]:
            return False, f"type of {f.name}: spark={t} duck={duck_types.get(f.name)}"
    srows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={scols} duck={dcols}"
    order = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in order) for r in drows]
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    a = sorted(srows, key=_key)
    b = sorted(drows, key=_key)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first diff: spark={x} duck={y}"
    return True, f"{len(srows)} rows"
