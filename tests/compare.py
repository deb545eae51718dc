"""Run queries beside their SQL on one data folder: ``python tests/compare.py FOLDER [NAME...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings files symbols edges imports benchmark doc_levels"


def _value(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(_value(y) for y in x)
    if isinstance(x, pd.Timestamp):
        return str(x)
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if hasattr(x, "item"):
        return _value(x.item())
    return int(x) if type(x).__name__ == "Decimal" else x


def bag(df: pd.DataFrame) -> Counter:
    df = df[sorted(df.columns)]
    return Counter(tuple(_value(x) for x in row) for row in df.itertuples(index=False, name=None))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        p = Path(folder, f"{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def frames(rows, df) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in rows], columns=df.columns, dtype=object)


def compare(spark, folder: str, name: str, query, sql: str | None) -> str:
    began = time.time()
    df = query(spark, folder)
    rows = df.collect()
    took = time.time() - began
    if sql is None:
        return f"{'rows' if rows else 'EMPTY'} {name} {len(rows)} rows {took:.1f} s"
    got = bag(frames(rows, df))
    began = time.time()
    r = connect(folder).sql(sql)
    want = bag(pd.DataFrame(r.fetchall(), columns=r.columns, dtype=object))
    same = got == want and sorted(df.columns) == sorted(r.columns)
    line = f"{'same' if same else 'DIFFERENT'} {name} {len(rows)} rows {took:.1f} s, SQL {time.time() - began:.1f} s"
    if not same:
        line += f"\n  only Spark {list((got - want).items())[:3]}\n  only SQL {list((want - got).items())[:3]}"
    return line


if __name__ == "__main__":
    import __spark_entry__ as entry

    from tessera.session import local_session

    spark = local_session("compare", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        try:
            print(compare(spark, sys.argv[1], name, queries[name], sqls.get(name)), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAILED {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
