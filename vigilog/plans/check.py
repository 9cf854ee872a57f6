"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python -m vigilog.plans.check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return "NULL" if v is None else str(v)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, check: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    cur = con.execute(check)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).split("(")[0] for d in cur.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours, theirs = normal(df.columns, df.collect()), normal(names, cur.fetchall())
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [f"{f.name}: {f.dataType.simpleString()} / {kinds[f.name]}" for f in df.schema
           if same.get(f.dataType.simpleString()) != kinds[f.name]]
    if ours != theirs:
        extra = sorted(set(ours) - set(theirs))[:3]
        missing = sorted(set(theirs) - set(ours))[:3]
        return f"rows {len(ours)} != {len(theirs)}; only ours {extra}; only theirs {missing}"
    return f"types differ: {odd}" if odd else None


def main(argv: list[str]) -> int:
    from vigilog.plans.queries import QUERIES
    from vigilog.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark, con, bad = local_session(), duck(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            q = QUERIES[name]
            df = q.build(spark, sf_dir)
            note = compare(df, con, q.check) if q.check else f"rows only: {df.count()}"
            fine = note is None or not q.check
        except Exception as error:  # keep going, report at the end
            note, fine = f"{type(error).__name__}: {str(error)[:700]}", False
        bad += not fine
        print(f"{'ok  ' if fine else 'FAIL'} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
