"""Run registered queries against their SQL in DuckDB: python -m tests.compare sf_dir [name …]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if hasattr(v, "is_finite"):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def normal(rows, names) -> list[tuple[str, ...]]:
    place = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in place) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when names and rows agree, else what differs."""
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"columns {sorted(names)}: {g} != {w}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from listingscope.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    sql, bad = oracle_sql(), 0
    for name, run in queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sql:
                said = compare(df, con, sql[name]) or "ok"
            else:
                said = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            said = f"{type(e).__name__}: {str(e)[:700]}"
        bad += not said.startswith(("ok", "rows"))
        print(f"{name:32s} {time.time() - start:6.2f}s  {said}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
