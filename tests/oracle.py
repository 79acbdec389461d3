"""Compare registered Spark queries with their DuckDB oracles.

``python -m tests.oracle [--dir DIR] [name-prefix ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return ("null",) if math.isnan(v) else ("n", round(v, 6) + 0.0)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, datetime.date):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", *[cell(x) for x in v])
    return ("s", str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql, limit: int = 3) -> list[str]:
    s_cols, s_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    d_cols, d_rows = rows_of(rel.columns, rel.fetchall())
    if s_cols != d_cols:
        return [f"columns {s_cols} <> {d_cols}"]
    out = []
    if len(s_rows) != len(d_rows):
        out.append(f"rows {len(s_rows)} <> {len(d_rows)}")
    if s_rows != d_rows:
        a, b = set(s_rows), set(d_rows)
        out += [f"spark only {x}" for x in sorted(a - b, key=repr)[:limit]]
        out += [f"oracle only {x}" for x in sorted(b - a, key=repr)[:limit]]
        if a == b and not out:
            out.append("row multiplicities differ")
    return out


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--dir"]:
        sf_dir, argv = argv[1], argv[2:]
    import __spark_entry__ as entry
    from filingscope.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                diff = differences(df, con, oracles[name])
            else:
                diff, n = [], df.count()
            note = "ok" if not diff else "DIFF " + " | ".join(diff)
            if name not in oracles:
                note += f" (no oracle, {n} rows)"
            elif not diff and df.limit(1).count() == 0:
                note += " EMPTY"
        except Exception as exc:  # report and go on with the next query
            diff, note = [1], "ERROR " + str(exc).split("JVM stacktrace")[0][:700]
        bad += bool(diff)
        print(f"{name:24s} {time.time() - start:6.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
