"""Compare registered queries with their SQL twins in DuckDB.

Usage: python tests/check_oracle.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if sql is None:
        return "rows-only", len(got)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return f"columns differ: spark {cols} sql {sorted(names)}", len(got)
    notes = []
    kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    }
    for name, kind in df.dtypes:
        if kinds.get(kind) != types[name].replace("STRING", "VARCHAR"):
            notes.append(f"{name}: {kind} vs {types[name]}")
    order = [names.index(c) for c in cols]
    a = sorted([tuple(plain(v) for v in r) for r in got], key=str)
    b = sorted([tuple(plain(r[i]) for i in order) for r in rel.fetchall()], key=str)
    if notes:
        return "types " + "; ".join(notes), len(a)
    if a == b:
        return "ok", len(a)
    sa, sb = set(a), set(b)
    diff = [f"rows {len(a)} vs {len(b)}", str(cols)]
    diff += [f"  spark only {r}"[:400] for r in sorted(sa - sb, key=str)[:3]]
    diff += [f"  sql only   {r}"[:400] for r in sorted(sb - sa, key=str)[:3]]
    return "MISMATCH " + "\n".join(diff), len(a)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from attestry.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(sf_dir)
    oracles = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            verdict, rows = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            verdict, rows = "ERROR " + str(error)[:900], -1
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += verdict not in ("ok", "rows-only")
        flag = "" if rows else "  <- no rows"
        print(f"{name:45s} {rows:7d} {time.time() - start:6.2f}s {verdict}{flag}", flush=True)
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
