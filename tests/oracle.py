"""Runs registered queries beside their SQL and compares names, rows and values: python tests/oracle.py FOLDER [QUERY...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None)
    norm = lambda v: "" if v is None else f"{v:.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(norm, r)) for r in text.itertuples(index=False))


def compare(spark, folder, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return rows_of(query(spark, folder).toPandas()), rows_of(con.sql(sql).df())


if __name__ == "__main__":
    import __spark_entry__ as entry
    from scarp.session import local_session

    spark = local_session(8)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracle:
        start = time.time()
        try:
            if name not in oracle:
                print("ROWS", name, queries[name](spark, sys.argv[1]).count(), round(time.time() - start, 1), flush=True)
                continue
            (c1, r1), (c2, r2) = compare(spark, sys.argv[1], name, queries[name], oracle[name])
            ok = c1 == c2 and r1 == r2
            print("OK  " if ok else "DIFF", name, len(r1), len(r2), round(time.time() - start, 1), flush=True)
            if not ok:
                print("   ", c1, c2, [x for x in r1 if x not in set(r2)][:3], [x for x in r2 if x not in set(r1)][:3], flush=True)
        except Exception as error:
            print("FAIL", name, repr(error)[:700], flush=True)
