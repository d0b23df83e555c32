"""Compare registered queries with their SQL: python tests/oracle.py SF_DIR [name prefix…]"""

import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(v)


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    rows, names = df.collect(), df.columns
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    other = res.fetchall()
    if sorted(names) != sorted(cols):
        return f"columns {sorted(names)} vs {sorted(cols)}"
    odd = [c for c in cols if types[c] not in ("BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN", "INTEGER")]
    if odd:
        return f"odd SQL types {[(c, types[c]) for c in odd]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [(n, k, types[n]) for n, k in df.dtypes if kinds.get(k) != types[n]]
    if off:
        return f"types differ {off}"
    order = sorted(cols)
    a = sorted(tuple(canon(r[c]) for c in order) for r in rows)
    idx = [cols.index(c) for c in order]
    b = sorted(tuple(canon(r[i]) for i in idx) for r in other)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)}/{len(a)} rows differ, {order}: {str(bad[0][0])[:300]} vs {str(bad[0][1])[:300]}"


def main():
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tracelens.session import get_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                verdict = compare(df, con, sqls[name]) or "ok"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:700]}"
        failed += verdict != "ok" and not verdict.startswith("rows only")
        print(f"{time.time() - start:6.2f}s {name}: {verdict}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
