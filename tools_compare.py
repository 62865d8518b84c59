"""Local oracle check: run each catalog query in Spark and its SQL in DuckDB, compare."""

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from sonolith.plans.catalog import REGISTRY  # noqa: E402
from sonolith.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main(sf_dir, names):
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ok = 0
    for name in names or list(REGISTRY):
        q = REGISTRY[name]
        t0 = time.time()
        try:
            df = q.run(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:800]}")
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS {name}: {len(rows)} rows ({ts:.1f}s) [no oracle]")
            ok += 1
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = [tuple(r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:800]}")
            continue
        spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        duck_types = {d[0]: str(d[1]) for d in res.description}
        want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
        bad = {c: (t, duck_types.get(c)) for c, t in spark_types.items() if want.get(t, t) != duck_types.get(c)}
        if bad:
            print(f"TYPE {name}: {bad}")
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(dcols, drows)
        if sorted(cols) != sorted(dcols):
            print(f"FAIL {name}: columns differ {sorted(cols)} vs {sorted(dcols)}")
        elif len(rows) != len(drows):
            print(f"FAIL {name}: rows {len(rows)} vs {len(drows)}")
        elif h1 != h2:
            diff = [(a, b) for a, b in zip(l1, l2) if a != b][:3]
            print(f"FAIL {name}: values differ; first diffs: {diff}")
        else:
            ok += 1
            print(f"OK   {name}: {len(rows)} rows ({ts:.1f}s)")
    print(f"{ok}/{len(names or REGISTRY)} ok")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
