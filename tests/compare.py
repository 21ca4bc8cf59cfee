"""Run catalogue queries against their SQL in DuckDB: types, row counts and values."""

import glob
import math
import os
import sys
import time

import duckdb

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(v)) if not isinstance(v, float) else (False, f"{v:.3f}") for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9)
    return a == b


def compare(df, con, sql):
    """None when equal, else a description of the difference."""
    relation = con.sql(sql)
    spark_types = dict(df.dtypes)
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    if set(spark_types) != set(duck_types):
        return f"columns {sorted(spark_types)} vs {sorted(duck_types)}"
    columns = sorted(spark_types)
    wrong = {c: (spark_types[c], duck_types[c]) for c in columns
             if TYPES.get(spark_types[c]) != duck_types[c]}
    if wrong:
        return f"types {wrong}"
    ours = sorted((tuple(r) for r in df.select(columns).collect()), key=_key)
    picked = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(relation.query("r", f"SELECT {picked} FROM r").fetchall(), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}; first {ours[:2]} vs {theirs[:2]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(map(_same, a, b))]
    return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), oracle_sql()
    for name, build in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            verdict = compare(df, con, sqls[name]) if name in sqls else f"no sql, {df.count()} rows"
        except Exception as error:  # report and go on
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - start:.1f}s "
              f"{verdict or ''}", flush=True)
