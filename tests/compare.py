"""Runs registered queries against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' * path.is_dir()}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(map(plain, r)) for r in zip(*columns, strict=True)), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if rows, names and kinds of columns agree."""
    got, want = query(spark, sf_dir).toArrow(), database(sf_dir).sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    kinds = lambda t: {n: str(t.schema.field(n).type).replace("large_", "") for n in t.column_names}
    if kinds(got) != kinds(want):
        return f"types {[(n, k, kinds(want)[n]) for n, k in kinds(got).items() if k != kinds(want)[n]]}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        odd = [x for x in a if x not in set(b)][:2] if len(a) < 100_000 else []
        return f"{len(a)} and {len(b)} rows; first only here: {odd}; only in SQL: {[x for x in b if x not in set(a)][:2] if len(b) < 100_000 else []}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sf, *names = sys.argv[1:]
    found, sql = entry.queries(), entry.oracle_sql()
    for name in names or sql:
        try:
            out = differences(session, found[name], sql[name], sf)
        except Exception as e:  # noqa: BLE001
            out = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, out or "ok", flush=True)
