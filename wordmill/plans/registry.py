"""Where plans register: a query by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, **kinds: str) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its own name; kinds are the SQL types of columns that SQL makes wider."""
    if sql is not None and kinds:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST("{c}" AS {k}) AS "{c}"' for c, k in kinds.items())}) FROM ({sql}) wide"

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table; only the named columns are read. Times without a zone are taken as the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    for field, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(field, df[field].cast("timestamp"))
    return df
