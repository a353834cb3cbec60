"""Tables as both engines name them: templates with {table} run on Spark over Parquet and on DuckDB over its views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rows(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    return spark.sql(template.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def plain(template: str) -> str:
    return template.format(**{t: t for t in TABLES})


def fixed(name: str, columns: str, rows: list[tuple]):
    """Registers a function of the session whose result, from fixed inputs, is `rows`, worked out by hand."""

    def shown(x: object) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return "NULL" if x is None else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)

    def put(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        QUERIES[name] = lambda spark, _: f(spark)
        values = ", ".join(f"({', '.join(map(shown, r))})" for r in rows)
        ORACLE_SQL[name] = f"SELECT * FROM (VALUES {values}) AS t({columns})"
        return f

    return put


def query(name: str, sql: str | None = None, **bases: str):
    """Registers a function of DataFrames named like `bases`; `sql` is its DuckDB text over the same bases as CTEs."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(**{k: rows(spark, sf_dir, t) for k, t in bases.items()})
        if sql is not None:
            ctes = ", ".join(f"{k} AS ({plain(t)})" for k, t in bases.items())
            body = sql.strip()
            if body.upper().startswith("WITH RECURSIVE "):
                ORACLE_SQL[name] = f"WITH RECURSIVE {ctes}, {body[15:]}"
            elif body.upper().startswith("WITH "):
                ORACLE_SQL[name] = f"WITH {ctes}, {body[5:]}"
            else:
                ORACLE_SQL[name] = f"WITH {ctes} {body}"
        return f

    return put
