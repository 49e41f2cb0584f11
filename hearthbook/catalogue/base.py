"""Registry of the runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hearthbook.session import ship, spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


# Tables whose rows cost much to look at: their scans are spread over all cores.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if wide or name in TEXT_TABLES else scan


def derive(spark: SparkSession, sf_dir: str, sql: str, wide: tuple[str, ...] = ()) -> DataFrame:
    """Input shape of a query, written in SQL both engines read; ``{orders}`` names a table."""
    used = {t: table(spark, sf_dir, t, t in wide) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def plain(df: DataFrame) -> DataFrame:
    """Result types both engines share: bigint, double, boolean, string; times as microseconds."""
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(t, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with the inventory ids it shows."""
    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plain(fn(spark, sf_dir))

        REGISTRY[name] = Query(run, duck(sql) if sql else None, covers)
        return fn
    return wrap


def sql_text(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_text(w) for w in words) + "]"
