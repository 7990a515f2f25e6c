"""Registry of named queries: a Spark builder and (when SQL-expressible) the
equivalent DuckDB SQL used as a value oracle on the same parquet tables.

Conventions for registered outputs: doubles rounded to 6 decimals, dates as
``yyyy-MM-dd`` strings, integers as bigint - on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ds(c) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def rounded(df, exclude=()):
    """Round every double column to 6 decimals, format date columns."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if f.name in exclude:
            out.append(F.col(f.name))
        elif t in ("double", "float"):
            out.append(r6(f.name).alias(f.name))
        elif t == "date":
            out.append(ds(f.name).alias(f.name))
        elif t in ("int", "smallint", "tinyint"):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def sql_round(cols, prefix="") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)
