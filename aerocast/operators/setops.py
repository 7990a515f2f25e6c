"""Sort, limit, sample and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_limit(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """L1: head/tail ``n`` after sorting - planned as a bounded top-k
    (TakeOrderedAndProject), never a full sort into one task."""
    return df.orderBy(*order).limit(n)


def sort_multi(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """L2: total order (range-partitioned sort)."""
    return df.orderBy(*order)


def argmin_group(df: DataFrame, by: Sequence[str], metric: str, tiebreak: Sequence[str]) -> DataFrame:
    """L3: per group, the row with the lowest metric; ties go to the smallest
    ``tiebreak`` (e.g. candidate order). Aggregate (``min_by``), no sort."""
    others = [c for c in df.columns if c not in by]
    key = F.struct(F.col(metric), *[F.col(t) for t in tiebreak])
    return df.groupBy(*by).agg(F.min_by(F.struct(*others), key).alias("_m")).select(*by, "_m.*")


def sample_seeded(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """L4: at most ``n`` rows, those with the smallest md5 of the key values and
    the seed joined by ``|``: reproducible on any partitioning and in any engine,
    and a bounded top-k."""
    return df.withColumn("_h", key_hash(key, seed)).orderBy("_h", *key).limit(n).drop("_h")


def key_hash(key: Sequence[str], seed: int) -> Column:
    """md5 of the key values and the seed, as lower-case hex."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed))))


def union_by_name(history: DataFrame, today: DataFrame) -> DataFrame:
    """SO1: append rows; columns missing on either side become NULL."""
    return history.unionByName(today, allowMissingColumns=True)


def dedup_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SO2: last row per key (highest ``order``) as a ``max_by`` aggregate -
    partially aggregated, so a key with a third of all rows reduces map-side."""
    others = [c for c in df.columns if c not in key]
    ordering = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), ordering).alias("_l")).select(*key, "_l.*")
