"""Projection, cleaning and schema operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns, renamed (old -> new), in mapping order."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def drop_null_target(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows null in any of ``subset`` (NaN counts as null)."""
    cond = None
    for c in subset:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c)) if _is_fractional(df, c) else F.col(c).isNotNull()
        cond = ok if cond is None else cond & ok
    return df.where(cond) if cond is not None else df


def _is_fractional(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


drop_null_rows = drop_null_target


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN -> NULL so averages are not poisoned (Spark NaN is not NULL)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: fail before any job runs if a needed column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required feature column(s): {', '.join(missing)}")
    return df


_FLOAT = {"double", "float", "float32", "float64", "real"}
_INT = {"bigint", "int", "integer", "long", "int64", "int32"}


def align_schema(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Cast to a declared (column -> type name) schema.

    float types: lenient (non-numeric -> NULL); integer types: strict - a value
    that is NULL or does not parse fails the job, fractions truncate, 64-bit
    values stay exact; decimal(p,s) and boolean: lenient; date; timestamp (UTC
    session zone); string; any other type name raises. A missing column is an error raised
    before the plan runs. Columns outside the schema pass through.
    """
    require_columns(df, list(schema))
    out = {}
    for c, t in schema.items():
        t = t.lower()
        src = F.col(c)
        if t in _FLOAT:
            out[c] = src.cast("string").try_cast("double") if not _numeric(df, c) else src.cast("double")
        elif t in _INT:
            d = _whole(df, c)
            out[c] = F.when(d.isNull(), F.raise_error(F.concat(F.lit(f"cannot align {c} to {t}: "),
                                                              F.coalesce(src.cast("string"), F.lit("NULL")))))\
                .otherwise(d)
        elif t.startswith("decimal"):
            out[c] = src.cast("string").try_cast(t)
        elif t in ("boolean", "bool"):
            out[c] = src.cast("string").try_cast("boolean")
        elif t == "date":
            out[c] = F.to_date(src)
        elif "timestamp" in t:
            out[c] = src.cast("timestamp") if not isinstance(df.schema[c].dataType, T.StringType) \
                else F.to_timestamp(src)
        elif "string" in t or "varchar" in t:
            out[c] = src.cast("string")
        else:
            raise ValueError(f"unknown type for {c}: {t}")
    return df.withColumns(out)


def _whole(df: DataFrame, c: str):
    """bigint of a column, truncated toward zero, NULL where it is no number in range; integers never pass through double."""
    kind, src = df.schema[c].dataType, F.col(c)
    if isinstance(kind, T.IntegralType):
        return src.cast("bigint")
    if isinstance(kind, T.DecimalType):
        return src.try_cast("bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(src), src.cast("double")).try_cast("bigint")
    text = F.trim(src.cast("string"))
    plain = text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$")
    return F.when(plain, F.regexp_replace(text, r"\..*$", "").try_cast("bigint")).otherwise(text.try_cast("double").try_cast("bigint"))


def _numeric(df, c):
    return isinstance(df.schema[c].dataType, T.NumericType)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: non-numeric text -> NULL."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


def truncate_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Float -> bigint by truncation toward zero; NULL fails the job."""
    return df.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in integer column {c}")))
                          .otherwise(F.col(c).cast("bigint")) for c in cols})


def backfill_rows(joined: DataFrame, date: str = "date", city: str | None = None,
                  placeholders: Sequence[str] = ("aqi_lag_1", "aqi_lag_2", "aqi_lag_3",
                                                 "aqi_rolling_mean_3", "aqi_change")) -> DataFrame:
    """Daily joined rows -> hourly feature-table layout at hour 0 with
    calendar columns and zero placeholders for the online lag features."""
    d = F.col(date)
    cols = {"hour": F.lit(0).cast("bigint"), "day": F.dayofmonth(d).cast("bigint"),
            "month": F.month(d).cast("bigint"), "year": F.year(d).cast("bigint"),
            "day_of_week": F.weekday(d).cast("bigint")}
    if city is not None:
        cols["city"] = F.lit(city)
    cols.update({p: F.lit(0.0) for p in placeholders})
    return joined.withColumns(cols)


def fill_defaults(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    """NULL -> 0.0; a listed column that is missing is added as 0.0."""
    present = [c for c in cols if c in df.columns]
    out = df.fillna(value, subset=present) if present else df
    return out.withColumns({c: F.lit(float(value)) for c in cols if c not in df.columns})


def threshold_filter(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Rows with value >= threshold."""
    return df.where(F.col(col) >= threshold)


def require_history(df: DataFrame, key: str, min_rows: int, date: str = "date",
                    raise_if_short: bool = False) -> DataFrame:
    """Keep series with at least ``min_rows`` distinct days (counted by
    an aggregation + semi-join, not a per-series window)."""
    counts = df.groupBy(key).agg(F.countDistinct(date).alias("_days"))
    ok = counts.where(F.col("_days") >= min_rows)
    if raise_if_short:
        short = counts.where(F.col("_days") < min_rows).limit(1).collect()
        if short:
            raise RuntimeError(f"Not enough history for {short[0][key]}: {short[0]['_days']} < {min_rows} days")
    return df.join(ok.select(key), key, "left_semi")


def route_by_kind(df: DataFrame, kind: str, col: str = "kind") -> DataFrame:
    """Manifest rows of one model kind."""
    return df.where(F.col(col) == kind)
