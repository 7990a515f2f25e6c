"""Calendar scalars. Weekday is Monday=0 (``weekday()``)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.config import WEEKDAY_NAMES


def calendar(df: DataFrame, date: str = "date", with_year: bool = False) -> DataFrame:
    d = F.col(date)
    cols = {"month": F.month(d), "day": F.dayofmonth(d), "day_of_week": F.weekday(d)}
    if with_year:
        cols = {"year": F.year(d), **cols}
    df = df.withColumns(cols)
    return df.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))


def cyclic(df: DataFrame) -> DataFrame:
    two_pi = 2 * math.pi
    return df.withColumns({
        "month_sin": F.sin(two_pi * F.col("month") / 12),
        "month_cos": F.cos(two_pi * F.col("month") / 12),
        "dow_sin": F.sin(two_pi * F.col("day_of_week") / 7),
        "dow_cos": F.cos(two_pi * F.col("day_of_week") / 7),
    })


def dayname_codes(df: DataFrame, date: str = "date", name: str = "day_name_code") -> DataFrame:
    """Legacy encoding: the alphabetical rank (0-based) of the English day name.

    The names are a fixed set of seven, so the rank is a constant lookup
    (``array_position`` in the sorted name list) instead of a global window.
    """
    ordered = sorted(WEEKDAY_NAMES)
    day_name = F.date_format(F.col(date), "EEEE")
    lookup = F.array(*[F.lit(n) for n in ordered])
    return df.withColumns({"day_name": day_name,
                           name: (F.array_position(lookup, day_name) - 1).cast("int")})
