"""Scalar rules as Column expressions.

All of them are built-in ``when`` chains and arithmetic: they stay inside
whole-stage codegen, no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerocast.config import (AQI_BANDS, CITY_CENTRE, GUIDANCE, KELVIN_OFFSET, LIMIT_COLOURS)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _band_chain(v: Column, table, pick: int) -> Column:
    expr = None
    for row in table:
        upper, out = row[0], row[pick]
        if upper is None:
            return expr.otherwise(F.lit(out)) if expr is not None else F.lit(out)
        cond = v <= upper
        expr = F.when(cond, F.lit(out)) if expr is None else expr.when(cond, F.lit(out))
    return expr


def aqi_band(v) -> Column:
    """band label, bands closed on the right (<=50 Good ... >300 Hazardous)."""
    v = _c(v)
    return F.when(v.isNull(), F.lit(None)).otherwise(_band_chain(v, AQI_BANDS, 1))


def aqi_color(v) -> Column:
    """band colour."""
    v = _c(v)
    return F.when(v.isNull(), F.lit(None)).otherwise(_band_chain(v, AQI_BANDS, 2))


def guidance_level(v) -> Column:
    v = _c(v)
    return F.when(v.isNull(), F.lit(None)).otherwise(_band_chain(v, GUIDANCE, 1))


def guidance_text(v) -> Column:
    """advice text in four levels."""
    v = _c(v)
    return F.when(v.isNull(), F.lit(None)).otherwise(_band_chain(v, GUIDANCE, 2))


def limit_pct(v, limit) -> Column:
    """share of the limit in percent, capped at 100."""
    return F.least(F.lit(100.0), _c(v) / _c(limit) * 100.0)


def limit_colour(pct) -> Column:
    p = _c(pct)
    return F.when(p < 60, F.lit(LIMIT_COLOURS[0])).when(p < 100, F.lit(LIMIT_COLOURS[1])).otherwise(
        F.lit(LIMIT_COLOURS[2]))


def kelvin_to_c(v) -> Column:
    """F8: Kelvin to Celsius."""
    return _c(v) - KELVIN_OFFSET


def epoch_to_text(v) -> Column:
    """F8: epoch seconds -> 'yyyy-MM-dd HH:mm:ss' in the session zone (UTC)."""
    return F.from_unixtime(_c(v), "yyyy-MM-dd HH:mm:ss")


def date_text(v) -> Column:
    return F.date_format(_c(v), "yyyy-MM-dd")


def clean_station_id(v) -> Column:
    """trim, then strip every leading '@'."""
    return F.regexp_replace(F.trim(_c(v)), r"^@+", "")


def horizon_label(v) -> Column:
    """'day1' -> 'Day 1'."""
    return F.replace(_c(v), F.lit("day"), F.lit("Day "))


def live_diff(pred, live) -> Column:
    """predicted minus live; NULL when either side is missing."""
    return _c(pred) - _c(live)


def default_chain(*candidates, default: float = 0.0) -> Column:
    """first candidate that parses as a number, else the constant."""
    return F.coalesce(*[_c(c).cast("string").try_cast("double") for c in candidates], F.lit(float(default)))


def geo_default(geo, i: int) -> Column:
    """coordinate ``i`` of a 2-element array, else the city centre."""
    g = _c(geo)
    return F.coalesce(F.when(F.size(g) == 2, F.get(g, i)), F.lit(float(CITY_CENTRE[i])))


def anchor(pred, live, strength: float) -> Column:
    """Pull a prediction toward the live reading; no live reading = unchanged."""
    p, lv = _c(pred), _c(live)
    return F.when(lv.isNull(), p).otherwise(p * (1.0 - strength) + lv * strength)
