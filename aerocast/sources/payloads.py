"""Landed JSON payloads -> flat rows.

Every payload is parsed with a declared schema (``from_json``); nothing is
inferred and nothing loops in Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocast.config import FORECAST_SLOTS, KELVIN_OFFSET, RAIN_KEYS

MANIFEST_SCHEMA = ("map<string, struct<model_type: string, kind: string, file: string, is_delta: boolean, "
                   "mae: double, rmse: double, r2: double, evaluation: string, scaler_file: string, "
                   "target_mean: double, target_std: double>>")
COMPARISON_SCHEMA = ("map<string, struct<candidates: map<string, struct<mae: double, rmse: double, r2: double>>, "
                     "champion: string>>")
STATION_ENVELOPE = "status string, data string"
STATION_DATA = ("aqi string, city struct<name: string, geo: array<double>>, "
                "iaqi map<string, struct<v: double>>, time struct<iso: string>")
WEATHER_SCHEMA = ("dt bigint, main struct<temp: double, humidity: double, pressure: double>, "
                  "wind struct<speed: double>, rain map<string, double>, clouds struct<all: double>, dt_txt string")
POLLUTION_SCHEMA = "list array<struct<components: map<string, double>>>"


def scan_manifest(docs: DataFrame, col: str = "value") -> DataFrame:
    """IO4: manifest document -> one row per horizon."""
    m = docs.select(F.explode(F.from_json(F.col(col), MANIFEST_SCHEMA)).alias("horizon", "h"))
    return m.select("horizon", "h.*")


def comparison_table(docs: DataFrame, col: str = "value") -> DataFrame:
    """Comparison document -> (horizon, candidate, mae, rmse, r2, is_champion)."""
    c = docs.select(F.explode(F.from_json(F.col(col), COMPARISON_SCHEMA)).alias("horizon", "h"))
    c = c.select("horizon", F.col("h.champion").alias("champion"),
                 F.explode("h.candidates").alias("candidate", "m"))
    return c.select("horizon", "candidate", "m.mae", "m.rmse", "m.r2",
                    (F.col("candidate") == F.col("champion")).alias("is_champion"))


def columnar_json(docs: DataFrame, col: str, fields: dict[str, str], section: str = "daily",
                  keep: Sequence[str] = ()) -> DataFrame:
    """IO5: struct of parallel arrays -> rows (``arrays_zip`` + ``inline``).
    ``fields`` maps array names in the payload to output column names; ``keep``
    are columns of the document that each of its rows gets."""
    schema = f"{section} struct<" + ", ".join(f"{k}: array<string>" if k == "time" else f"{k}: array<double>"
                                             for k in fields) + ">"
    parsed = docs.select(*keep, F.from_json(F.col(col), schema).alias("_p"))
    zipped = F.arrays_zip(*[F.col(f"_p.{section}.{k}").alias(v) for k, v in fields.items()])
    return parsed.select(*keep, F.inline(zipped))


def normalize_station(payloads: DataFrame, col: str = "payload", station_col: str = "station_id"):
    """IO6: station payload -> (accepted, rejects).

    Rejected: status <> 'ok', ``data`` not a JSON object, aqi missing / '-' /
    not numeric. Station name defaults to 'Station <id>'.
    """
    sid = F.regexp_replace(F.trim(F.col(station_col).cast("string")), r"^@+", "")
    env = payloads.withColumn("_env", F.from_json(F.col(col), STATION_ENVELOPE)).withColumn("_sid", sid)
    is_obj = F.ltrim(F.col("_env.data")).startswith("{")
    data = F.from_json(F.when(is_obj, F.col("_env.data")), STATION_DATA)
    env = env.withColumn("_d", data)
    aqi_txt = F.col("_d.aqi")
    aqi_num = aqi_txt.try_cast("double")
    reason = (F.when(F.col("_env.status").isNull() | (F.col("_env.status") != "ok"), F.lit("status"))
              .when(~F.coalesce(is_obj, F.lit(False)), F.lit("payload"))
              .when(aqi_txt.isNull() | (aqi_txt == "-"), F.lit("no_aqi"))
              .when(aqi_num.isNull(), F.lit("non_numeric")))
    env = env.withColumn("_reason", reason)
    keep = [c for c in payloads.columns if c not in (col, station_col)]
    iv = lambda k: F.col("_d.iaqi").getItem(k).getField("v")
    ok = env.where(F.col("_reason").isNull()).select(
        *keep, F.col("_sid").alias("station_id"),
        F.coalesce(F.col("_d.city.name"), F.concat(F.lit("Station "), F.col("_sid"))).alias("station_name"),
        aqi_num.alias("aqi"), iv("pm1").alias("pm1"), iv("pm25").alias("pm25"), iv("pm10").alias("pm10"),
        iv("t").alias("aqi_temperature"), iv("h").alias("aqi_humidity"),
        F.col("_d.time.iso").alias("timestamp"), F.col("_d.city.geo").alias("geo"))
    rejects = env.where(F.col("_reason").isNotNull()).select(*keep, F.col("_sid").alias("station_id"),
                                                             F.col("_reason").alias("reason"))
    return ok, rejects


def normalize_current(df: DataFrame, weather_col: str = "weather", pollution_col: str = "pollution") -> DataFrame:
    """IO7: current weather + pollution payloads -> one flat reading
    (Kelvin -> Celsius, rain defaults to 0, pollutants from the first list item)."""
    w = F.from_json(F.col(weather_col), WEATHER_SCHEMA)
    p = F.from_json(F.col(pollution_col), POLLUTION_SCHEMA)
    d = df.withColumn("_w", w)
    d = d.withColumn("_pc", F.try_element_at(p.getField("list"), F.lit(1)).getField("components"))
    keep = [c for c in df.columns if c not in (weather_col, pollution_col)]
    comp = lambda k: F.col("_pc").getItem(k)
    return d.select(
        *keep,
        F.date_format(F.from_unixtime(F.col("_w.dt")), "yyyy-MM-dd HH:mm:ss").alias("date"),
        (F.col("_w.main.temp") - KELVIN_OFFSET).alias("temperature"),
        F.col("_w.main.humidity").alias("humidity"), F.col("_w.main.pressure").alias("pressure"),
        F.col("_w.wind.speed").alias("wind_speed"),
        F.coalesce(F.col("_w.rain").getItem(RAIN_KEYS["current"]), F.lit(0.0)).alias("rain"),
        comp("pm10").alias("pm10"), comp("pm2_5").alias("pm25"), comp("co").alias("carbon_monoxide"),
        comp("no2").alias("nitrogen_dioxide"), comp("so2").alias("sulphur_dioxide"), comp("o3").alias("ozone"))


def forecast_slots(df: DataFrame, weather_col: str = "forecast", pollution_col: str = "air",
                   slots=FORECAST_SLOTS, key: tuple = ()) -> DataFrame:
    """IO8: pick list positions 7/15/23 of the forecast and air-pollution
    lists and pair them by position (the payloads carry no common key)."""
    wl = F.from_json(F.col(weather_col), f"list array<struct<{WEATHER_SCHEMA}>>").getField("list")
    pl = F.from_json(F.col(pollution_col), POLLUTION_SCHEMA).getField("list")
    d = df.select(*key, wl.alias("_wl"), pl.alias("_pl"))
    picked = d.select(*key, F.posexplode("_wl").alias("pos", "_w"), "_pl").where(F.col("pos").isin(list(slots)))
    picked = picked.withColumn("_pc", F.try_element_at(F.col("_pl"), F.col("pos") + 1).getField("components"))
    comp = lambda k: F.col("_pc").getItem(k)
    return picked.select(
        *key, F.col("pos").cast("int").alias("pos"), F.col("_w.dt_txt").alias("date"),
        (F.col("_w.main.temp") - KELVIN_OFFSET).alias("temperature"), F.col("_w.main.humidity").alias("humidity"),
        F.col("_w.main.pressure").alias("pressure"), F.col("_w.wind.speed").alias("wind_speed"),
        F.coalesce(F.col("_w.rain").getItem(RAIN_KEYS["forecast"]), F.lit(0.0)).alias("rain"), F.col("_w.clouds.all").alias("clouds"),
        comp("pm10").alias("pm10"), comp("pm2_5").alias("pm25"), comp("co").alias("carbon_monoxide"),
        comp("no2").alias("nitrogen_dioxide"), comp("so2").alias("sulphur_dioxide"), comp("o3").alias("ozone"))


def to_json_doc(df: DataFrame, key: str, value: Column) -> DataFrame:
    """IO13: rows (key, struct) -> one JSON map document (``map_from_entries``).
    Use only for bounded row counts (horizons x candidates)."""
    return df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), value)))).alias("value"))
