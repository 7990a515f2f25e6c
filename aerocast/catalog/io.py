"""Registered queries for sources and sinks.

Each one derives its input files from the driver tables with Spark, writes
them under the shared checkpoint folder (a fresh sub-folder per run) and
returns the read-back, so the whole write -> read path is value-checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast import bindings as B
from aerocast.catalog.registry import register, rounded
from aerocast.catalog.series import DAILY_SQL, _daily
from aerocast.config import AQI_BANDS, KELVIN_OFFSET
from aerocast.functions import rules as R
from aerocast.operators import stats as S
from aerocast.operators import windows as W
from aerocast.session import scratch_path
from aerocast.sources import feature_table as FT
from aerocast.sources import files as IOF
from aerocast.sources import models_io as MIO
from aerocast.sources import payloads as PL

_DAILY_ONLY = "WITH " + DAILY_SQL + " "
_DCOLS = ["y", "x1", "x2", "x3", "x4"]
_DSEL = "series_key, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(f"round({c}, 6) AS {c}" for c in _DCOLS)
_DAILY_SCHEMA = "series_key string, date date, y double, x1 double, x2 double, x3 double, x4 double"
_SPLIT = "1998-01-01"


def _utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


# ----------------------------------------------------------------- IO1 / IO2 / IO11 / IO12
@register("scan_csv", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily")
def q_scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    IOF.write_csv(_daily(spark, sf), path)
    return rounded(IOF.read_csv(spark, path, _DAILY_SCHEMA))


@register("scan_tsv", "SELECT event_id, event_type, round(value, 6) AS value, props FROM events")
def q_scan_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    ev = B.table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    IOF.write_csv(ev, path, sep="\t")
    return rounded(IOF.read_tsv(spark, path, "event_id bigint, event_type string, value double, props string"))


@register("append_csv", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily")
def q_append_csv(spark, sf):
    path = scratch_path(spark, "csv-append")
    d = _daily(spark, sf)
    IOF.append_csv(d.where(F.col("date") < _SPLIT), path)   # creates the dataset
    IOF.append_csv(d.where(F.col("date") >= _SPLIT), path)  # appends to it
    return rounded(IOF.read_csv(spark, path, _DAILY_SCHEMA))


@register("write_csv", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily")
def q_write_csv(spark, sf):
    path = scratch_path(spark, "csv-overwrite")
    d = _daily(spark, sf)
    IOF.write_csv(d.where(F.col("date") < _SPLIT), path)
    IOF.write_csv(d, path)  # overwrite replaces the first write
    return rounded(IOF.read_csv(spark, path, _DAILY_SCHEMA))


# ----------------------------------------------------------------- IO3
@register("scan_json_array", """SELECT event_type AS station, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
  CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
  round(value, 6) AS value FROM events""")
def q_scan_json_array(spark, sf):
    path = scratch_path(spark, "json-array")
    ev = B.table(spark, sf, "events")
    # one array document per (station, day): a bounded group, sorted by time
    docs = (ev.groupBy(F.col("event_type").alias("station"), F.to_date("ts").alias("day"))
            .agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("_r"))
            .select("station", "day", F.to_json(F.transform("_r", lambda r: r["value"])).alias("value")))
    docs.write.mode("overwrite").partitionBy("station", "day").text(path)
    out = IOF.read_json_array(spark, path)
    return rounded(out.select("station", "day", "pos", "value").withColumn("pos", F.col("pos").cast("int")),
                   exclude=("pos",))


# ----------------------------------------------------------------- IO5
_FIELDS = {"time": "date", "y_mean": "y", "x1_mean": "x1", "x2_mean": "x2", "x3_mean": "x3", "x4_mean": "x4"}


@register("columnar_json", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily")
def q_columnar_json(spark, sf):
    path = scratch_path(spark, "columnar")
    d = _daily(spark, sf)
    g = (d.groupBy("series_key", F.date_format("date", "yyyy-MM").alias("month"))
         .agg(F.sort_array(F.collect_list(F.struct("date", *_DCOLS))).alias("_r")))  # <= 31 rows per group
    def field(c):
        return lambda r: r[c]
    daily_struct = F.struct(F.transform("_r", lambda r: F.date_format(r["date"], "yyyy-MM-dd")).alias("time"),
                            *[F.transform("_r", field(c)).alias(f"{c}_mean") for c in _DCOLS])
    docs = g.select("series_key", F.to_json(F.struct(daily_struct.alias("daily"))).alias("value"))
    docs.write.mode("overwrite").partitionBy("series_key").text(path)
    raw = spark.read.text(path)
    rows = PL.columnar_json(raw, "value", _FIELDS, keep=["series_key"])
    return rounded(rows.withColumn("date", F.to_date("date")).select("series_key", "date", *_DCOLS))


# ----------------------------------------------------------------- IO6
def _station_payloads(spark, sf) -> DataFrame:
    ev = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    aqi = (F.when(F.col("value") >= 1.0, F.col("value").cast("string"))
           .when(F.col("value") < 0.5, F.lit("-")).otherwise(F.lit("n/a")))
    data = F.to_json(F.struct(
        aqi.alias("aqi"),
        F.struct(F.when(k > 20, F.col("event_type")).alias("name"), F.array(F.col("value"), k).alias("geo")).alias("city"),
        F.create_map(F.lit("pm25"), F.struct(F.col("value").alias("v")),
                     F.lit("pm10"), F.struct(k.alias("v"))).alias("iaqi"),
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso")).alias("time")))
    ok = F.col("user_id") > 10
    payload = F.to_json(F.struct(F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                                 F.when(ok, F.parse_json(data)).otherwise(F.parse_json(F.lit('"Unknown station"')))
                                 .alias("data")))
    return ev.select("event_id", F.concat(F.lit(" @"), F.col("event_type")).alias("station_id"),
                     payload.alias("payload"))


_STATION_SQL = """(SELECT event_id, event_type AS station_id, user_id > 10 AS ok,
  CASE WHEN value >= 1.0 THEN CAST(value AS VARCHAR) WHEN value < 0.5 THEN '-' ELSE 'n/a' END AS aqi_txt,
  value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ts FROM events)"""


@register("normalize_station", f"""SELECT event_id, station_id,
  CASE WHEN k > 20 THEN station_id ELSE 'Station ' || station_id END AS station_name,
  round(value, 6) AS aqi, round(value, 6) AS pm25, round(k, 6) AS pm10, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp
FROM {_STATION_SQL} WHERE ok AND value >= 1.0""")
def q_normalize_station(spark, sf):
    ok, _ = PL.normalize_station(_station_payloads(spark, sf))
    return rounded(ok.select("event_id", "station_id", "station_name", "aqi", "pm25", "pm10", "timestamp"))


@register("station_rejects", f"""SELECT event_id, station_id,
  CASE WHEN NOT ok THEN 'status' WHEN aqi_txt = '-' THEN 'no_aqi' ELSE 'non_numeric' END AS reason
FROM {_STATION_SQL} WHERE NOT ok OR value < 1.0""")
def q_station_rejects(spark, sf):
    _, rej = PL.normalize_station(_station_payloads(spark, sf))
    return rej.select("event_id", "station_id", "reason")


# ----------------------------------------------------------------- IO7
def _current_payloads(spark, sf) -> DataFrame:
    ev = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    weather = F.to_json(F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct((F.col("value") + KELVIN_OFFSET).alias("temp"), k.alias("humidity"),
                 (F.lit(1000.0) + k).alias("pressure")).alias("main"),
        F.struct((F.col("value") / 10).alias("speed")).alias("wind"),
        F.when(k > 50, F.create_map(F.lit("1h"), k / 10)).alias("rain")))
    pollution = F.to_json(F.struct(F.array(F.struct(F.create_map(
        F.lit("pm2_5"), F.col("value"), F.lit("pm10"), k, F.lit("co"), F.col("value") * 2, F.lit("no2"), k / 2,
        F.lit("so2"), F.lit(1.0), F.lit("o3"), F.col("value") / 2).alias("components"))).alias("list")))
    return ev.select("event_id", weather.alias("weather"), pollution.alias("pollution"))


_CUR_COLS = ["temperature", "humidity", "pressure", "wind_speed", "rain", "pm10", "pm25", "carbon_monoxide",
             "nitrogen_dioxide", "sulphur_dioxide", "ozone"]


@register("normalize_current", f"""SELECT event_id,
  strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS date,
  round((value + CAST({KELVIN_OFFSET!r} AS DOUBLE)) - CAST({KELVIN_OFFSET!r} AS DOUBLE), 6) AS temperature,
  round(k, 6) AS humidity, round(1000.0 + k, 6) AS pressure, round(value / 10, 6) AS wind_speed,
  round(CASE WHEN k > 50 THEN k / 10 ELSE 0.0 END, 6) AS rain, round(k, 6) AS pm10, round(value, 6) AS pm25,
  round(value * 2, 6) AS carbon_monoxide, round(k / 2, 6) AS nitrogen_dioxide, 1.0 AS sulphur_dioxide,
  round(value / 2, 6) AS ozone
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def q_normalize_current(spark, sf):
    _utc(spark)
    out = PL.normalize_current(_current_payloads(spark, sf))
    return rounded(out.select("event_id", "date", *_CUR_COLS))


# ----------------------------------------------------------------- IO8
def _forecast_docs(spark, sf) -> DataFrame:
    ev = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    item = F.struct("ts", "event_id", "value", k.alias("k"))

    def weather(r):
        return F.struct(
            F.date_format(r["ts"], "yyyy-MM-dd HH:mm:ss").alias("dt_txt"),
            F.struct((r["value"] + KELVIN_OFFSET).alias("temp"), r["k"].alias("humidity"),
                     (F.lit(1000.0) + r["k"]).alias("pressure")).alias("main"),
            F.struct((r["value"] / 10).alias("speed")).alias("wind"),
            F.struct(r["k"].alias("all")).alias("clouds"),
            F.when(r["k"] > 50, F.create_map(F.lit("3h"), r["k"] / 10)).alias("rain"))

    def air(r):
        return F.struct(F.create_map(F.lit("pm2_5"), r["value"], F.lit("pm10"), r["k"], F.lit("co"), r["value"] * 2,
                                     F.lit("no2"), r["k"] / 2, F.lit("so2"), F.lit(1.0), F.lit("o3"), r["value"] / 2)
                        .alias("components"))
    # one forecast document per (station, day): a bounded group, in time order
    g = ev.groupBy(F.col("event_type").alias("station"), F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_list(item)).alias("_r"))
    return g.select("station", "day",
                    F.to_json(F.struct(F.transform("_r", weather).alias("list"))).alias("forecast"),
                    F.to_json(F.struct(F.transform("_r", air).alias("list"))).alias("air"))


@register("forecast_slots", f"""SELECT station, strftime(day, '%Y-%m-%d') AS day, CAST(pos AS INTEGER) AS pos,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS date,
  round((value + CAST({KELVIN_OFFSET!r} AS DOUBLE)) - CAST({KELVIN_OFFSET!r} AS DOUBLE), 6) AS temperature,
  round(k, 6) AS humidity, round(1000.0 + k, 6) AS pressure, round(value / 10, 6) AS wind_speed,
  round(CASE WHEN k > 50 THEN k / 10 ELSE 0.0 END, 6) AS rain, round(k, 6) AS clouds,
  round(k, 6) AS pm10, round(value, 6) AS pm25, round(value * 2, 6) AS carbon_monoxide,
  round(k / 2, 6) AS nitrogen_dioxide, 1.0 AS sulphur_dioxide, round(value / 2, 6) AS ozone
FROM (SELECT *, event_type AS station, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS pos FROM events)
WHERE pos IN (7, 15, 23)""")
def q_forecast_slots(spark, sf):
    out = PL.forecast_slots(_forecast_docs(spark, sf), key=("station", "day"))
    return rounded(out, exclude=("pos",))


# ----------------------------------------------------------------- IO9 / IO10
def _hourly(ev, ingest_shift_days: int, scale: float) -> DataFrame:
    return ev.select(F.col("event_type").alias("series_key"), F.to_date("ts").alias("date"),
                     F.hour("ts").cast("bigint").alias("hour"), (F.col("value") * scale).alias("aqi"), "event_id",
                     (F.col("ts") + F.expr(f"INTERVAL {ingest_shift_days} DAYS")).alias("ingested_at"))


@register("upsert_features", """WITH b1 AS (SELECT event_type AS series_key, CAST(ts AS DATE) AS date, hour(ts) AS hour,
  value AS aqi, event_id, ts AS ingested_at FROM events WHERE ts < TIMESTAMP '2024-01-20'),
b2 AS (SELECT event_type AS series_key, CAST(ts AS DATE) AS date, hour(ts) AS hour, value * 2 AS aqi, event_id,
  ts + INTERVAL 30 DAY AS ingested_at FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, CAST(hour AS BIGINT) AS hour, round(aqi, 6) AS aqi, event_id
FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)
QUALIFY row_number() OVER (PARTITION BY series_key, date, hour ORDER BY ingested_at DESC, event_id DESC) = 1""")
def q_upsert_features(spark, sf):
    path = scratch_path(spark, "feature-table")
    ev = B.table(spark, sf, "events")
    order = ("ingested_at", "event_id")
    FT.upsert_features(spark, _hourly(ev.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")), 0, 1.0),
                       path, order=order)
    batch2 = _hourly(ev.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")), 30, 2.0)
    FT.upsert_features(spark, batch2, path, order=order)
    FT.upsert_features(spark, batch2, path, order=order)  # a retried batch changes nothing
    out = FT.read_features(spark, path, order=order)
    return rounded(out.select("series_key", "date", "hour", "aqi", "event_id"))


@register("read_features", """SELECT event_type AS series_key, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date,
  CAST(hour(ts) AS BIGINT) AS hour, round(value, 6) AS aqi, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), hour(ts) ORDER BY ts DESC, event_id DESC) = 1""")
def q_read_features(spark, sf):
    path = scratch_path(spark, "feature-table")
    ev = B.table(spark, sf, "events")
    _hourly(ev, 0, 1.0).write.mode("overwrite").partitionBy("date").parquet(path)  # raw appended rows
    out = FT.read_features(spark, path, order=("ingested_at", "event_id"))
    return rounded(out.select("series_key", "date", "hour", "aqi", "event_id"))


# ----------------------------------------------------------------- IO14
@register("append_history", """SELECT event_type AS series_key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id,
  round(value, 6) AS value FROM events WHERE value >= 1.0""")
def q_append_history(spark, sf):
    path = scratch_path(spark, "history")
    ev = B.table(spark, sf, "events").where(F.col("value") >= B.USABLE_MIN).select(
        F.col("event_type").alias("series_key"), "ts", "event_id", "value")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    IOF.append_history(ev.where(F.col("ts") < cut), path, 1)
    for _ in range(2):  # a retried batch changes nothing
        IOF.append_history(ev.where(F.col("ts") >= cut), path, 2)
    h = IOF.read_history(spark, path, "series_key string, ts timestamp_ntz, event_id bigint, value double")
    return rounded(h.select("series_key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                            "event_id", "value"))


# ----------------------------------------------------------------- IO4 / IO13 / M11 / P13 / M19 / IO15
_CANDS = ("persistence", "mean_7")
_KIND = {"persistence": "naive", "mean_7": "smoothing"}


def baseline_metrics(spark, sf) -> DataFrame:
    """(horizon, candidate, cand_order, mae, rmse, r2) of two baseline
    forecasters per horizon over the daily series (pooled)."""
    d = _daily(spark, sf).select("series_key", "date", "y")
    d = W.rolling_mean_incl(d, "y", [7], fmt="mean_7")
    d = W.leads(d, "y", (1, 2, 3), fmt="lead_{k}")
    parts = []
    for hname, h in (("day1", 1), ("day2", 2), ("day3", 3)):
        for ci, (cand, col) in enumerate((("persistence", "y"), ("mean_7", "mean_7"))):
            parts.append(d.select(F.lit(hname).alias("horizon"), F.lit(cand).alias("candidate"),
                                  F.lit(ci).alias("cand_order"), F.col(f"lead_{h}").alias("actual"),
                                  F.col(col).alias("pred")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    m = S.regression_metrics(u, "actual", "pred", ["horizon", "candidate", "cand_order"])
    return m.drop("n")


_BASE_SQL = _DAILY_ONLY + """, b AS (SELECT series_key, date, y,
  CASE WHEN count(y) OVER w7 = 7 THEN avg(y) OVER w7 END AS mean_7,
  lead(y, 1) OVER w AS l1, lead(y, 2) OVER w AS l2, lead(y, 3) OVER w AS l3 FROM daily
  WINDOW w AS (PARTITION BY series_key ORDER BY date),
         w7 AS (PARTITION BY series_key ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
u AS (""" + " UNION ALL ".join(
    f"SELECT '{h}' AS horizon, '{c}' AS candidate, {ci} AS cand_order, l{hi} AS actual, {col} AS pred FROM b"
    for hi, h in ((1, "day1"), (2, "day2"), (3, "day3")) for ci, (c, col) in enumerate((("persistence", "y"), ("mean_7", "mean_7")))) + """),
m AS (SELECT horizon, candidate, cand_order, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) * (actual - pred))) AS rmse,
  1 - avg((actual - pred) * (actual - pred)) / var_pop(actual) AS r2 FROM u
  WHERE actual IS NOT NULL AND pred IS NOT NULL GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY mae, cand_order) = 1 AS is_champion FROM m)"""


def _docs(spark, sf):
    m = baseline_metrics(spark, sf)
    from aerocast.operators.setops import argmin_group
    champ = argmin_group(m, ["horizon"], "mae", ["cand_order"]).select("horizon", F.col("candidate").alias("champion"),
                                                                       "mae", "rmse", "r2")
    kinds = F.create_map(*[x for c, k in _KIND.items() for x in (F.lit(c), F.lit(k))])
    comp_rows = m.groupBy("horizon").agg(F.map_from_entries(F.collect_list(F.struct(
        "candidate", F.struct("mae", "rmse", "r2")))).alias("candidates"))  # <= candidates per horizon
    comp_rows = comp_rows.join(champ.select("horizon", "champion"), "horizon")
    comp_doc = PL.to_json_doc(comp_rows, "horizon", F.struct("candidates", "champion"))
    man_doc = PL.to_json_doc(champ, "horizon", F.struct(
        F.col("champion").alias("model_type"), kinds[F.col("champion")].alias("kind"),
        F.lit(False).alias("is_delta"), "mae", "rmse", "r2",
        F.lit("Baselines scored on levels of the daily series.").alias("evaluation")))
    return comp_doc, man_doc, m


@register("comparison_table", _BASE_SQL + """
SELECT horizon, candidate, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, is_champion FROM c""")
def q_comparison_table(spark, sf):
    comp_doc, _, _ = _docs(spark, sf)
    path = scratch_path(spark, "comparison")
    MIO.write_manifest(comp_doc, path)
    return rounded(PL.comparison_table(MIO.read_doc(spark, path)))


_MAN_SEL = """horizon, candidate AS model_type, CASE candidate WHEN 'persistence' THEN 'naive' ELSE 'smoothing' END AS kind,
  false AS is_delta, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2"""


def _manifest(spark, sf):
    _, man_doc, _ = _docs(spark, sf)
    path = scratch_path(spark, "manifest")
    MIO.write_manifest(man_doc, path)
    return PL.scan_manifest(MIO.read_doc(spark, path))


@register("scan_manifest", _BASE_SQL + f" SELECT {_MAN_SEL} FROM c WHERE is_champion")
def q_scan_manifest(spark, sf):
    return rounded(_manifest(spark, sf).select("horizon", "model_type", "kind", "is_delta", "mae", "rmse", "r2"))


@register("route_by_kind", _BASE_SQL + f" SELECT {_MAN_SEL} FROM c WHERE is_champion AND candidate = 'mean_7'")
def q_route_by_kind(spark, sf):
    from aerocast.operators.schema import route_by_kind
    m = route_by_kind(_manifest(spark, sf), "smoothing")
    return rounded(m.select("horizon", "model_type", "kind", "is_delta", "mae", "rmse", "r2"))


@register("horizon_view", _BASE_SQL + """ SELECT c.horizon, c.candidate AS model_type, round(c.mae, 6) AS mae,
  round(c.rmse, 6) AS rmse, round(c.r2, 6) AS r2, n.candidates FROM c JOIN
  (SELECT horizon, count(*) AS candidates FROM m GROUP BY horizon) n USING (horizon) WHERE c.is_champion""")
def q_horizon_view(spark, sf):
    from aerocast.plans.tournament import horizon_view
    comp_doc, man_doc, _ = _docs(spark, sf)
    p1, p2 = scratch_path(spark, "manifest"), scratch_path(spark, "comparison")
    MIO.write_manifest(man_doc, p1)
    MIO.write_manifest(comp_doc, p2)
    hv = horizon_view(PL.scan_manifest(MIO.read_doc(spark, p1)), PL.comparison_table(MIO.read_doc(spark, p2)))
    return rounded(hv)


@register("run_log", _BASE_SQL + """ SELECT horizon || '_' || candidate AS name, CAST(v AS INTEGER) AS version,
  round(mae, 6) AS mae FROM m, (SELECT 1 AS v UNION ALL SELECT 2)""")
def q_run_log(spark, sf):
    path = scratch_path(spark, "runs")
    m = baseline_metrics(spark, sf)
    rec = m.select(F.concat_ws("_", "horizon", "candidate").alias("name"), "mae", "rmse", "r2")
    for run_id, ts in ((1, "2024-02-01 00:00:00"), (2, "2024-02-02 00:00:00")):
        for _ in range(run_id):  # the second run is retried and makes no new version
            MIO.append_run(rec.withColumns({"logged_at": F.lit(ts), "run_id": F.lit(run_id).cast("bigint")}), path, run_id)
    out = MIO.run_log(spark, path)
    return rounded(out.select("name", "version", "mae"), exclude=("version",))


# ----------------------------------------------------------------- IO16
@register("model_store", _DAILY_ONLY + """, lg AS (SELECT *, lag(y, 1) OVER (PARTITION BY series_key ORDER BY date) AS x FROM daily),
wt AS (SELECT *, exp(-CAST(0.6931471805599453 AS DOUBLE) * CAST(date_diff('day', date, (SELECT max(date) FROM lg WHERE x IS NOT NULL)) AS DOUBLE) / 75.0) AS weight
  FROM lg WHERE x IS NOT NULL),
s AS (SELECT sum(weight * x) / sum(weight) AS xb, sum(weight * y) / sum(weight) AS yb, stddev_pop(x) AS sd FROM wt),
c AS (SELECT sum(weight * (x - xb) * (x - xb)) AS cxx, sum(weight * (x - xb) * (y - yb)) AS cxy, any_value(xb) AS xb,
  any_value(yb) AS yb, any_value(sd) AS sd FROM wt, s),
b AS (SELECT ((cxy / sd) / (cxx / (sd * sd) + 10.0)) / sd AS beta, xb, yb FROM c)
SELECT series_key, strftime(date, '%Y-%m-%d') AS date, round((yb - xb * beta) + x * beta, 4) AS pred FROM wt, b""")
def q_model_store(spark, sf):
    from aerocast.plans import folds as FO
    from aerocast.plans import ridge as RG
    d = W.lags(_daily(spark, sf).select("series_key", "date", "y"), "y", [1]).withColumnRenamed("y_lag_1", "x")
    d = FO.recency_weights(d.where(F.col("x").isNotNull()), "date", 75.0).withColumn("block", F.lit(0))
    icpt, beta = RG.fit_ridge(RG.block_gramians(d, ["x"], "y", "weight"), 10.0, 1)
    path = scratch_path(spark, "model")
    MIO.save_ridge(spark, {"intercept": icpt, "coef": list(beta), "features": ["x"], "alpha": 10.0}, path)
    model = MIO.load_ridge(spark, path)
    pred = F.lit(model["intercept"]) + F.col("x") * F.lit(model["coef"][0])
    return rounded(d.select("series_key", "date", F.round(pred, 4).alias("pred")))


# ----------------------------------------------------------------- IO17
def _band_sql(v):
    parts = [f"WHEN {v} <= {u} THEN '{lab}'" if u is not None else f"ELSE '{lab}'" for u, lab, _ in AQI_BANDS]
    return "CASE " + " ".join(parts) + " END"


_ALERTS_SQL = f"""SELECT logged_at, forecast_date, predicted_aqi, threshold, status FROM (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, strftime(ts, '%Y-%m-%d') AS forecast_date,
    CAST(round(CAST(value AS DECIMAL(18,6)), 1) AS DOUBLE) AS predicted_aqi, CAST(150 AS BIGINT) AS threshold,
    {_band_sql('value')} AS status, event_id FROM events WHERE value >= 150)
QUALIFY row_number() OVER (PARTITION BY forecast_date, predicted_aqi ORDER BY logged_at, event_id) = 1"""


def _alerts(spark, sf):
    ev = B.table(spark, sf, "events").where(F.col("value") >= 150)
    new = ev.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
                    F.date_format("ts", "yyyy-MM-dd").alias("forecast_date"),
                    F.round("value", 1).alias("predicted_aqi"), F.lit(150).cast("bigint").alias("threshold"),
                    R.aqi_band("value").alias("status"), F.struct(
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_id").alias("_o"))
    path = scratch_path(spark, "alert-log")
    # three rounds on one log, the second one retried; later rounds hold keys of earlier ones
    early = F.col("logged_at") < "2024-01-16"
    for batch, rows in ((1, new.where(early)), (2, new), (2, new), (3, new.where(~early))):
        IOF.append_alerts(rows, path, batch, first_by="_o")
    return path


@register("alert_log", _ALERTS_SQL)
def q_alert_log(spark, sf):
    return IOF.read_alert_log(spark, _alerts(spark, sf))


@register("alert_log_cleared", f"SELECT * FROM ({_ALERTS_SQL}) WHERE false")
def q_alert_log_cleared(spark, sf):
    path = _alerts(spark, sf)
    IOF.clear_alert_log(spark, path)
    return IOF.read_alert_log(spark, path)
