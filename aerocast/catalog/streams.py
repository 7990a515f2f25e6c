"""Registered streaming queries: each lands ``events`` into a folder, runs
the stream to completion with ``availableNow`` and returns the read-back of
its sink; the oracle is the equivalent batch SQL (closed windows only for the
windowed mean, keys only where the stream may keep an arbitrary duplicate)."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerocast import bindings as B
from aerocast.catalog.registry import register, rounded
from aerocast.catalog.tables import HIST_LAGS
from aerocast.session import scratch_path
from aerocast.sources import feature_table as FT
from aerocast.streaming import ingest as ST

_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, station string, value double, date date, hour bigint"


def _landed(spark, sf, files: int | None = None) -> str:
    ev = B.table(spark, sf, "events")
    rows = ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                     F.col("event_type").alias("station"), "value", F.to_date("ts").alias("date"),
                     F.hour("ts").cast("bigint").alias("hour"))
    path = scratch_path(spark, "landing")
    # several files of consecutive times: one micro-batch each with maxFilesPerTrigger=1
    ST.land(rows.repartitionByRange(files, "ts") if files else rows, path)
    return path


@register("stream_ingest", """SELECT event_type AS station, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date,
  CAST(hour(ts) AS BIGINT) AS hour, event_id, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), hour(ts) ORDER BY ts DESC, event_id DESC) = 1""")
def q_stream_ingest(spark, sf):
    src = ST.read_stream(spark, _landed(spark, sf, files=3), _SCHEMA, max_files=1)
    table = scratch_path(spark, "stream-table")
    ST.stream_ingest(spark, src, table, key=("station", "date", "hour"), order=("ts", "event_id"))
    out = FT.read_features(spark, table, key=("station", "date", "hour"), order=("ts", "event_id"))
    return rounded(out.select("station", "date", "hour", "event_id", "value"))


@register("stream_ingest_lags", f"""WITH {HIST_LAGS}
SELECT station, event_id, round(coalesce(p1, 0.0), 6) AS v_lag_1, round(coalesce(p2, 0.0), 6) AS v_lag_2,
  round(coalesce(p3, 0.0), 6) AS v_lag_3,
  round(CASE WHEN n >= 3 THEN (p1 + p2 + p3) / 3.0 ELSE coalesce(p1, 0.0) END, 6) AS v_rolling_mean_3,
  round(coalesce(p1, 0.0) - coalesce(p2, 0.0), 6) AS v_change
FROM h3""")
def q_stream_ingest_lags(spark, sf):
    """The lags of online_lags at ingest time: three landings in the order of time, the query restarted for each."""
    rows = spark.read.schema(_SCHEMA).parquet(_landed(spark, sf)).withColumn("v", F.when(F.col("value") >= B.USABLE_MIN, F.col("value")))
    rows = rows.select("station", "event_id", "ts", "v")
    cuts = [None, *rows.select(F.unix_micros("ts").cast("double").alias("t")).stat.approxQuantile("t", [0.4, 0.7], 0.05), None]
    landing, out, checkpoint = (scratch_path(spark, f"lags-{n}") for n in ("landing", "out", "checkpoint"))
    t = F.unix_micros("ts").cast("double")
    for lo, hi in zip(cuts, cuts[1:]):
        ST.land(rows.where((F.lit(True) if lo is None else t >= lo) & (F.lit(True) if hi is None else t < hi)), landing)
        lagged = ST.with_ingest_lags(ST.read_stream(spark, landing, rows.schema), "v", "station", ["ts", "event_id"])
        ST.run_to_folder(lagged, out, checkpoint=checkpoint)
    got = spark.read.parquet(out)
    return rounded(got.select("station", "event_id", "v_lag_1", "v_lag_2", "v_lag_3", "v_rolling_mean_3", "v_change"))


@register("stream_dedup", """SELECT DISTINCT event_type AS station, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour
FROM events""")
def q_stream_dedup(spark, sf):
    src = ST.read_stream(spark, _landed(spark, sf), _SCHEMA)
    src = src.withColumn("hour_start", F.date_trunc("hour", "ts"))
    out = scratch_path(spark, "stream-dedup")
    ST.run_to_folder(ST.stream_dedup(src, ["station", "hour_start"], "ts", "2 hours"), out)
    got = spark.read.parquet(out)
    return got.select("station", F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss").alias("hour"))


@register("stream_daily", """WITH mx AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events)
SELECT event_type AS station, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, round(avg(value), 6) AS value, count(*) AS n
FROM events, mx GROUP BY event_type, CAST(ts AS DATE), wm HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= wm""")
def q_stream_daily(spark, sf):
    src = ST.read_stream(spark, _landed(spark, sf), _SCHEMA)
    out = scratch_path(spark, "stream-daily")
    ST.run_to_folder(ST.stream_daily(src, "station", "ts", ["value"], "2 hours"), out)
    return rounded(spark.read.parquet(out).select("station", "date", "value", "n"))


@register("stream_latest", """SELECT event_type AS station, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(value, 6) AS value
FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1""")
def q_stream_latest(spark, sf):
    src = ST.read_stream(spark, _landed(spark, sf, files=4), _SCHEMA, max_files=1)
    table = scratch_path(spark, "stream-latest")
    ST.run_latest(spark, ST.stream_latest(src, "station", "ts", ["value"]), table, "station", "ts")
    got = ST.read_latest(spark, table, "station", "ts")
    return rounded(got.select("station", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value"))


@register("stream_alerts", """SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS forecast_date,
  CAST(round(CAST(value AS DECIMAL(18,6)), 1) AS DOUBLE) AS predicted_aqi FROM events WHERE value >= 150""")
def q_stream_alerts(spark, sf):
    src = ST.read_stream(spark, _landed(spark, sf, files=6), _SCHEMA, max_files=1)
    src = src.withColumns({"forecast_date": F.date_format("ts", "yyyy-MM-dd"),
                           "predicted_aqi": F.round("value", 1)})
    out = scratch_path(spark, "stream-alerts")
    ST.stream_alerts(src, "value", 150, ["forecast_date", "predicted_aqi"], out)
    return spark.read.parquet(out).select("forecast_date", "predicted_aqi")
