"""Registered queries for rules, schema, joins, sort/set operators and the
station-reading operators, bound to events / orders / lineitem / dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerocast import bindings as B
from aerocast.catalog.registry import register, rounded
from aerocast.catalog.series import DAILY_SQL, _daily
from aerocast.config import AQI_BANDS, CITY_CENTRE, GUIDANCE, KELVIN_OFFSET, LIMIT_COLOURS, MIN_HISTORY_ROWS, \
    POLLUTANT_LIMITS, WEEKDAY_NAMES
from aerocast.functions import calendar as C
from aerocast.functions import rules as R
from aerocast.operators import joins as J
from aerocast.operators import schema as P
from aerocast.operators import setops as SO
from aerocast.operators import windows as W

EV = "(SELECT * FROM events)"
ST = B.STATIONS_SQL


def _band_sql(v, table, pick):
    parts = []
    for row in table:
        if row[0] is None:
            parts.append(f"ELSE '{row[pick]}'")
        else:
            parts.append(f"WHEN {v} <= {row[0]} THEN '{row[pick]}'")
    return f"CASE WHEN {v} IS NULL THEN NULL " + " ".join(parts) + " END"


def _ds(c):
    return f"strftime({c}, '%Y-%m-%d')"


# ----------------------------------------------------------------- F4 / F5 / F6
@register("aqi_band", f"""SELECT event_id, round(value, 6) AS value,
  {_band_sql('value', AQI_BANDS, 1)} AS band, {_band_sql('value', AQI_BANDS, 2)} AS colour,
  {_band_sql('value', GUIDANCE, 1)} AS guidance_level, {_band_sql('value', GUIDANCE, 2)} AS guidance
FROM events""")
def q_aqi_band(spark, sf):
    ev = B.table(spark, sf, "events")
    return rounded(ev.select("event_id", "value", R.aqi_band("value").alias("band"),
                             R.aqi_color("value").alias("colour"),
                             R.guidance_level("value").alias("guidance_level"),
                             R.guidance_text("value").alias("guidance")))


# ----------------------------------------------------------------- F7
_LIM_SQL = ", ".join(
    f"round(least(CAST(100.0 AS DOUBLE), value / {lim} * CAST(100.0 AS DOUBLE)), 6) AS pct_{name}, "
    f"CASE WHEN least(CAST(100.0 AS DOUBLE), value / {lim} * CAST(100.0 AS DOUBLE)) < 60 THEN '{LIMIT_COLOURS[0]}' "
    f"WHEN least(CAST(100.0 AS DOUBLE), value / {lim} * CAST(100.0 AS DOUBLE)) < 100 THEN '{LIMIT_COLOURS[1]}' "
    f"ELSE '{LIMIT_COLOURS[2]}' END AS colour_{name}"
    for name, lim in POLLUTANT_LIMITS)


@register("limit_pct", f"SELECT event_id, {_LIM_SQL} FROM events")
def q_limit_pct(spark, sf):
    ev = B.table(spark, sf, "events")
    cols = []
    for name, lim in POLLUTANT_LIMITS:
        pct = R.limit_pct("value", F.lit(lim))
        cols += [pct.alias(f"pct_{name}"), R.limit_colour(pct).alias(f"colour_{name}")]
    return rounded(ev.select("event_id", *cols))


# ----------------------------------------------------------------- F8
@register("units_time", f"""SELECT event_id, round(value - CAST({KELVIN_OFFSET!r} AS DOUBLE), 6) AS celsius,
  strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS utc_text,
  {_ds('ts')} AS date_text, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s
FROM events""")
def q_units_time(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the library pins UTC
    ev = B.table(spark, sf, "events")
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rounded(ev.select("event_id", R.kelvin_to_c("value").alias("celsius"),
                             R.epoch_to_text(epoch).alias("utc_text"),
                             R.date_text(F.to_date("ts")).alias("date_text"), epoch.alias("epoch_s")))


# ----------------------------------------------------------------- F9
@register("clean_strings", """SELECT event_id,
  regexp_replace(trim('  @' || event_type || ' '), '^@+', '') AS station_id,
  replace('day' || CAST(length(event_type) AS VARCHAR), 'day', 'Day ') AS label
FROM events""")
def q_clean_strings(spark, sf):
    ev = B.table(spark, sf, "events")
    raw_id = F.concat(F.lit("  @"), F.col("event_type"), F.lit(" "))
    label = F.concat(F.lit("day"), F.length("event_type").cast("string"))
    return ev.select("event_id", R.clean_station_id(raw_id).alias("station_id"),
                     R.horizon_label(label).alias("label"))


# ----------------------------------------------------------------- F11 / F12 / F13
@register("live_diff", """SELECT event_id,
  round(value - CASE WHEN value >= 1.0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 6) AS diff
FROM events""")
def q_live_diff(spark, sf):
    ev = B.table(spark, sf, "events")
    live = F.when(F.col("value") >= B.USABLE_MIN, F.get_json_object("props", "$.k").cast("double"))
    return rounded(ev.select("event_id", R.live_diff("value", live).alias("diff")))


@register("default_chain", """SELECT event_id,
  round(coalesce(TRY_CAST(CASE WHEN value >= 1.0 THEN CAST(value AS VARCHAR) ELSE '-' END AS DOUBLE),
                 TRY_CAST(CASE WHEN user_id > 75 THEN json_extract_string(props, '$.k') ELSE 'n/a' END AS DOUBLE),
                 CAST(0.0 AS DOUBLE)), 6) AS chosen
FROM events""")
def q_default_chain(spark, sf):
    ev = B.table(spark, sf, "events")
    live = F.when(F.col("value") >= B.USABLE_MIN, F.col("value").cast("string")).otherwise(F.lit("-"))
    base = F.when(F.col("user_id") > 75, F.get_json_object("props", "$.k")).otherwise(F.lit("n/a"))
    return rounded(ev.select("event_id", R.default_chain(live, base, default=0.0).alias("chosen")))


@register("geo_default", f"""SELECT event_id,
  round(coalesce(CASE WHEN value >= 1.0 THEN value END, CAST({CITY_CENTRE[0]!r} AS DOUBLE)), 6) AS lat,
  round(coalesce(CASE WHEN value >= 1.0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END,
                 CAST({CITY_CENTRE[1]!r} AS DOUBLE)), 6) AS lon
FROM events""")
def q_geo_default(spark, sf):
    ev = B.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    geo = F.when(F.col("value") >= B.USABLE_MIN, F.array(F.col("value"), k)).otherwise(
        F.array().cast("array<double>"))
    return rounded(ev.select("event_id", R.geo_default(geo, 0).alias("lat"), R.geo_default(geo, 1).alias("lon")))


# ----------------------------------------------------------------- F1 / F2 / F3
_DAILY_ONLY = "WITH " + DAILY_SQL + " "


@register("calendar", _DAILY_ONLY + """SELECT series_key, strftime(date, '%Y-%m-%d') AS date,
  CAST(year(date) AS BIGINT) AS year, CAST(month(date) AS BIGINT) AS month, CAST(day(date) AS BIGINT) AS day,
  CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend
FROM daily""")
def q_calendar(spark, sf):
    d = C.calendar(_daily(spark, sf).select("series_key", "date"), "date", with_year=True)
    return rounded(d)


_TP = "CAST(6.283185307179586 AS DOUBLE)"


@register("cyclic", _DAILY_ONLY + f"""SELECT series_key, strftime(date, '%Y-%m-%d') AS date,
  round(sin({_TP} * month(date) / 12), 6) AS month_sin, round(cos({_TP} * month(date) / 12), 6) AS month_cos,
  round(sin({_TP} * (isodow(date) - 1) / 7), 6) AS dow_sin, round(cos({_TP} * (isodow(date) - 1) / 7), 6) AS dow_cos
FROM daily""")
def q_cyclic(spark, sf):
    d = C.cyclic(C.calendar(_daily(spark, sf).select("series_key", "date"), "date"))
    return rounded(d.select("series_key", "date", "month_sin", "month_cos", "dow_sin", "dow_cos"))


_NAMES = ", ".join(f"'{n}'" for n in sorted(WEEKDAY_NAMES))


@register("dayname_codes", _DAILY_ONLY + f"""SELECT series_key, strftime(date, '%Y-%m-%d') AS date,
  dayname(date) AS day_name, CAST(list_position([{_NAMES}], dayname(date)) - 1 AS BIGINT) AS day_name_code
FROM daily""")
def q_dayname_codes(spark, sf):
    d = C.dayname_codes(_daily(spark, sf).select("series_key", "date"), "date")
    return rounded(d)


# ----------------------------------------------------------------- P1 / P2 / P3 / P8 / P10
_P1 = {"l_shipdate": "date", "l_extendedprice": "price", "l_quantity": "quantity", "l_discount": "discount",
       "l_tax": "tax", "l_returnflag": "flag", "l_linestatus": "status", "l_orderkey": "order_key"}


@register("project_rename", "SELECT " + ", ".join(
    (f"strftime({o}, '%Y-%m-%d %H:%M:%S') AS {n}" if o == "l_shipdate" else f"{o} AS {n}") for o, n in _P1.items())
    + " FROM lineitem")
def q_project_rename(spark, sf):
    d = P.project_rename(B.table(spark, sf, "lineitem"), _P1)
    return d.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


_DCOLS = ["y", "x1", "x2", "x3", "x4"]
_DSEL = "series_key, strftime(date, '%Y-%m-%d') AS date, " + ", ".join(f"round({c}, 6) AS {c}" for c in _DCOLS)


@register("drop_null_target", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily WHERE x4 IS NOT NULL")
def q_drop_null_target(spark, sf):
    return rounded(P.drop_null_target(_daily(spark, sf), ["x4"]))


@register("drop_null_rows", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in _DCOLS))
def q_drop_null_rows(spark, sf):
    return rounded(P.drop_null_rows(_daily(spark, sf), _DCOLS))


@register("fill_defaults", _DAILY_ONLY + "SELECT series_key, strftime(date, '%Y-%m-%d') AS date, "
          + ", ".join(f"round(coalesce({c}, 0.0), 6) AS {c}" for c in _DCOLS)
          + ", CAST(0.0 AS DOUBLE) AS x5 FROM daily")
def q_fill_defaults(spark, sf):
    return rounded(P.fill_defaults(_daily(spark, sf), [*_DCOLS, "x5"]))


@register("require_columns", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily")
def q_require_columns(spark, sf):
    return rounded(P.require_columns(_daily(spark, sf), _DCOLS).select("series_key", "date", *_DCOLS))


# ----------------------------------------------------------------- P4 / P5 / P6 / P9
_ALIGN = {"value": "double", "user_id": "bigint", "day": "date", "event_type": "string", "k": "float64",
          "event_id": "int64"}


@register("align_schema", """SELECT CAST(event_id AS BIGINT) AS event_id, round(value, 6) AS value,
  CAST(user_id AS BIGINT) AS user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type,
  round(TRY_CAST(CASE WHEN value >= 1.0 THEN json_extract_string(props, '$.k') ELSE 'x' || json_extract_string(props, '$.k') END AS DOUBLE), 6) AS k
FROM events""")
def q_align_schema(spark, sf):
    ev = B.table(spark, sf, "events")
    text = ev.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("value"),
        (F.col("user_id").cast("double") + 0.25).cast("string").alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type",
        F.when(F.col("value") >= B.USABLE_MIN, F.get_json_object("props", "$.k"))
        .otherwise(F.concat(F.lit("x"), F.get_json_object("props", "$.k"))).alias("k"))
    return rounded(P.align_schema(text, _ALIGN))


@register("coerce_numeric", """SELECT event_id, round(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) AS k,
  TRY_CAST(event_type AS DOUBLE) AS event_type FROM events""")
def q_coerce_numeric(spark, sf):
    ev = B.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return rounded(P.coerce_numeric(ev, ["k", "event_type"]))


@register("truncate_int", "SELECT event_id, CAST(trunc(value - 100.0) AS BIGINT) AS value FROM events")
def q_truncate_int(spark, sf):
    ev = B.table(spark, sf, "events").select("event_id", (F.col("value") - 100.0).alias("value"))
    return P.truncate_int(ev, ["value"])


@register("threshold_filter", "SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE value >= 150")
def q_threshold_filter(spark, sf):
    ev = B.table(spark, sf, "events").select("event_id", "event_type", "value")
    return rounded(P.threshold_filter(ev, "value", 150))


# ----------------------------------------------------------------- P7 / J1 / J2 / J3
_ORD_DAILY = ("ord AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders, avg(o_totalprice) AS total_price "
              "FROM orders GROUP BY 1)")


def _ord_daily(spark, sf):
    o = B.table(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("total_price"))


@register("join_daily", "WITH " + DAILY_SQL + ", " + _ORD_DAILY + """
SELECT d.series_key, strftime(d.date, '%Y-%m-%d') AS date, round(d.y, 6) AS y, o.n_orders, round(o.total_price, 6) AS total_price
FROM daily d JOIN ord o ON d.date = o.date""")
def q_join_daily(spark, sf):
    j = J.join_daily(_daily(spark, sf).select("series_key", "date", "y"), _ord_daily(spark, sf), "date")
    return rounded(j)


@register("join_loss", "WITH " + DAILY_SQL + ", " + _ORD_DAILY + """
SELECT CAST((SELECT count(*) FROM daily d WHERE NOT EXISTS (SELECT 1 FROM ord o WHERE o.date = d.date)) AS BIGINT) AS left_unmatched,
       CAST((SELECT count(*) FROM ord o WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE o.date = d.date)) AS BIGINT) AS right_unmatched,
       CAST((SELECT count(*) FROM daily) AS BIGINT) AS left_rows, CAST((SELECT count(*) FROM ord) AS BIGINT) AS right_rows""")
def q_join_loss(spark, sf):
    return J.join_loss(_daily(spark, sf), _ord_daily(spark, sf), "date")


@register("map_lookup", "WITH " + DAILY_SQL + ", " + _ORD_DAILY + """
SELECT d.series_key, strftime(d.date, '%Y-%m-%d') AS date, round(o.total_price, 6) AS base_pred
FROM daily d LEFT JOIN ord o ON d.date = o.date""")
def q_map_lookup(spark, sf):
    j = J.map_lookup(_daily(spark, sf).select("series_key", "date"), _ord_daily(spark, sf), ["date"],
                     "total_price", "base_pred")
    return rounded(j)


@register("backfill_rows", "WITH " + DAILY_SQL + ", " + _ORD_DAILY + """
SELECT strftime(d.date, '%Y-%m-%d') AS date, CAST(0 AS BIGINT) AS hour, CAST(day(d.date) AS BIGINT) AS day,
  CAST(month(d.date) AS BIGINT) AS month, CAST(year(d.date) AS BIGINT) AS year,
  CAST(isodow(d.date) - 1 AS BIGINT) AS day_of_week, d.series_key AS city,
  round(d.x1, 6) AS x1, round(d.x2, 6) AS x2, round(o.total_price, 6) AS total_price,
  0.0 AS aqi_lag_1, 0.0 AS aqi_lag_2, 0.0 AS aqi_lag_3, 0.0 AS aqi_rolling_mean_3, 0.0 AS aqi_change,
  round(d.y, 6) AS aqi
FROM daily d JOIN ord o ON d.date = o.date""")
def q_backfill_rows(spark, sf):
    j = J.join_daily(_daily(spark, sf).select("series_key", "date", "x1", "x2", F.col("y").alias("aqi")),
                     _ord_daily(spark, sf).select("date", "total_price"), "date")
    out = P.backfill_rows(j.withColumnRenamed("series_key", "city"))
    return rounded(out)


# ----------------------------------------------------------------- P11 / P12
@register("require_history", """WITH pd AS (SELECT l_partkey AS part, CAST(l_shipdate AS DATE) AS date,
  avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2)
SELECT part, strftime(date, '%Y-%m-%d') AS date, round(y, 6) AS y FROM pd
WHERE part IN (SELECT part FROM pd GROUP BY part HAVING count(DISTINCT date) >= """ + str(MIN_HISTORY_ROWS) + ")")
def q_require_history(spark, sf):
    li = B.table(spark, sf, "lineitem")
    pd_ = li.groupBy(F.col("l_partkey").alias("part"), F.to_date("l_shipdate").alias("date")).agg(
        F.avg("l_extendedprice").alias("y"))
    return rounded(P.require_history(pd_, "part", MIN_HISTORY_ROWS))


@register("numeric_only", "SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer")
def q_numeric_only(spark, sf):
    cu = B.table(spark, sf, "customer")
    from aerocast.operators.stats import numeric_columns
    return rounded(cu.select(*numeric_columns(cu)))


# ----------------------------------------------------------------- J4 / J5 / J6 / J7
@register("zip_positional", """SELECT l.event_type AS station, l.pos, l.event_id AS left_id, r.event_id AS right_id
FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events) l
JOIN (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS pos FROM events) r
ON l.event_type = r.event_type AND l.pos = r.pos""")
def q_zip_positional(spark, sf):
    ev = B.table(spark, sf, "events").withColumnRenamed("event_type", "station")
    left = ev.select("station", F.col("event_id").alias("left_id"), "ts")
    right = ev.select("station", F.col("event_id").alias("right_id"), "value")
    z = J.zip_positional(left, right, "station", ["ts", "left_id"], [F.desc("value"), "right_id"])
    return z.select("station", F.col("pos").cast("bigint").alias("pos"), "left_id", "right_id")


@register("zip_positional_time", """SELECT l.user_id, l.pos, l.event_id AS click_id, r.event_id AS purchase_id
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
      FROM events WHERE event_type = 'click') l
JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
      FROM events WHERE event_type = 'purchase') r
ON l.user_id = r.user_id AND l.pos = r.pos""")
def q_zip_positional_time(spark, sf):
    """i-th click of a user paired with the user's i-th purchase, numbered per
    (user, day) with carried offsets (skew-safe positions)."""
    ev = B.table(spark, sf, "events")
    day = F.to_date("ts")
    left = ev.where(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("click_id"), "ts")
    right = ev.where(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("purchase_id"),
                                                               F.col("ts").alias("pts"))
    z = J.zip_positional(left, right, "user_id", ["ts", "click_id"], ["pts", "purchase_id"], day, F.to_date("pts"))
    return z.select("user_id", F.col("pos").cast("bigint").alias("pos"), "click_id", "purchase_id")


@register("join_asof", """SELECT l.event_id, l.user_id, strftime(l.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
  CAST(r.event_id AS DOUBLE) AS r_event_id, round(r.value, 6) AS r_value, strftime(r.ts, '%Y-%m-%d %H:%M:%S.%f') AS r_ts
FROM (SELECT * FROM events WHERE event_type = 'click') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r
  ON l.user_id = r.user_id AND l.ts >= r.ts""")
def q_join_asof(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = B.table(spark, sf, "events")
    left = ev.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    right = ev.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    j = J.join_asof(left, right, "user_id", "ts", "ts", ["event_id", "value"])
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rounded(j.select("event_id", "user_id", F.date_format("ts", fmt).alias("ts"),
                            F.col("r_event_id").cast("double").alias("r_event_id"), "r_value",
                            F.date_format("r_ts", fmt).alias("r_ts")))


_ALERT_NEW = f"""(SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, strftime(ts, '%Y-%m-%d') AS forecast_date,
   CAST(round(CAST(value AS DECIMAL(18,6)), 1) AS DOUBLE) AS predicted_aqi, CAST(150 AS BIGINT) AS threshold, {_band_sql('value', AQI_BANDS, 1)} AS status, ts, event_id
 FROM events WHERE value >= 150)"""
_ALERT_LOG = f"""(SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, strftime(ts, '%Y-%m-%d') AS forecast_date,
   CAST(round(CAST(value AS DECIMAL(18,6)), 1) AS DOUBLE) AS predicted_aqi, CAST(200 AS BIGINT) AS threshold, {_band_sql('value', AQI_BANDS, 1)} AS status
 FROM events WHERE value >= 200 AND event_type = 'click')"""


@register("alert_antijoin", f"""WITH n AS {_ALERT_NEW}, lg AS {_ALERT_LOG},
fresh AS (SELECT logged_at, forecast_date, predicted_aqi, threshold, status FROM n
  QUALIFY row_number() OVER (PARTITION BY forecast_date, predicted_aqi ORDER BY logged_at, event_id) = 1)
SELECT * FROM lg UNION ALL
SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.forecast_date = f.forecast_date AND lg.predicted_aqi = f.predicted_aqi)""")
def q_alert_antijoin(spark, sf):
    ev = B.table(spark, sf, "events")

    def alerts(df, thr):
        return df.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("logged_at"),
                         F.date_format("ts", "yyyy-MM-dd").alias("forecast_date"),
                         F.round("value", 1).alias("predicted_aqi"), F.lit(thr).cast("bigint").alias("threshold"),
                         R.aqi_band("value").alias("status"), "event_id")
    new = alerts(P.threshold_filter(ev, "value", 150), 150)
    log = alerts(ev.where((F.col("value") >= 200) & (F.col("event_type") == "click")), 200).drop("event_id")
    order = F.struct("logged_at", "event_id")
    out = J.alert_antijoin(new.withColumn("_o", order).drop("event_id"), log, first_by="_o")
    return out


@register("station_dim", """SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_station_dim(spark, sf):
    s = B.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    n = B.table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = B.table(spark, sf, "region")
    out = J.enrich(J.enrich(s, n, "n_nationkey"), r, "r_regionkey")
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


# ----------------------------------------------------------------- L1 / L2 / L3 / L4 / SO1 / SO2
@register("sort_limit", _DAILY_ONLY + f"SELECT {_DSEL} FROM daily ORDER BY date DESC, series_key LIMIT 10")
def q_sort_limit(spark, sf):
    return rounded(SO.sort_limit(_daily(spark, sf), [F.desc("date"), "series_key"], 10))


@register("sort_multi", "SELECT event_type, event_id, round(value, 6) AS value FROM events ORDER BY event_type, value DESC")
def q_sort_multi(spark, sf):
    ev = B.table(spark, sf, "events").select("event_type", "event_id", "value")
    return rounded(SO.sort_multi(ev, ["event_type", F.desc("value")]))


@register("argmin_group", """SELECT event_type, event_id, user_id, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) = 1""")
def q_argmin_group(spark, sf):
    ev = B.table(spark, sf, "events").select("event_type", "event_id", "user_id", "value")
    return rounded(SO.argmin_group(ev, ["event_type"], "value", ["event_id"]))


@register("sample_seeded", """WITH a AS (SELECT event_id, event_type, value FROM events ORDER BY md5(event_id || '|42'), event_id LIMIT 150)
SELECT event_id, event_type, round(value, 6) AS value FROM a ORDER BY md5(event_id || '|7'), event_id LIMIT 50""")
def q_sample_seeded(spark, sf):
    ev = B.table(spark, sf, "events").select("event_id", "event_type", "value")
    return rounded(SO.sample_seeded(SO.sample_seeded(ev, ["event_id"], 150), ["event_id"], 50, seed=7))


@register("union_by_name", _DAILY_ONLY + f"""SELECT {_DSEL} FROM daily UNION ALL
SELECT series_key, strftime(date + 1, '%Y-%m-%d') AS date, round(y, 6) AS y, NULL AS x1, NULL AS x2, NULL AS x3, NULL AS x4
FROM daily QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY date DESC) = 1""")
def q_union_by_name(spark, sf):
    d = _daily(spark, sf)
    today = W.latest_row(d.select("series_key", "date", "y")).withColumn("date", F.date_add("date", 1))
    return rounded(SO.union_by_name(d, today))


@register("dedup_last", f"""SELECT station, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_id,
  round(value, 6) AS value FROM {ST}
QUALIFY row_number() OVER (PARTITION BY station, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1""")
def q_dedup_last(spark, sf):
    st = B.stations(spark, sf).withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))
    d = SO.dedup_last(st.select("station", "hour", "event_id", "value", "ts"), ["station", "hour"], ["ts", "event_id"])
    return rounded(d.drop("ts"))


# ----------------------------------------------------------------- W14 / W15 / W16 / W17
_HIST = f"""(SELECT station, event_id, ts, CASE WHEN value >= 1.0 THEN value END AS v FROM {ST})"""


def _hist(spark, sf):
    st = B.table(spark, sf, "events").withColumnRenamed("event_type", "station")
    return st.select("station", "event_id", "ts", F.when(F.col("value") >= B.USABLE_MIN, F.col("value")).alias("v"))


_HW = "PARTITION BY station ORDER BY ts, event_id"
_HB = f"OVER ({_HW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
HIST_LAGS = f"""h1 AS (SELECT *, last_value(v IGNORE NULLS) {_HB} AS p1, count(v) {_HB} AS n FROM {_HIST}),
h2 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p1 END IGNORE NULLS) {_HB} AS p2 FROM h1),
h3 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p2 END IGNORE NULLS) {_HB} AS p3 FROM h2)"""


@register("online_lags", f"""WITH {HIST_LAGS}
SELECT station, event_id, round(coalesce(p1, 0.0), 6) AS v_lag_1, round(coalesce(p2, 0.0), 6) AS v_lag_2,
  round(coalesce(p3, 0.0), 6) AS v_lag_3,
  round(CASE WHEN n >= 3 THEN (p1 + p2 + p3) / 3.0 ELSE coalesce(p1, 0.0) END, 6) AS v_rolling_mean_3,
  round(coalesce(p1, 0.0) - coalesce(p2, 0.0), 6) AS v_change
FROM h3""")
def q_online_lags(spark, sf):
    d = W.online_lags(_hist(spark, sf), "v", key="station", order=["ts", "event_id"])
    return rounded(d.select("station", "event_id", "v_lag_1", "v_lag_2", "v_lag_3", "v_rolling_mean_3", "v_change"))


@register("online_lags_cascade", f"""WITH {HIST_LAGS},
c AS (SELECT *, coalesce(p1, 0.0) AS l1, CASE WHEN n >= 2 THEN p2 ELSE coalesce(p1, 0.0) END AS l2 FROM h3)
SELECT station, event_id, round(l1, 6) AS v_lag_1, round(l2, 6) AS v_lag_2,
  round(CASE WHEN n >= 3 THEN p3 ELSE l2 END, 6) AS v_lag_3,
  round(CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN p1 WHEN n = 2 THEN (p1 + p2) / 2.0 ELSE (p1 + p2 + p3) / 3.0 END, 6) AS v_rolling_mean_3,
  round(CASE WHEN n < 2 THEN 0.0 ELSE l1 - l2 END, 6) AS v_trend
FROM c""")
def q_online_lags_cascade(spark, sf):
    d = W.online_lags_cascade(_hist(spark, sf), "v", key="station", order=["ts", "event_id"])
    return rounded(d.select("station", "event_id", "v_lag_1", "v_lag_2", "v_lag_3", "v_rolling_mean_3", "v_trend"))


@register("fallback_priority", f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, station, priority,
  event_id, round(value, 6) AS value FROM {ST} WHERE value >= 1.0
QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY priority, ts DESC, event_id DESC) = 1""")
def q_fallback_priority(spark, sf):
    st = B.stations(spark, sf).withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))
    st = st.withColumn("usable", F.col("value") >= B.USABLE_MIN)
    d = W.fallback_priority(st.select("hour", "station", "priority", "event_id", "value", "ts", "usable"),
                            "hour", "priority", "usable", order="ts", tiebreak="event_id")
    return rounded(d.select("hour", "station", "priority", "event_id", "value"))


@register("live_or_latest", f"""SELECT station, event_id, round(last_value(v IGNORE NULLS) OVER ({_HW}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v_or_latest FROM {_HIST}""")
def q_live_or_latest(spark, sf):
    d = W.live_or_latest(_hist(spark, sf), "v", key="station", order=["ts", "event_id"])
    return rounded(d.select("station", "event_id", "v_or_latest"))
