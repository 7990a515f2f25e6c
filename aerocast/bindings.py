"""Bindings of the driver tables to the library's inputs.

* readings  - lineitem rows as raw sensor readings of three series
              (``l_returnflag``); ``x4`` is a sparse sensor that only reports
              when ``l_discount >= 0.09``, so daily means have real gaps.
* orders    - daily order series per ``o_orderpriority`` (gaps within keys).
* stations  - events as station readings: ``event_type`` is the station,
              alphabetical order is its priority, ``value`` the reading; a
              reading below 1.0 counts as "no usable value".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARSE_DISCOUNT = 0.09
USABLE_MIN = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_key, ts, y, x1, x2, x3, x4) - one row per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("series_key"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("y"),
        F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"),
        F.col("l_tax").alias("x3"),
        F.when(F.col("l_discount") >= SPARSE_DISCOUNT, F.col("l_quantity")).alias("x4"),
    )


READINGS_SQL = f"""
SELECT l_returnflag AS series_key, l_shipdate AS ts, l_extendedprice AS y,
       l_quantity AS x1, l_discount AS x2, l_tax AS x3,
       CASE WHEN l_discount >= {SPARSE_DISCOUNT} THEN l_quantity END AS x4
FROM lineitem"""


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_key, date, n_orders, total_price) - daily orders per priority."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_key"),
                      F.to_date("o_orderdate").alias("date"))
            .agg(F.count(F.lit(1)).alias("n_orders"),
                 F.avg("o_totalprice").alias("total_price")))


ORDER_SERIES_SQL = """
SELECT o_orderpriority AS series_key, CAST(o_orderdate AS DATE) AS date,
       count(*) AS n_orders, avg(o_totalprice) AS total_price
FROM orders GROUP BY 1, 2"""


def station_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, priority) - alphabetical order over the distinct stations.

    The ranking runs over the de-duplicated station set (a dimension: one row
    per station), never over readings.
    """
    ev = table(spark, sf_dir, "events")
    st = ev.select(F.col("event_type").alias("station")).distinct()
    return st.withColumn("priority", (F.expr("rank() OVER (ORDER BY station)") - 1).cast("bigint"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station readings with priority attached from the station dimension."""
    ev = table(spark, sf_dir, "events")
    pr = station_priority(spark, sf_dir)
    rd = ev.select(
        "event_id", "ts", "user_id",
        F.col("event_type").alias("station"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    return rd.join(pr, "station")


STATIONS_SQL = """
(SELECT e.event_id, e.ts, e.user_id, e.event_type AS station, e.value,
        CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k, p.priority
 FROM events e JOIN (SELECT station, CAST(rank() OVER (ORDER BY station) - 1 AS BIGINT) AS priority
                     FROM (SELECT DISTINCT event_type AS station FROM events)) p
   ON e.event_type = p.station)"""
