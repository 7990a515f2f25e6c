"""File sources and sinks.

All paths are expected under the shared folder of ``spark.checkpoint.dir``
(see ``aerocast.session.scratch_path``) or a cluster file system.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALERT_LOG_SCHEMA = T.StructType([
    T.StructField("logged_at", T.StringType()), T.StructField("forecast_date", T.StringType()),
    T.StructField("predicted_aqi", T.DoubleType()), T.StructField("threshold", T.LongType()),
    T.StructField("status", T.StringType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",",
             header: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """IO1: headered CSV with a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", mode).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """IO2: tab-separated scan."""
    return read_csv(spark, path, schema, sep="\t", header=header)


def read_json_array(spark: SparkSession, path: str, whole_file: bool = False,
                    element: str = "double") -> DataFrame:
    """IO3: JSON array documents -> (doc, pos, value).

    Default: one array per line (JSON Lines), so many documents are read in
    parallel; ``whole_file`` reads legacy pretty-printed single-document files
    (one file = one task). A missing path gives an empty typed frame.
    """
    schema = f"doc string, pos int, value {element}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    raw = spark.read.text(path, wholetext=whole_file)
    extra = [c for c in raw.columns if c != "value"]  # partition columns identify the document
    doc = F.input_file_name() if whole_file else F.col("value")
    arr = F.from_json(F.col("value"), f"array<{element}>")
    out = raw.select(*extra, doc.alias("doc"), F.posexplode(arr).alias("pos", "value"))
    return out.select(*extra, "doc", F.col("pos").cast("int"), "value")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """IO12: overwrite a CSV dataset (header in every part file)."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def append_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """IO11: append rows; a header is written with each new part file, so a
    headered read of the folder sees every row exactly once."""
    df.write.mode("append").option("header", True).option("sep", sep).csv(path)


def append_batch(df: DataFrame, path: str, batch_id: str | int) -> None:
    """Write a batch to its own ``batch=<id>`` folder; a retry of the batch replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def append_history(df: DataFrame, path: str, batch_id: str | int) -> None:
    """IO14: append observations to the history table. Idempotent per batch id;
    keys are ordinary columns, so "007" stays text."""
    append_batch(df, path, batch_id)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches with the declared schema; a missing path gives an empty typed frame."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    names = spark.createDataFrame([], schema).columns
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*names)


def read_alert_log(spark: SparkSession, path: str, without_batch: str | int | None = None) -> DataFrame:
    """IO17: the alert log, or a typed empty table when none exists yet; a batch
    that is being written again can be left out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ALERT_LOG_SCHEMA)
    names = [f.name for f in ALERT_LOG_SCHEMA.fields]
    log = spark.read.schema(T.StructType([*ALERT_LOG_SCHEMA.fields, T.StructField("batch", T.StringType())])) \
        .option("header", True).option("basePath", path).csv(path)
    if without_batch is not None:
        log = log.where(~F.col("batch").eqNullSafe(F.lit(str(without_batch))))
    return log.select(*names)


def append_alerts(new_alerts: DataFrame, path: str, batch_id: str | int,
                  keys: Sequence[str] = ("forecast_date", "predicted_aqi"), first_by: str = "logged_at") -> None:
    """IO17 / J6: log the alerts whose key no other batch has logged, in a folder
    of their own. Earlier batches are only read, never rewritten; a retry of a
    batch replaces its own folder and gives the same log."""
    from aerocast.operators.joins import fresh_alerts
    spark = new_alerts.sparkSession
    logged = read_alert_log(spark, path, without_batch=batch_id)
    fresh = fresh_alerts(new_alerts, logged, keys, first_by)
    fresh = fresh.select(*[f.name for f in ALERT_LOG_SCHEMA.fields])
    fresh.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/batch={batch_id}")


def clear_alert_log(spark: SparkSession, path: str) -> None:
    """IO17: clear = overwrite with an empty typed frame."""
    write_csv(spark.createDataFrame([], ALERT_LOG_SCHEMA), path)
