"""Structured Streaming operators.

Sources are file streams over a landing folder; every sink is a
``foreachBatch`` that writes each micro-batch idempotently (its own
``batch=<id>`` folder, overwritten on retry, or a keyed upsert), so a
restarted query from its checkpoint never double-writes. Event time must be
``timestamp`` (watermarks reject ``timestamp_ntz``), the session zone UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerocast.session import scratch_path
from aerocast.sources import feature_table as FT


def land(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a batch of readings into the landing folder of a stream."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def _batch_writer(path: str):
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def run_to_folder(sdf: DataFrame, out_path: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Run a streaming frame to completion (``availableNow``) into a folder,
    one idempotent sub-folder per micro-batch."""
    spark = sdf.sparkSession
    q = (sdf.writeStream.outputMode(mode).foreachBatch(_batch_writer(out_path))
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_ingest(spark: SparkSession, sdf: DataFrame, table_path: str, key: Sequence[str],
                  order: Sequence[str], partition: str = "date", checkpoint: str | None = None) -> None:
    """ST1: hourly readings stream -> keyed upsert (IO10) per micro-batch."""
    def upsert(batch: DataFrame, batch_id: int):
        FT.upsert_features(batch.sparkSession, batch, table_path, key=key, order=order, partition=partition)
    q = (sdf.writeStream.outputMode("append").foreachBatch(upsert)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_dedup(sdf: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """ST2: drop repeats of a key arriving within the allowed lateness."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_daily(sdf: DataFrame, key: str, ts: str, cols: Sequence[str], delay: str = "2 hours") -> DataFrame:
    """ST3: tumbling one-day mean per series; a window is emitted once the
    watermark passes its end, later rows for it are dropped."""
    g = sdf.withWatermark(ts, delay).groupBy(F.col(key), F.window(ts, "1 day").alias("w"))
    return g.agg(*[F.avg(c).alias(c) for c in cols], F.count(F.lit(1)).alias("n")).select(
        key, F.to_date(F.col("w.start")).alias("date"), *cols, "n")


def stream_latest(sdf: DataFrame, key: str, ts: str, cols: Sequence[str]) -> DataFrame:
    """ST4: latest reading per series as a streaming ``max_by`` aggregate
    (update mode: only changed series are emitted per batch)."""
    return sdf.groupBy(key).agg(F.max_by(F.struct(ts, *cols), F.col(ts)).alias("_l")).select(key, "_l.*")


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


def _as_before(sdf: DataFrame, before: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    return sdf.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in before.schema.fields], *more)


def first_of_each(sdf: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Each key once, however far apart its repeats come: the earliest row (by ``ts``) of the trigger that brings it.

    The keys seen live in the query's state store, so a trigger reads and writes the states of its own keys, whatever
    was logged before. Null keys are one key; of rows equal in ``ts`` the smallest as text counts."""
    keys, names = list(keys), sdf.columns
    # columns pass through Python as strings, so integers with nulls and times come back unchanged
    text = sdf.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.to_json(F.struct(*keys)).alias("_key"),
                      *[F.col(c).cast("string").alias(c) for c in names])

    def first(key, frames, state):
        import pandas as pd
        best = None
        for frame in frames:
            best = pd.concat([frame] if best is None else [best, frame]).sort_values(["_at", *names], na_position="last").iloc[:1]
        if best is not None and not state.exists:
            state.update((True,))
            yield best[names]

    ddl = ", ".join(f"`{c}` string" for c in names)
    return _as_before(text.groupBy("_key").applyInPandasWithState(first, ddl, "seen boolean", "append", "NoTimeout"), sdf)


def stream_alerts(sdf: DataFrame, value: str, threshold: float, keys: Sequence[str], out_path: str, ts: str = "ts",
                  checkpoint: str | None = None) -> None:
    """ST5: readings at or above the threshold, each alert key once (``first_of_each``); every micro-batch writes its
    own folder, replaced on a retry. The keys logged are the state of the query, kept beside the log unless a
    checkpoint is named; a log whose checkpoint is gone is refused, as its alerts would come out again."""
    from aerocast.sources.files import _exists, append_batch
    spark, checkpoint = sdf.sparkSession, checkpoint or f"{out_path.rstrip('/')}.state"
    if _exists(spark, out_path) and not _exists(spark, checkpoint):
        raise ValueError(f"{out_path} holds alerts, but its state {checkpoint} is gone")
    fresh = first_of_each(sdf.where(F.col(value) >= threshold), keys, ts)
    _finish(fresh.writeStream.outputMode("append").foreachBatch(lambda batch, i: append_batch(batch, out_path, i))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def with_ingest_lags(sdf: DataFrame, value: str, key: str, order: Sequence[str]) -> DataFrame:
    """ST1: the lag features of ``online_lags`` at ingest time, inside the stream.

    The state of a key is its last three observations and their number; a trigger's rows are taken in ``order``, after
    all that earlier triggers brought (a late row so gets the lags of its arrival). Nulls and NaN are no observations.
    A task holds the rows that one trigger brings for one key: bound them by the source's files per trigger."""
    import numpy as np
    order, names = list(order), sdf.columns
    lags = [f"{value}_lag_1", f"{value}_lag_2", f"{value}_lag_3", f"{value}_rolling_mean_3", f"{value}_change"]
    # places within the trigger's rows of a key come from the order columns as numbers or text that sorts alike
    numbers = {f"_o{i}": F.unix_micros(F.col(c).cast("timestamp")) if sdf.schema[c].dataType.simpleString().startswith(("timestamp", "date"))
               else F.col(c).cast("double") if sdf.schema[c].dataType.simpleString() in ("double", "float") else F.col(c) for i, c in enumerate(order)}
    text = sdf.withColumns({**numbers, "_v": F.col(value).cast("double")}).select(
        *[F.col(c).cast("string").alias(c) for c in names], *numbers, "_v")

    places = list(numbers)

    def lagged(k, frames, state):
        import pandas as pd
        rows = pd.concat(list(frames)).sort_values(places, kind="stable", na_position="first")
        *last, n = state.get if state.exists else (None, None, None, 0)
        old = [x for x in last if x is not None]  # oldest first
        v = rows["_v"].to_numpy(dtype=float)
        seen = ~np.isnan(v)
        seq = np.concatenate((np.zeros(3), old, v[seen]))
        before = np.cumsum(seen) - seen
        at = 3 + len(old) + before
        some = lambda i: np.where(len(old) + before >= i, seq[at - i], 0.0)
        one, two, three = some(1), some(2), some(3)
        rolling = np.where(n + before >= 3, (one + two + three) / 3.0, one)
        tail = [float(x) for x in seq[3:][-3:]]
        state.update((*[None] * (3 - len(tail)), *tail, int(n + seen.sum())))
        yield rows[names].assign(**dict(zip(lags, (one, two, three, rolling, one - two))))

    ddl = ", ".join([*(f"`{c}` string" for c in names), *(f"`{c}` double" for c in lags)])
    out = text.groupBy(key).applyInPandasWithState(lagged, ddl, "a double, b double, c double, n long", "append", "NoTimeout")
    return _as_before(out, sdf, lags)


# --- ST4 sink: one delta folder per trigger, merged on read --------------------
def _versions(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """number -> folder of the finished ``kind=<number>`` folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        return {}
    folders = [f.getPath().toString() for f in fs.listStatus(hadoop(path)) if f.getPath().getName().startswith(f"{kind}=")]
    return {int(f.rsplit("=", 1)[1]): f for f in folders if fs.exists(hadoop(f"{f}/_SUCCESS"))}


def _bytes(spark: SparkSession, folders: Sequence[str]) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(hadoop(f).getFileSystem(conf).getContentSummary(hadoop(f)).getLength() for f in folders)


def _live(spark: SparkSession, path: str) -> tuple[list[str], list[str], int]:
    """(newest base, deltas after it, number of the base or -1)."""
    bases, deltas = _versions(spark, path, "base"), _versions(spark, path, "batch")
    top = max(bases, default=-1)
    return [bases[top]] if bases else [], [f for i, f in sorted(deltas.items()) if i > top], top


def read_latest(spark: SparkSession, path: str, key: str, ts: str) -> DataFrame:
    """The newest row of every key: base and deltas merged by one aggregate (a key is in few of them)."""
    base, deltas, _ = _live(spark, path.rstrip("/"))
    rows = spark.read.parquet(*base, *deltas)
    rest = [c for c in rows.columns if c not in (key, ts)]
    return rows.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("_r")).select(key, "_r.*").select(*rows.columns)


def compact_latest(spark: SparkSession, path: str, key: str, ts: str) -> None:
    """Base and deltas become one base, numbered as its last delta. What the base before it replaced is removed only
    now, so a reader that has listed the folders has them for one more generation; a lost run leaves what was there."""
    path = path.rstrip("/")
    _, deltas, top = _live(spark, path)
    if not deltas:
        return
    upto = max(_versions(spark, path, "batch"))
    read_latest(spark, path, key, ts).write.mode("overwrite").parquet(f"{path}/base={upto}")
    for kind, last in (("base", top - 1), ("batch", top)):
        for i, folder in _versions(spark, path, kind).items():
            if i <= last:
                FT._remove(spark, folder)


def run_latest(spark: SparkSession, sdf: DataFrame, table_path: str, key: str, ts: str,
               checkpoint: str | None = None) -> None:
    """ST4 sink: every update-mode batch is one delta folder (replaced on a retry), read by ``read_latest``. Once the
    deltas hold as many bytes as the base they are merged, so what is written grows with the batches."""
    path = table_path.rstrip("/")

    def log(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        base, deltas, _ = _live(spark, path)
        if len(deltas) > 1 and _bytes(spark, deltas) >= _bytes(spark, base):
            compact_latest(spark, path, key, ts)
    _finish(sdf.writeStream.outputMode("update").foreachBatch(log)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
            .trigger(availableNow=True).start())
