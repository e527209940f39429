"""Structured Streaming versions of the additive dashboard metrics (a Spark-user extra: the
reference refreshes by polling; these keep the same numbers current incrementally).

``windowed_kpis`` is a watermarked tumbling-window aggregation (state is bounded by the
watermark); ``run_to_table`` drives a stream to a Parquet table in the shared checkpoint
folder through ``foreachBatch`` (exactly-once per batch id with an idempotent overwrite of the
batch's output), so executor or driver restarts resume from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def stream_parquet(spark: SparkSession, directory: str, schema, glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over a directory (new files are picked up as they land); ``glob`` keeps
    only matching file names."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def _event_time(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock (NTZ) event times are read in the session zone."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        return events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events


def windowed_kpis(events: DataFrame, ts: str = "ts", value: str = "value", key: str | None = "event_type",
                  window: str = "1 day", watermark: str = "1 hour", user: str | None = None) -> DataFrame:
    """Per tumbling window (and key): event count, value sum / mean / max and, if ``user`` names a column, its distinct
    values by a sketch that merges across batches (exact distinct counts are not supported in streaming
    aggregations). In update and append mode the watermark drops the state of windows that have closed."""
    w = _event_time(events, ts).withWatermark(ts, watermark)
    keys = [F.window(ts, window).alias("w")] + ([F.col(key)] if key else [])
    g = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("value_sum"),
                             F.avg(value).alias("value_avg"), F.max(value).alias("value_max"),
                             *([F.approx_count_distinct(user, 0.02).alias("users")] if user else []))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *([F.col(key)] if key else []), "events", "value_sum", "value_avg", "value_max", *(["users"] if user else []))


def windowed_sla(events: DataFrame, ts: str, duration: str, promise: float = 10.0, grace: float = 2.0,
                 window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """J01 over a stream: on-time share and mean duration per tumbling window."""
    w = _event_time(events, ts).withWatermark(ts, watermark)
    g = w.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(duration).alias("avg"),
        (F.avg((F.col(duration) <= promise + grace).cast("double")) * 100.0).alias("on_time_pct"))
    return g.select(F.col("w.start").alias("window_start"), "n", "avg", "on_time_pct")


def run_to_table(stream: DataFrame, name: str, output_mode: str = "update", path: str | None = None,
                 checkpoint: str | None = None, available_now: bool = True,
                 state_partitions: int | None = None) -> DataFrame:
    """Run ``stream`` (until the available input is processed when ``available_now``) writing
    each micro-batch to Parquet under the shared checkpoint folder; returns the result table.

    ``complete`` mode rewrites the table per batch; ``update`` / ``append`` add one directory
    per batch id (re-running a batch id overwrites that directory: idempotent)."""
    spark = stream.sparkSession
    out = path or scratch_path(spark, f"stream-{name}")
    ckpt = checkpoint or scratch_path(spark, f"stream-ckpt-{name}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        if output_mode == "complete":
            batch.write.mode("overwrite").parquet(f"{out}/current")
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt).foreachBatch(sink)
    # the state-store partition count is fixed when a checkpoint is first created; by default
    # size it to the cluster's parallelism instead of the batch shuffle setting
    parts = state_partitions or spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        q = (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    if available_now:
        q.awaitTermination()
    else:
        q.processAllAvailable()
        q.stop()
    if output_mode == "complete":
        return spark.read.parquet(f"{out}/current")
    return spark.read.parquet(out)


def latest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse an update-mode history (one directory per batch id) to the row of the latest
    batch per key: the current value of every window."""
    vals = [c for c in updates.columns if c not in keys and c != "batch"]
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch").alias("_v"))
    return latest.select(*keys, "_v.*")
