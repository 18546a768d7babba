"""Profile per event-time window: batch twin and Structured Streaming job.

Batch: the exact frequency-table profile with the window start as an extra
grouping key.
Streaming: a windowed aggregation straight over the cells (no per-value
state, which would grow with the distinct values), with
``approx_count_distinct`` for the distinct count.  It runs in update mode:
every micro-batch writes the windows that it changed, and the latest write of
a window counts.  So no window waits for a later event to close it, and
without a watermark rows of any lateness count; a watermark bounds the state
by dropping rows that are later.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions.predicates import is_number_like, is_present
from qualitas.operators import cells as C
from qualitas.operators import profile as P
from qualitas.operators.windows import latest_per_key

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def windowed_profile(df: DataFrame, ts_col: str, window: str = "1 day", columns=None) -> DataFrame:
    """Exact per-window column profile: rows, nulls, distinct, numeric min/max/mean, negatives.

    One frequency table keyed by (window, column, value) and ONE aggregation
    per (window, column) for all statistics.
    """
    cols = [c for c in (columns or df.columns) if c != ts_col]
    keyed = df.withColumn("window_start", F.window(F.col(ts_col), window).start).drop(ts_col)
    facts = C.facts_of(keyed, cols, by=["window_start"])
    present = F.col("present")
    f = facts.select("window_start", "column_name", "n", "present", *P.numeric_inputs(facts))
    out = f.groupBy("window_start", "column_name").agg(
        F.sum("n").cast("bigint").alias("row_count"),
        (F.sum("n") - F.sum(F.when(present, F.col("n")).otherwise(F.lit(0)))).cast("bigint").alias("null_count"),
        F.count_if(present).cast("bigint").alias("unique_count"),
        *P.named(P.numeric_aggregates()))
    return out.select(
        F.date_format("window_start", ISO).alias("window_start"), "column_name", "row_count", "null_count",
        "unique_count", "min_value", "max_value", "mean",
        F.coalesce("negative_count", F.lit(0).cast("bigint")).alias("negative_count"))


def stream_profile(stream: DataFrame, ts_col: str, window: str = "1 day", watermark: str | None = None,
                   columns=None) -> DataFrame:
    """Streaming per-window profile, to be written in update mode."""
    cols = [c for c in (columns or stream.columns) if c != ts_col]
    # watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read as wall clock in the session zone
    # (the window start is formatted back in the same zone, so the wall clock is kept)
    timed = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    if watermark:
        timed = timed.withWatermark(ts_col, watermark)
    at = F.window(F.col(ts_col), window)
    # without a watermark the window is its start, a plain column, before the unpivot
    keyed = timed.withColumn("_window", at if watermark else at.start).drop(ts_col)
    cells = C.cells(keyed, cols, by=["_window"])
    v = F.col("value")
    cells = cells.select("_window", "column_name", F.when(is_present(v), v).alias("v"),
                         F.when(is_present(v) & is_number_like(v), v.try_cast("double")).alias("x"))
    start = F.col("_window.start") if watermark else F.col("_window")
    return (cells.groupBy("_window", "column_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("v").alias("present_count"),
        F.approx_count_distinct("v").alias("approx_distinct"),
        F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.avg("x").alias("mean"),
        F.count_if(F.col("x") < 0).alias("negative_count"))
        .select(F.date_format(start, ISO).alias("window_start"), "column_name", "row_count",
                (F.col("row_count") - F.col("present_count")).alias("null_count"),
                "approx_distinct", "min_value", "max_value", "mean", "negative_count"))


def as_pattern(path: str) -> str:
    """``path`` as a pattern that matches itself only: the file stream source takes a single file just so, and a
    folder either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stream_profile_to_history(spark, source_path: str, schema, ts_col: str, history_path: str, checkpoint: str,
                              window: str = "1 day", watermark: str | None = None, columns=None, dataset_name=None,
                              available_now: bool = True, files_per_batch: int | None = None):
    """Append the changed windows of each micro-batch to a parquet history table; ``source_path`` is the table's path.

    ``foreachBatch`` writes each micro-batch into its own ``batch_id``
    partition with dynamic partition overwrite, so a batch replayed after a
    failure replaces its own output instead of duplicating it (exactly-once
    with the checkpointed offsets).  Read the result with ``latest_windows``.
    """
    name = dataset_name or source_path

    def write(batch_df, batch_id):
        (batch_df.withColumn("dataset_name", F.lit(name)).withColumn("batch_id", F.lit(int(batch_id)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(history_path))

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (stream_profile(reader.parquet(as_pattern(source_path)), ts_col, window, watermark, columns).writeStream
              .outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def latest_windows(history: DataFrame) -> DataFrame:
    """The last state of every window and column of a history table."""
    keyed = history.withColumn("_key", F.struct("dataset_name", "window_start", "column_name"))
    return latest_per_key(keyed, "_key", "batch_id").drop("_key", "batch_id")
