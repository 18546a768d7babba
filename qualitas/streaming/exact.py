"""Exact profile per event-time window over a stream: distinct values are counted, late cells are kept, state ends.

Cells are counted by value within each Arrow batch before the shuffle, so a value that fills a batch travels as one
row; a window's column is dealt into ``parts`` groups by a hash of the value, so no window and column needs one task.
Each group is a keyed state (``transformWithState``): its totals, and a map of the values seen, by key (a long value's
key is its beginning and a digest).  A timer at the window's end, in event time, writes the group's totals and clears
both; the watermark is ``lateness`` behind the latest event.  Cells that come after that aren't dropped but written
to a table of late cells with their counts.  So state holds the distinct values of open windows only.

Equal values share a group, so a window's distinct count is the sum of its groups'.  Windows that no later event has
closed are still in the state and not in the table.  Rows without an event time belong to no window and are left out,
as in the batch twin's windows.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from qualitas.functions.predicates import is_number_like, is_present
from qualitas.operators import cells as C
from qualitas.streaming.windowed import ISO, as_pattern

_TOTALS = "row_count long, present_count long, unique_count long, min_value double, max_value double, total double, negative_count long"
_OUT = f"start_ms long, column_name string, part int, late_value string, {_TOTALS}"
#: Groups that the values of one window and column are dealt into.
PARTS = 8


def _counted(batches):
    """Equal cells of a batch as one row with their number."""
    names = ["start_ms", "end_ms", "column_name", "part", "key", "x"]
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by(names).aggregate([([], "count_all")])
            counted = table.rename_columns(["n" if c == "count_all" else c for c in table.column_names])
            yield from counted.select([*names, "n"]).to_batches()


class _Window(StatefulProcessor):
    """The state of one window, column and part."""

    def init(self, handle) -> None:
        self._handle = handle
        self._totals = handle.getValueState("totals", _TOTALS)
        self._seen = handle.getMapState("seen", "key string", "n long")

    def handleInputRows(self, key, rows, timerValues):
        start, end, column, part = key
        if end <= timerValues.getCurrentWatermarkInMs():                # closed: its totals are written already
            late: dict = {}
            for r in rows:
                late[r.key] = late.get(r.key, 0) + r.n
            for value, n in late.items():
                yield self._row(start, column, part, value, (n, n if value is not None else 0, None, None, None, None, None))
            return
        if self._totals.exists():
            count, present, unique, least, most, total, negative = self._totals.get()
        else:
            count, present, unique, least, most, total, negative = 0, 0, 0, None, None, 0.0, 0
            self._handle.registerTimer(end)
        fresh = set()
        for r in rows:
            count += r.n
            if r.key is None:
                continue
            present += r.n
            if r.key not in fresh and not self._seen.containsKey((r.key,)):
                self._seen.updateValue((r.key,), (1,))
                unique += 1
            if len(fresh) < 100_000:                               # spares lookups; the state decides
                fresh.add(r.key)
            if r.x is not None:
                least = r.x if least is None else min(least, r.x)
                most = r.x if most is None else max(most, r.x)
                total += r.x * r.n
                negative += r.n * (r.x < 0)
        self._totals.update((count, present, unique, least, most, total, negative))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        start, _, column, part = key
        if self._totals.exists():
            yield self._row(start, column, part, None, tuple(self._totals.get()))
        self._totals.clear()
        self._seen.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def _row(start, column, part, late, totals):
        return Row("start_ms", "column_name", "part", "late_value", "row_count", "present_count", "unique_count",
                   "min_value", "max_value", "total", "negative_count")(start, column, part, late, *totals)


def exact_stream(stream: DataFrame, ts_col: str, window: str = "1 day", lateness: str = "1 hour", columns=None,
                 parts: int = PARTS) -> DataFrame:
    """Closed windows' totals by column and part, and late cells (``unique_count`` null), to be appended."""
    cols = [c for c in (columns or stream.columns) if c != ts_col]
    at = F.window(F.col(ts_col), window)
    timed = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, lateness)
    # plain numbers: late cells must reach the state and not be dropped by their event time
    timed = timed.where(F.col(ts_col).isNotNull()).withColumn("_w", at).select(
        F.unix_millis("_w.start").alias("start_ms"), F.unix_millis("_w.end").alias("end_ms"), *[F.col(f"`{c}`") for c in cols])
    v = F.col("value")
    cells = C.cells(timed, cols, by=["start_ms", "end_ms"]).withColumn("value", F.when(is_present(v), v))
    keyed = cells.select("start_ms", "end_ms", "column_name",
                         F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int").alias("part"), C.value_key(v).alias("key"),
                         F.when(is_number_like(v), v.try_cast("double")).alias("x"))
    counted = keyed.mapInArrow(_counted, "start_ms long, end_ms long, column_name string, part int, key string, x double, n long")
    return counted.groupBy("start_ms", "end_ms", "column_name", "part").transformWithState(
        statefulProcessor=_Window(), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


#: The state store that keyed state needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def exact_profile_to_history(spark, source_path: str, schema, ts_col: str, history_path: str, checkpoint: str,
                             window: str = "1 day", lateness: str = "1 hour", columns=None, parts: int = PARTS,
                             available_now: bool = True, files_per_batch: int | None = None):
    """Append closed windows and late cells to a parquet table; read it with ``closed_windows`` and ``late_cells``.

    A micro-batch writes its own partition, and a replay replaces it.  The session's state store is set to RocksDB.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch_df, batch_id):
        (batch_df.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(history_path))

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    writer = (exact_stream(reader.parquet(as_pattern(source_path)), ts_col, window, lateness, columns, parts)
              .writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def closed_windows(history: DataFrame) -> DataFrame:
    """The profile of every closed window, in the columns of the batch twin."""
    total = F.when(F.col("min_value").isNotNull(), F.col("total"))
    exact = total.try_cast("decimal(24,6)")                            # its sum doesn't depend on the parts' order
    return (history.where("unique_count IS NOT NULL").groupBy("start_ms", "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum(F.col("row_count") - F.col("present_count")).alias("null_count"),
        F.sum("unique_count").alias("unique_count"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.when(F.count(exact) == F.count(total), F.sum(exact).cast("double")).otherwise(F.sum(total)).alias("total"),
        F.sum("negative_count").alias("negative_count"))
        .withColumn("window_start", F.date_format(F.timestamp_millis("start_ms"), ISO)).drop("start_ms"))


def late_cells(history: DataFrame) -> DataFrame:
    """Cells that came after their window was closed: the value's key (null: missing) and their number."""
    return (history.where("unique_count IS NULL").groupBy("start_ms", "column_name", F.col("late_value").alias("value"))
            .agg(F.sum("row_count").alias("cells"))
            .withColumn("window_start", F.date_format(F.timestamp_millis("start_ms"), ISO)).drop("start_ms"))
