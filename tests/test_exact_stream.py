"""The exact stream against its batch twin: unordered files, a restart, late rows, state freed."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from qualitas.sources.tables import table
from qualitas.streaming.exact import closed_windows, exact_profile_to_history, late_cells
from qualitas.streaming.windowed import windowed_profile

ZONE = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _add(df, folder, name):
    """One part file; files are read in the order of their times."""
    df.coalesce(1).write.mode("append").parquet(f"{folder}-{name}")
    part, = [f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet")]
    os.makedirs(folder, exist_ok=True)
    os.link(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


def test_exact_stream_equals_batch_after_a_restart_with_late_rows(spark):
    out = tempfile.mkdtemp(prefix="qualitas-exact-")
    source = f"{out}/events"
    events = table(spark, SF001, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    span = (high - low) / 4
    days = (high - low).days // 2 + 2                                  # as far as the files are out of order
    before = lambda k: events.where(F.col("ts") < F.lit(low + k * span))
    early, later = before(2), events.where(F.col("ts") >= F.lit(low + 2 * span))

    def run():
        query = exact_profile_to_history(spark, source, events.schema, "ts", f"{out}/history", f"{out}/checkpoint",
                                         lateness=f"{days} days", files_per_batch=1, parts=3)
        query.awaitTermination()
        return query

    for i, share in enumerate(early.randomSplit([0.5, 0.5], 7)):       # each file has all times of its part
        _add(share.orderBy(F.rand(1)), source, f"a{i}")
    assert run().lastProgress.stateOperators[0].numRowsTotal > 0       # open windows stay in the checkpoint
    _add(later.orderBy(F.rand(2)), source, "b")
    end = later.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days + 10} DAYS"))
    _add(end, source, "c")                                             # closes all windows before it
    run()                                                              # goes on from the checkpoint
    closed = {(r.window_start, r.column_name): r for r in closed_windows(spark.read.parquet(f"{out}/history")).collect()}
    batch = {(r.window_start, r.column_name): r for r in windowed_profile(events, "ts", "1 day").collect()}
    assert set(closed) == set(batch)
    for k, b in batch.items():
        r = closed[k]
        assert (r.row_count, r.null_count, r.unique_count, r.min_value, r.max_value, r.negative_count) == (
            b.row_count, b.null_count, b.unique_count, b.min_value, b.max_value, b.negative_count), k
        if b.mean is not None:
            assert abs(r.total - b.mean * (b.row_count - b.null_count)) <= 1e-6 * max(1.0, abs(r.total))
    assert late_cells(spark.read.parquet(f"{out}/history")).count() == 0

    _add(before(1), source, "d")                                       # all of it is late
    query = run()
    after = spark.read.parquet(f"{out}/history")
    assert {(r.window_start, r.column_name): r for r in closed_windows(after).collect()} == closed
    late = {(r.window_start, r.column_name, r.value): r.cells for r in late_cells(after).where("column_name = 'event_type'").collect()}
    want = {(r.w, "event_type", r.event_type): r["count"] for r in before(1).groupBy(
        F.date_format(F.window(F.col("ts").cast("timestamp"), "1 day").start, ZONE).alias("w"), "event_type").count().collect()}
    assert late == want
    left = query.lastProgress.stateOperators[0].numRowsTotal           # the window of the last event only
    assert left <= 3 * 10 * (len(events.columns) - 1)
