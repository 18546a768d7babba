"""Streaming windowed profile against its batch twin; plan shapes that matter at scale."""
import os
import tempfile

from conftest import SF001, SF01
from qualitas.operators import cells as C
from qualitas.operators import profile as P
from qualitas.sources.tables import table
from qualitas.streaming.windowed import latest_windows, stream_profile_to_history, windowed_profile


def _stream(spark, source, **options):
    out = tempfile.mkdtemp(prefix="qualitas-stream-")
    stream_profile_to_history(spark, source, table(spark, SF01, "events").schema, "ts", f"{out}/history",
                              f"{out}/checkpoint", **options).awaitTermination()
    return latest_windows(spark.read.parquet(f"{out}/history"))


def test_stream_matches_batch_on_every_window(spark):
    """A folder of part files out of time order, one a micro-batch, and the single file: all windows, the last too."""
    events = table(spark, SF01, "events")
    folder = os.path.join(tempfile.mkdtemp(prefix="qualitas-stream-src-"), "events.parquet")
    events.repartition(5, "user_id").write.parquet(folder)
    batch = {(r.window_start, r.column_name): r for r in windowed_profile(events, "ts", "1 day").collect()}
    for source, options in ((folder, {"files_per_batch": 1}), (os.path.join(SF01, "events.parquet"), {})):
        got = {(r.window_start, r.column_name): r for r in _stream(spark, source, **options).collect()}
        assert set(got) == set(batch)
        for k, r in got.items():
            b = batch[k]
            assert (r.row_count, r.null_count, r.negative_count) == (b.row_count, b.null_count, b.negative_count)
            assert r.min_value == b.min_value and r.max_value == b.max_value
            if b.mean is not None:
                assert abs(r.mean - b.mean) < 1e-6 * max(1.0, abs(b.mean))
            assert abs(r.approx_distinct - b.unique_count) <= max(2, 0.1 * b.unique_count)


def test_stream_with_watermark(spark):
    events = table(spark, SF01, "events")
    batch = {(r.window_start, r.column_name): r.row_count for r in windowed_profile(events, "ts", "1 day").collect()}
    got = {(r.window_start, r.column_name): r.row_count
           for r in _stream(spark, os.path.join(SF01, "events.parquet"), watermark="1 hour").collect()}
    assert got == batch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequency_table_combines_before_shuffle(spark):
    df = table(spark, SF001, "lineitem")
    plan = _plan(C.frequency(df))
    assert "partial_count" in plan and "Exchange hashpartitioning(column_name" in plan


def test_top_k_limits_before_shuffle(spark):
    df = table(spark, SF001, "lineitem")
    plan = spark.sparkContext  # noqa: F841
    p = P.categorical_stats(C.facts(C.frequency(df)))._jdf.queryExecution().sparkPlan().toString()
    assert p.count("WindowGroupLimit") >= 2        # partial (map side) and final


def test_scan_prunes_columns(spark):
    df = table(spark, SF001, "lineitem").select("l_orderkey", "l_returnflag")
    plan = _plan(C.frequency(df))
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 12 and "inferred_data_type" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracles_match_at_smallest_scale(spark):
    from oracle_check import compare
    res = compare(spark, SF001, ["column_profile", "rule_completeness", "issues", "composite_score",
                                 "windowed_profile", "transcripts_tail"], verbose=False)
    assert all(v == "OK" for v in res.values()), res


def test_stream_history_sink_is_idempotent(spark):
    out = tempfile.mkdtemp(prefix="qualitas-hist-")
    schema = table(spark, SF01, "events").schema
    run = lambda: stream_profile_to_history(
        spark, os.path.join(SF01, "events.parquet"), schema, "ts", f"{out}/history", f"{out}/checkpoint",
        dataset_name="events").awaitTermination()
    run()
    first = spark.read.parquet(f"{out}/history")
    n = first.count()
    assert n > 0 and first.select("window_start", "column_name").distinct().count() == n
    run()                         # a second run over the same checkpoint has nothing new to emit
    assert spark.read.parquet(f"{out}/history").count() == n


def test_per_column_statistics_need_one_small_shuffle(spark):
    import re

    import __spark_entry__ as E
    q = E.queries()
    for name in ("numeric_stats", "temporal_stats", "pattern_stats", "rule_completeness", "rule_range",
                 "rule_negative_amount", "rule_freshness"):
        plan = q[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert len(keys) == 1 and keys[0].startswith("column_name#") and "value#" not in keys[0], (name, keys)
        assert "partial_" in plan


def test_evaluation_and_duplicates_shuffle_digests(spark):
    import __spark_entry__ as E
    for name, absent in (("detector_evaluation", "text#"), ("duplicate_rows", "email#")):
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert exchanges and not any(absent in line for line in exchanges), (name, exchanges)


def test_results_do_not_depend_on_session_time_zone(spark):
    import __spark_entry__ as E
    q = E.queries()
    names = ["temporal_stats", "rule_freshness", "remediation_report", "windowed_profile", "audit_history_latest"]
    base = {n: sorted(map(tuple, q[n](spark, SF001).collect())) for n in names}
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        other = {n: sorted(map(tuple, q[n](spark, SF001).collect())) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert other == base


def test_scans_of_each_source(spark):
    import re

    import __spark_entry__ as E
    q = E.queries()
    # distinct counts are a scan of their own, next to the one for all other statistics; the scan for the texts of long
    # top values falls away when there are none
    for name, table_name, times in [("categorical_top3", "orders", 1), ("windowed_profile", "events", 1),
                                    ("profile_orders_typed", "orders", 2), ("rule_uniqueness", "orders", 1),
                                    ("numeric_stats", "orders", 1)]:
        df = q[name](spark, SF001)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scans = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", final)
        assert scans.count(table_name) == times, (name, scans)
