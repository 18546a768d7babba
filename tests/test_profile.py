"""Column profile on hand-made frames and invariants on the fixture."""
import datetime as dt

from pyspark.sql import functions as F

from qualitas.operators import cells as C
from qualitas.operators import profile as P
from qualitas.plans.audit import Audit

AS_OF = dt.datetime(2024, 1, 20)


def _profile(df):
    return {r.column_name: r for r in P.column_profile(C.facts(C.frequency(df)), columns=df.columns).collect()}


def test_empty_dataset_keeps_columns(spark):
    df = spark.createDataFrame([], "a string, b string")
    prof = _profile(df)
    assert set(prof) == {"a", "b"}
    assert prof["a"].null_count == 0 and prof["a"].null_ratio == 0.0 and prof["a"].inferred_data_type == "numeric"
    a = Audit(df, "empty", as_of=AS_OF, checkpoint_rules=False)
    assert a.dataset.collect()[0].row_count == 0


def test_all_missing_column_is_numeric(spark):
    df = spark.createDataFrame([(None, "x"), ("", "y")], "a string, b string")
    prof = _profile(df)
    assert prof["a"].inferred_data_type == "numeric"
    assert prof["a"].null_count == 2 and prof["a"].unique_count == 0
    assert prof["a"].sample_values_masked == []
    assert prof["b"].sample_values_masked == ["***", "***"]


def test_whitespace_is_present_and_types(spark):
    rows = [(" ", "1", "2024-01-01", "2024"), ("a", "2.5", "01/02/2024", "1999"), ("b", "-3", "05/2023", "2020")]
    df = spark.createDataFrame(rows, "s string, n string, d string, y string")
    prof = _profile(df)
    assert prof["s"].null_count == 0
    assert prof["s"].inferred_data_type == "string"
    assert prof["n"].inferred_data_type == "numeric"
    assert prof["d"].inferred_data_type == "datetime"
    assert prof["y"].inferred_data_type == "numeric"          # numeric wins over datetime


def test_numeric_blank_as_zero(spark):
    df = spark.createDataFrame([("4",), ("",), (None,), ("-2",), ("x",)], "a string")
    facts = C.facts(C.frequency(df))
    plain = P.numeric_stats(facts).collect()[0]
    zero = P.numeric_stats(facts, blank_as_zero=True).collect()[0]
    assert (plain.numeric_count, plain.min_value, plain.max_value, plain.mean) == (2, -2.0, 4.0, 1.0)
    assert plain.negative_value_ratio == 0.5
    assert (zero.numeric_count, zero.min_value, zero.mean) == (4, -2.0, 0.5)


def test_top3_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", "b", "d", ""]], "x string")
    top = P.categorical_stats(C.facts(C.frequency(df))).orderBy("rank").collect()
    assert [(r.value, r.n) for r in top] == [("a", 2), ("b", 2), ("c", 1)]
    assert top[0].distinct_values == 4


def test_temporal_coverage_and_year_guard(spark):
    # 10 rows, exactly 1 date -> kept (10 %); a bare year counts only in a date-like column name
    rows = [("2024-01-02" if i == 0 else "x", "2020" if i < 5 else "y", "2020" if i < 5 else "y") for i in range(10)]
    df = spark.createDataFrame(rows, "d string, code string, status string")
    t = {r.column_name: r for r in P.temporal_stats(C.facts(C.frequency(df)), AS_OF).collect()}
    assert "d" in t and t["d"].date_count == 1
    assert "code" not in t and "status" in t and t["status"].date_count == 5
    rows9 = [("2024-01-02" if i == 0 else "x",) for i in range(11)]
    t9 = P.temporal_stats(C.facts(C.frequency(spark.createDataFrame(rows9, "d string"))), AS_OF).collect()
    assert t9 == []                                           # 1 of 11 < 10 %


def test_future_and_stale(spark):
    df = spark.createDataFrame([("2024-02-01",), ("2022-01-01",), ("2023-06-01",)], "updated_at string")
    r = P.temporal_stats(C.facts(C.frequency(df)), AS_OF).collect()[0]
    assert r.future_count == 1 and r.stale_count == 1
    assert r.min_timestamp == "2022-01-01T00:00:00.000Z" and r.max_timestamp == "2024-02-01T00:00:00.000Z"


def test_invariants_on_fixture(spark, dirty01):
    prof = P.column_profile(C.facts(C.frequency(dirty01)))
    for r in prof.collect():
        assert r.null_count + r.present_count == r.row_count == 15149
        assert r.unique_count <= r.present_count
        assert all(s == "***" for s in r.sample_values_masked)
        assert 0.0 <= r.null_ratio <= 1.0 and 0.0 <= r.unique_ratio <= 1.0


def test_pattern_and_flags(spark, dirty01):
    facts = C.facts(C.frequency(dirty01))
    pats = {r.column_name: r for r in P.pattern_stats(facts).collect()}
    assert set(pats) == {"ref_code"} and pats["ref_code"].regex_match_ratio == 1.0
    a = Audit(dirty01, "d", as_of=AS_OF, checkpoint_rules=False)
    f = a.flags.collect()[0]
    assert f.kyc_fields_present and f.monetary_fields_present and f.personal_data_present


def test_nested_json_column_profiled_as_text(spark):
    df = spark.createDataFrame([({"k": 1},), ({"k": 1},), (None,)], "m map<string,int>")
    prof = _profile(df)
    assert prof["m"].unique_count == 1 and prof["m"].null_count == 1


def test_typed_fast_path_equals_text_grammar(spark):
    from conftest import SF001
    from qualitas.sources.tables import table
    extra = spark.createDataFrame(
        [(2024, 1.5, float("nan"), True, dt.date(2024, 1, 2)), (-7, float("inf"), 2.0, False, None),
         (2101, None, -0.0, None, dt.date(1999, 12, 31)), (None, 1e7, 3.25, True, dt.date(2100, 1, 1))],
        "year_no int, x double, y double, flag boolean, d date")
    dec = spark.createDataFrame([(2024,), (5,)], "v int").select(F.col("v").cast("decimal(10,0)").alias("v"),
                                                                 (F.col("v") / 4).cast("decimal(10,2)").alias("w"))
    for df in (table(spark, SF001, "lineitem"), table(spark, SF001, "orders"), table(spark, SF001, "events"),
               extra, dec):
        fast = C.facts_of(df)
        slow = C.facts(C.frequency(df))
        assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
