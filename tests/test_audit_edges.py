"""Whole-audit edge cases: odd column names, typed tables, empty input, document round trip."""
import json

from pyspark.sql import functions as F

from conftest import SF001
from qualitas.plans import document as D
from qualitas.plans.audit import Audit
from qualitas.sources.tables import table


def test_odd_column_names(spark):
    df = spark.createDataFrame([("1", "a b", None), ("2", "", "x")], "`order.id` string, `full name` string, `e-mail` string")
    a = Audit(df, "odd", as_of="2024-01-01", checkpoint_rules=False)
    prof = {r.column_name: r for r in a.columns.collect()}
    assert set(prof) == {"order.id", "full name", "e-mail"}
    assert prof["full name"].null_count == 1 and prof["e-mail"].null_count == 1
    assert a.duplicates.collect()[0].duplicate_rows == 0
    assert a.dependent_nulls.count() == 0
    assert {r.dimension for r in a.issues.collect()} >= {"Completeness"}


def test_typed_orders_audit(spark):
    orders = table(spark, SF001, "orders")
    a = Audit(orders, "orders", as_of="2000-06-01", columns=["o_orderkey", "o_totalprice", "o_orderdate"],
              checkpoint_rules=False)
    types = {r.column_name: r.inferred_data_type for r in a.columns.collect()}
    assert types == {"o_orderkey": "numeric", "o_totalprice": "numeric", "o_orderdate": "datetime"}
    assert {r.column_name for r in a.temporal.collect()} == {"o_orderdate"}
    plan = a.columns._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_empty_audit_end_to_end(spark):
    df = spark.createDataFrame([], "a string, amount string")
    a = Audit(df, "empty", as_of="2024-01-01")
    assert a.composite.collect()[0].composite_dqs == 1.0
    assert len(a.issues.collect()) == 7
    doc = json.loads(D.profile_json(a).collect()[0].json)
    assert doc["dataset"]["row_count"] == 0 and len(doc["columns"]) == 2


def test_profile_document_round_trip(spark):
    from conftest import SF01  # noqa: F401
    df = spark.createDataFrame([("1", "ABC1", "2024-01-02", "-5"), ("2", "ABC2", None, "7")],
                               "id string, code string, created_at string, amount string")
    a = Audit(df, "doc", as_of="2024-06-01", dataset_id="ds-1")
    raw = D.profile_json(a)
    doc = json.loads(raw.collect()[0].json)
    assert doc["dataset"]["dataset_id"] == "ds-1" and doc["dataset"]["ingestion_timestamp"] == "2024-06-01T00:00:00.000Z"
    assert [c["column_name"] for c in doc["columns"]] == ["id", "code", "created_at", "amount"]
    assert doc["numeric_stats"]["amount"]["negative_value_ratio"] == 0.5
    assert doc["patterns"]["code"]["regex_match_ratio"] == 1.0
    assert doc["categorical_stats"]["code"]["top_values"][0] == {"value": "ABC1", "n": 1}
    assert doc["compliance_flags"]["monetary_fields_present"] is True
    parsed = raw.select(F.from_json("json", D.PROFILE_SCHEMA).alias("p")).select("p.*").collect()[0]
    assert parsed.dataset.row_count == 2 and parsed.temporal_stats["created_at"].future_timestamp_ratio == 0.0
    assert parsed.cross_column_stats.duplicates_detected is False
    ana = json.loads(D.analysis_json(a).collect()[0].json)
    assert set(ana) == {"status", "data_quality_issues", "remediation_actions", "regulatory_compliance_risks",
                        "composite_dqs", "dimension_scores"}
    assert list(ana["dimension_scores"]) == ["Completeness", "Accuracy", "Consistency", "Validity", "Timeliness",
                                             "Uniqueness", "Integrity"]


def test_dependent_nulls_wide_table(spark):
    from qualitas.operators.crosscol import dependent_nulls
    k = 130                       # three mask words
    cols = [f"c{i}" for i in range(k)]
    row_a = [None if i in (0, 64, 129) else "x" for i in range(k)]
    row_b = [None if i in (64, 129) else "y" for i in range(k)]
    row_c = ["z"] * k
    df = spark.createDataFrame([row_a, row_b, row_c], ", ".join(f"{c} string" for c in cols))
    got = sorted((r.a, r.b, r.a_missing) for r in dependent_nulls(df).collect())
    assert got == [("c0", "c129", 1), ("c0", "c64", 1), ("c129", "c64", 2), ("c64", "c129", 2)]
