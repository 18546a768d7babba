"""Rule counts on the dirty-payments fixture (planted dirt, sf0.01) and scores."""
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from qualitas.operators import rules as R
from qualitas.plans.audit import Audit
from qualitas.sources.tables import table


@pytest.fixture(scope="module")
def audit01(spark, dirty01):
    return Audit(dirty01, "dirty_payments", as_of="2000-06-01", keys=["txn_id"],
                 parents={"client_id": (table(spark, SF01, "customer"), "c_custkey")})


@pytest.fixture(scope="module")
def rule_map(audit01):
    return {(r.rule, r.column_name): r for r in audit01.rules.collect()}


def test_planted_counts(rule_map):
    assert rule_map[("duplicate_rows", "*")].bad == 149
    assert rule_map[("duplicate_key", "txn_id")].bad == 149
    assert rule_map[("orphan_keys", "client_id")].bad == 157
    assert rule_map[("missing_values", "email")].bad == 1642
    assert rule_map[("missing_values", "kyc_address")].bad == 892
    assert rule_map[("missing_values", "amount")].bad == 450
    assert rule_map[("currency_symbol", "amount")].bad == 660
    assert rule_map[("negative_amount", "amount")].bad == 500
    assert rule_map[("out_of_range", "cvv")].bad == 353
    assert rule_map[("pan_length", "card_number")].bad == 138
    assert rule_map[("non_iso_date", "txn_date")].bad == 2437
    # future relative to as_of 2000-06-01: ratio 0.198099 of 15,149 dates (FIXTURES temporal table),
    # of which 370 are the planted 2031-01-01 values
    assert rule_map[("future_timestamp", "updated_at")].bad == 3001
    assert rule_map[("missing_values", "txn_id")].bad == 0


def test_no_date_rule_on_id_columns(rule_map):
    assert not [k for k in rule_map if k[1] in ("txn_id", "client_id") and k[0] in
                ("future_timestamp", "stale_records", "non_iso_date")]


def test_scores_in_range_and_all_dimensions(audit01):
    scores = audit01.scores.collect()
    assert len(scores) == 7
    assert all(0.0 <= r.score <= 1.0 for r in scores)
    c = audit01.composite.collect()[0].composite_dqs
    assert 0.0 <= c <= 1.0


def test_healthy_dimension_row(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    a = Audit(df, "clean", as_of="2024-01-01", checkpoint_rules=False)
    issues = a.issues.collect()
    assert len(issues) == 7 and all(r.issue == "No issues identified" for r in issues)
    assert all(r.affected_columns == [] for r in issues)
    assert a.composite.collect()[0].composite_dqs == 1.0
    assert a.actions.count() == 0


def test_issue_wording(spark):
    df = spark.createDataFrame([("1", None), ("2", "x"), ("3", "y")], "id string, email string")
    a = Audit(df, "w", as_of="2024-01-01", checkpoint_rules=False)
    d = {r.column_name: r.description for r in a.issues.collect() if r.rule == "missing_values"}
    assert d["email"] == "1 record (33.33%) has a missing email"
    df2 = spark.createDataFrame([(None,), ("",)], "phone string")
    d2 = [r.description for r in Audit(df2, "w", as_of="2024-01-01", checkpoint_rules=False).issues.collect()
          if r.rule == "missing_values"]
    assert d2 == ["All phone values are missing (0 distinct values observed)"]


def test_priority_buckets(spark):
    rows = spark.createDataFrame([("Completeness", "missing_values", "a", 25, 100, 1),
                                  ("Accuracy", "negative_amount", "amount", 1, 1000, 1)],
                                 R.RULE_SCHEMA)
    from qualitas.operators.findings import remediation_actions
    got = {r.rule: r.priority for r in remediation_actions(rows).collect()}
    assert got == {"missing_values": 1, "negative_amount": 5}


def test_pan_unknown_brand_never_flagged(spark):
    df = spark.createDataFrame([("Visa", "4" * 15), ("Amex", "3" * 15), ("Diners", "3" * 14), ("Foo", "1")],
                               "card_brand string, card_number string")
    r = R.pan_length_rule(df).collect()[0]
    assert (r.bad, r.eligible) == (1, 3)


def test_orphans_with_hot_key(spark):
    child = spark.createDataFrame([("1",)] * 50 + [("2",), ("9",), (None,)], "k string")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    r = R.orphan_rule(child, "k", parent, "id").collect()[0]
    assert (r.bad, r.eligible, r.distinct_values) == (1, 52, 3)
