"""Small API surface: Audit convenience views, sampling, shared folder, JDBC name gate."""
import json

import pytest

from qualitas.plans.audit import Audit, audit
from qualitas.sources import readers
from qualitas.session import shared_folder


def test_audit_views_and_sample(spark):
    df = spark.createDataFrame([(str(i), "" if i % 4 == 0 else "x", str(-i)) for i in range(40)],
                               "id string, email string, amount string")
    a = audit(df, "api", as_of="2024-01-01", sample_fraction=0.5, sample_seed=3)
    n = a.dataset.collect()[0].row_count
    assert 0 < n < 40 and n == Audit(df, "api", as_of="2024-01-01", sample_fraction=0.5, sample_seed=3).dataset.first().row_count
    rep = a.report().collect()[0]
    assert rep.dataset_name == "api" and rep.markdown.startswith("# Data Quality Remediation Report")
    assert json.loads(a.profile_document().collect()[0].json)["dataset"]["dataset_name"] == "api"
    ana = json.loads(a.analysis_document().collect()[0].json)
    assert 0.0 <= ana["composite_dqs"] <= 1.0 and len(ana["dimension_scores"]) == 7


def test_default_as_of_is_today(spark):
    a = audit(spark.createDataFrame([("1",)], "id string"), "t")
    assert a.dataset.collect()[0].ingestion_timestamp is not None


def test_no_machine_local_folder_on_a_cluster(spark):
    assert shared_folder(spark, configured="hdfs://store/x/") == "hdfs://store/x"
    class Bare:                                       # a session on a cluster that names no folder
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)
        class conf:
            get = staticmethod(lambda key, default=None: default)
    for master in (None, "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(Bare, master=master)


def test_long_values_are_counted_by_digest_and_shown_whole(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long + "1",)] * 3 + [(long + "2",)] * 2 + [("short",)], "v string")
    a = Audit(df, "t", as_of="2024-01-01")
    assert [(r.value, r.n, r.distinct_values) for r in a.categorical.orderBy("rank").collect()] == [
        (long + "1", 3, 3), (long + "2", 2, 3), ("short", 1, 3)]
    assert a.columns.first().unique_count == 3


def test_fractional_weights(spark):
    df = spark.createDataFrame([("", "1"), ("x", "2")], "email string, id string")
    half = {d: 0.5 for d in ("Completeness", "Accuracy")}
    a = Audit(df, "w", as_of="2024-01-01", weights=half)
    assert a.composite.first().composite_dqs == 0.875


def test_jdbc_name_gate(spark):
    with pytest.raises(ValueError):
        readers.read_jdbc(spark, "jdbc:postgresql://example.invalid/db", "orders; drop table x")
    with pytest.raises(ValueError, match="partition column"):
        readers.read_jdbc(spark, "jdbc:postgresql://example.invalid/db", "orders")


def test_audit_with_column_subset(spark):
    df = spark.createDataFrame([("1", "a", "z")], "id string, name string, other string")
    a = Audit(df, "sub", as_of="2024-01-01", columns=["id", "name"], checkpoint_rules=False)
    assert sorted(r.column_name for r in a.columns.collect()) == ["id", "name"]
    assert a.dataset.collect()[0].column_count == 2
