"""Sinks (profile JSON, Markdown reports, audit history) and a skewed input."""
import os
import tempfile

from pyspark.sql import functions as F

from qualitas.operators import cells as C
from qualitas.operators import profile as P
from qualitas.operators import rules as R
from qualitas.operators.windows import latest_per_key
from qualitas.plans import document as D
from qualitas.plans.audit import Audit
from qualitas.plans.report import append_history, remediation_report, read_reports, write_profile_json, write_reports


def _small(spark, name, bad):
    rows = [(str(i), "" if i < bad else f"u{i}@x.example", str(-i if i < bad else i)) for i in range(20)]
    return Audit(spark.createDataFrame(rows, "id string, email string, amount string"), name, as_of="2024-01-01")


def test_sinks_round_trip(spark):
    out = tempfile.mkdtemp(prefix="qualitas-sinks-")
    history = os.path.join(out, "history")
    for run, (name, bad) in enumerate([("a", 2), ("b", 5), ("a", 1)]):
        a = _small(spark, name, bad)
        doc = D.profile_json(a).select(F.lit(name).alias("dataset_name"), "json")
        write_profile_json(doc, os.path.join(out, "profiles"))
        rep = remediation_report(a.name, a.as_of, a.composite, a.issues, a.actions, a.risks)
        write_reports(rep, os.path.join(out, "reports"))
        row = a.composite.select(F.lit(name).alias("dataset_name"), F.lit(run).alias("ingestion_timestamp"),
                                 "composite_dqs")
        append_history(row, history)
    hist = spark.read.parquet(history)
    assert hist.count() == 3
    latest = {r.dataset_name: r for r in latest_per_key(hist).collect()}
    assert latest["a"].ingestion_timestamp == 2 and latest["b"].ingestion_timestamp == 1
    assert latest["a"].composite_dqs > latest["b"].composite_dqs
    assert spark.read.json(os.path.join(out, "profiles")).count() == 3
    texts = read_reports(spark, os.path.join(out, "reports")).collect()
    assert len(texts) == 3 and all(t.markdown.startswith("# Data Quality Remediation Report") for t in texts)
    assert {t.dataset_name for t in texts} == {"a", "b"} and all(t.file_name.startswith("Audit_Report_") for t in texts)


def test_hot_value_third_of_rows(spark):
    # one value holds a third of all rows in every column; results stay exact
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("x")).alias("v"))
    facts = C.facts(C.frequency(df))
    prof = {r.column_name: r for r in P.column_profile(facts).collect()}
    assert prof["k"].unique_count == 2001 and prof["v"].null_count == 1000
    top = P.categorical_stats(facts).where("column_name = 'k' AND rank = 1").collect()[0]
    assert (top.value, top.n) == ("HOT", 1000)
    parents = spark.createDataFrame([("HOT",)], "k string")
    o = R.orphan_rule(df, "k", parents, "k").collect()[0]
    assert (o.bad, o.eligible) == (2000, 3000)
    d = R.row_rules(df, keys=["k"]).collect()
    got = {r.rule: (r.bad, r.eligible) for r in d}
    assert got["duplicate_key"] == (999, 3000)
