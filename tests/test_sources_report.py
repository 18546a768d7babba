"""Sources (CSV / JSON round trips), report golden text, transcripts, history."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from qualitas.operators import cells as C
from qualitas.operators import profile as P
from qualitas.operators import windows as W
from qualitas.plans.document import ANALYSIS_SCHEMA
from qualitas.plans.report import first_risk, remediation_report
from qualitas.sources import readers


def _prof(df):
    return sorted(P.column_profile(C.facts(C.frequency(df))).drop("ordinal").collect())


def test_csv_round_trip(spark, dirty01):
    out = tempfile.mkdtemp(prefix="qualitas-csv-")
    dirty01.coalesce(2).write.mode("overwrite").csv(os.path.join(out, "t"), header=True)
    back = readers.read_csv(spark, os.path.join(out, "t"))
    assert back.columns == [*dirty01.columns, readers.CORRUPT]
    assert all(r[readers.CORRUPT] is None for r in back.collect())
    assert _prof(back.drop(readers.CORRUPT)) == _prof(dirty01)
    # a folder that holds anything but CSV files is refused, and so is such a path
    with open(os.path.join(out, "t", "notes.txt"), "w") as f:
        f.write("not,a,table\n1,2,3\n")
    for path in (os.path.join(out, "t"), os.path.join(out, "t", "notes.txt")):
        with pytest.raises(readers.NotCsvError):
            readers.read_csv(spark, path)


def test_csv_headers_and_field_counts(spark):
    d = tempfile.mkdtemp(prefix="qualitas-csv-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("x,y\n1,2\n3,4,5\n6\n")
    got = {r.x: r for r in readers.read_csv(spark, d).collect()}
    assert (got["1"].y, got["1"][readers.CORRUPT]) == ("2", None)
    assert (got["3"].y, got["3"][readers.CORRUPT]) == ("4", "3,4,5")
    assert (got["6"].y, got["6"][readers.CORRUPT]) == (None, "6")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("y,x\n20,10\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, d).collect()


def test_json_array_payload(spark):
    d = tempfile.mkdtemp(prefix="qualitas-json-")
    good = os.path.join(d, "good.json")
    with open(good, "w") as f:
        json.dump([{"id": 1, "amount": "12.5", "meta": {"k": 1}}, {"id": 2, "amount": "", "meta": None}], f)
    df = readers.read_json_array(spark, good)
    prof = {r.column_name: r for r in P.column_profile(C.facts(C.frequency(df))).collect()}
    assert prof["amount"].null_count == 1 and prof["meta"].null_count == 1 and prof["id"].unique_count == 2
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as f:
        json.dump({"id": 1}, f)
    for paths in (bad, [good, bad], d):
        with pytest.raises(readers.NotAnArrayError):
            readers.read_json_array(spark, paths)


def test_documents_keep_late_columns(spark):
    d = tempfile.mkdtemp(prefix="qualitas-docs-")
    p = os.path.join(d, "docs.json")
    with open(p, "w") as f:
        f.write(json.dumps({"a": 1, "b": "x"}) + "\n" + json.dumps({"a": 2, "c": "late"}) + "\n")
    assert sorted(readers.read_json_documents(spark, p).columns) == ["a", "b", "c"]


RISKS = ("Unreadable dates", "Made-up keys")


def _findings(spark):
    issues = [{"dimension": "Validity", "issue": "Odd text", "affected_columns": ["a"], "description": "3 records"},
              {"dimension": "Accuracy", "issue": "Out of range", "affected_columns": ["b", "c"], "description": "none"}]
    actions = [{"action": f"Do {i}", "priority": i, "description": "now"} for i in (2, 3, 1)]
    return spark.createDataFrame([("success", issues, actions, list(RISKS), 0.88, {"Validity": 0.5})], ANALYSIS_SCHEMA)


def test_report_layout(spark):
    a = _findings(spark)
    issues = a.select(F.posexplode("data_quality_issues").alias("dim_order", "i")).select(
        "dim_order", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("column_name"),
        "i.dimension", "i.issue", "i.affected_columns", "i.description")
    actions = a.select(F.explode("remediation_actions").alias("x")).select(
        F.col("x.action").alias("rule"), "x.action", "x.priority", "x.description")
    risks = a.select(F.posexplode("regulatory_compliance_risks").alias("severity", "risk"))
    comp = a.select((F.col("composite_dqs") * 1_000_000).cast("bigint").alias("composite_ppm"))
    rep = remediation_report("sample", "2024-01-20 10:00:00", comp, issues, actions, risks).collect()[0]
    assert rep.file_name == "Audit_Report_88%.md"
    md = rep.markdown
    assert md.startswith("# Data Quality Remediation Report\n**Generated on**: 2024-01-20 10:00:00\n"
                         "**Composite DQ Score**: 88.0%\n\n## 🚨 Critical Issues\n### Validity\n")
    assert "- **Columns**: b, c\n\n" in md
    assert md.index("[Priority 1]") < md.index("[Priority 2]") < md.index("[Priority 3]")
    assert md.endswith("\n## ⚖️ Compliance & Risks\n- " + RISKS[0] + "\n- " + RISKS[1] + "\n")
    assert first_risk(risks).collect()[0].headline_risk == RISKS[0]
    empty = risks.where("false")
    assert first_risk(empty).collect()[0].headline_risk.startswith("No regulatory")


def test_transcript_tail(spark):
    from qualitas.sources.tables import table
    conv = table(spark, SF01, "conversations")
    out = {r.conv_id: r for r in W.transcripts_tail(conv, keep=4).collect()}
    long = [r for r in out.values() if r.n_messages > 4]
    assert long and all(r.kept_messages == 4 for r in long)
    assert all(r.kept_messages == r.n_messages for r in out.values() if r.n_messages <= 4)
    turns = conv.where(F.col("conv_id") == long[0].conv_id).orderBy("turn").collect()
    assert long[0].transcript == "\n".join(f"{t.role}: {t.text}" for t in turns[-4:])


def test_latest_per_key(spark):
    h = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("b", 2, 20)], "dataset_name string, ingestion_timestamp int, v int")
    got = {r.dataset_name: r.v for r in W.latest_per_key(h).collect()}
    assert got == {"a": 30, "b": 20}
    for rows in ([("a", 3, 2), ("a", 3, 1)], [("a", 3, 1), ("a", 3, 2)]):       # ties don't follow the input's order
        tied = spark.createDataFrame(rows, h.schema).coalesce(1)
        assert W.latest_per_key(tied).first().v == 1


def test_null_conversation_and_ties_in_a_turn(spark):
    conv = spark.createDataFrame([(None, 1, "u", "x"), (None, 2, "u", "y"), (1, 5, "b", "t"), (1, 5, "a", "t")],
                                 "conv_id long, turn int, role string, text string")
    got = {r.conv_id: (r.n_messages, r.transcript) for r in W.transcripts_tail(conv, keep=2).collect()}
    assert got == {None: (2, "u: x\nu: y"), 1: (2, "a: t\nb: t")}


def test_mongo_without_connector_says_so(spark):
    with pytest.raises(readers.ConnectorMissingError):
        readers.read_mongo(spark, "mongodb://example.invalid:27017", "db", "coll")


def test_table_name_gate(spark):
    for name in ("bad-name; drop", "abc\n"):
        with pytest.raises(ValueError):
            readers.read_table(spark, name)
    spark.range(3).createOrReplaceTempView("qualitas_t1")
    assert readers.read_table(spark, "qualitas_t1").count() == 3


def test_csv_quoting(spark):
    d = tempfile.mkdtemp(prefix="qualitas-quote-")
    with open(os.path.join(d, "q.CSV"), "w") as f:
        f.write('id,name,note\n1,"Doe, Jane","said ""hi"""\n2,,"two\nlines"\n')
    flat = readers.read_csv(spark, d).orderBy("id").collect()
    assert flat[0].name == "Doe, Jane" and flat[0].note == 'said "hi"'
    multi = readers.read_csv(spark, d, multiline=True).orderBy("id").collect()
    assert len(multi) == 2 and multi[1].note == "two\nlines" and multi[1].name is None
