"""Public-URL and table-name predicates; analysis contract and quarantine."""
import json

from pyspark.sql import functions as F

from qualitas.functions.urls import is_public_url, is_valid_table_name
from qualitas.plans import document as D


def test_public_urls(spark):
    cases = {"ftp://a.b": False, "http://localhost": False, "http://10.1.2.3": False, "http://172.16.0.1": False,
             "http://172.32.0.1": True, "http://192.168.1.1": False, "http://169.254.169.254": False,
             "http://0.1.2.3": False, "HTTP://Example.com": True, "not a url": False,
             "https://example.org/a?b=1": True, "http://metadata.google.internal/x": False,
             "http://127.0.0.1:8080/": False, "http://999.1.1.1": False,
             # other ways to write an address, ports, user information, odd hosts
             "http://2130706433/": False, "http://0x7f000001/": False, "http://0177.0.0.1/": False, "http://127.1/": False,
             "http://0xA.1.1.1": False, "http://192.11010049/": False, "http://134744072/": True, "http://8.8.8.8.": True,
             "http://4294967296/": False, "http://1.2.3.4.5/": False, "http://089.1.1.1/": False,
             "http://a.org:99999/": False, "http://a.org:65535/": True, "http://a.org:x/": False,
             "http://user:pw@10.0.0.1/": False, "http://10.0.0.1@a.org/": True, "http://my_host.com/": True,
             "http://a.org/a path": True, "http://a b.org/": False, "  https://a.org\n": True, "http:a.org": True,
             "http:///a.org": True, "http://": False, "http://%31%30.0.0.1/": False, "http://[::1]/": False,
             "http://[0:0:0:0:0:0:0:1]:80/": False, "http://[2001:db8::1]/": True, "http://LOCALHOST/": False,
             "http://bücher.example/": True, "http://１0.0.0.1/": False, "javascript:alert(1)": False}
    df = spark.createDataFrame(list(cases.items()), "url string, want boolean")
    got = {r.url: r.ok for r in df.select("url", is_public_url(F.col("url")).alias("ok")).collect()}
    assert got == cases


def test_table_names(spark):
    cases = {"abc\n": False, "orders": True, "sales.orders": True, "_t1": True, "1abc": False, "a-b": False, "a b": False}
    df = spark.createDataFrame(list(cases.items()), "n string, want boolean")
    assert {r.n: r.ok for r in df.select("n", is_valid_table_name(F.col("n")).alias("ok")).collect()} == cases


def _doc(**over):
    base = {"status": "success", "data_quality_issues": [{"dimension": "Validity", "issue": "x",
                                                          "affected_columns": ["a"], "description": "d"}],
            "remediation_actions": [{"action": "Fix", "priority": 1, "description": "d"}],
            "regulatory_compliance_risks": ["r"], "composite_dqs": 0.5, "dimension_scores": {"Validity": 0.5}}
    base.update(over)
    return json.dumps({k: v for k, v in base.items() if v is not None})


def test_contract_quarantine(spark):
    docs = [("ok", _doc()),
            ("unknown_field", _doc(extra_field=123)),
            ("no_optional", json.dumps({k: v for k, v in json.loads(_doc()).items()
                                        if k not in ("status", "regulatory_compliance_risks")})),
            ("prio0", _doc(remediation_actions=[{"action": "Fix", "priority": 0}])),
            ("prio6", _doc(remediation_actions=[{"action": "Fix", "priority": 6}])),
            ("composite12", _doc(composite_dqs=1.2)),
            ("no_scores", _doc(dimension_scores=None))]
    df = spark.createDataFrame(docs, "dataset_name string, json string")
    v = {r.dataset_name: r for r in D.validate_analysis(D.parse_analysis(df)).collect()}
    assert v["ok"].accepted and v["unknown_field"].accepted
    assert v["no_optional"].accepted and v["no_optional"].status == "success"
    assert v["no_optional"].regulatory_compliance_risks == []
    assert v["prio0"].reason == v["prio6"].reason == "priority outside 1..5"
    assert v["composite12"].reason == "composite_dqs outside 0..1"
    assert v["no_scores"].reason == "missing dimension_scores"
    acc, quar = D.split_quarantine(D.validate_analysis(D.parse_analysis(df)))
    assert acc.count() == 3 and quar.count() == 4
    assert v["prio0"].remediation_actions[0].description == ""


def test_merge_analysis_wins_and_profile_alone(spark):
    prof = spark.createDataFrame([("a", 10, "Unknown"), ("b", 5, "Unknown")], "dataset_name string, rows int, domain string")
    ana = spark.createDataFrame([("a", "API Source", 0.9)], "dataset_name string, domain string, composite double")
    m = {r.dataset_name: r for r in D.merge_profile_analysis(prof, ana).collect()}
    assert m["a"].domain == "API Source" and m["a"].composite == 0.9
    assert m["b"].domain == "Unknown" and m["b"].composite is None


def test_pick_nested_result(spark):
    docs = spark.createDataFrame([("a", json.dumps({"genai_insights": {"composite_dqs": 0.7}, "other": 1})),
                                  ("b", json.dumps({"composite_dqs": 0.9}))], "dataset_name string, json string")
    got = {r.dataset_name: json.loads(r.json) for r in D.pick_analysis(docs).collect()}
    assert got == {"a": {"composite_dqs": 0.7}, "b": {"composite_dqs": 0.9}}
