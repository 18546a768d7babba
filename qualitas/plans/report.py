"""Markdown remediation report, and the sinks for profiles, reports and audit history."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions.text import fixed_text, scaled_ratio
from qualitas.operators.findings import NO_RISK
from qualitas.operators.score import PPM

# FIXED values: layout of the exported report.
REPORT_TITLE = "# Data Quality Remediation Report\n"
REPORT_GENERATED = "**Generated on**: "
REPORT_SCORE = "**Composite DQ Score**: "
REPORT_ISSUES = "\n## 🚨 Critical Issues\n"
REPORT_ACTIONS = "\n## ✅ Recommended Actions\n"
REPORT_RISKS = "\n## ⚖️ Compliance & Risks\n"
REPORT_FILE = "{prefix}_{score}%.md"
REPORT_PREFIX = "Audit_Report"


def remediation_report(name: str, as_of, composite: DataFrame, issues: DataFrame, actions: DataFrame,
                       risks: DataFrame, file_prefix: str = REPORT_PREFIX) -> DataFrame:
    """One row ``dataset_name, file_name, markdown`` for an audited dataset.

    All lines (header, issues in dimension order, actions by priority, risks
    by severity) are unioned with a sort key and folded by ONE aggregation;
    the lines are findings (at most rules x columns), never data rows.
    """
    from qualitas.operators.profile import _as_of_lit
    L = F.lit
    ppm = F.col("composite_ppm")
    score1 = fixed_text(scaled_ratio(ppm, L(PPM), 1000), 1)
    header = F.concat(L(REPORT_TITLE), L(REPORT_GENERATED),
                      F.date_format(_as_of_lit(as_of), "yyyy-MM-dd HH:mm:ss"), L("\n"),
                      L(REPORT_SCORE), score1, L("%\n"), L(REPORT_ISSUES))

    def line(sec, k1, k2, k3, text):
        return F.struct(L(sec).alias("sec"), k1.cast("int").alias("k1"), k2.cast("string").alias("k2"),
                        k3.cast("string").alias("k3"), text.alias("text")).alias("e")

    head = composite.select(line(0, L(0), L(""), L(""), header),
                            (scaled_ratio(ppm, L(PPM), 100)).alias("score0"))
    iss = issues.select(line(1, F.col("dim_order"), F.coalesce("rule", L("")), F.coalesce("column_name", L("")),
                             F.concat(L("### "), "dimension", L("\n- **Issue**: "), "issue", L("\n- **Impact**: "),
                                      "description", L("\n- **Columns**: "),
                                      F.array_join("affected_columns", ", "), L("\n\n"))),
                        L(None).cast("bigint").alias("score0"))
    act_head = composite.select(line(2, L(0), L(""), L(""), L(REPORT_ACTIONS)), L(None).cast("bigint").alias("score0"))
    act = actions.select(line(3, F.col("priority"), F.col("rule"), L(""),
                              F.concat(L("- **[Priority "), F.col("priority").cast("string"), L("]** "), "action",
                                       L(": "), "description", L("\n"))),
                         L(None).cast("bigint").alias("score0"))
    risk_head = composite.select(line(4, L(0), L(""), L(""), L(REPORT_RISKS)), L(None).cast("bigint").alias("score0"))
    rsk = risks.select(line(5, F.col("severity"), F.col("risk"), L(""), F.concat(L("- "), "risk", L("\n"))),
                       L(None).cast("bigint").alias("score0"))
    lines = head.unionByName(iss).unionByName(act_head).unionByName(act).unionByName(risk_head).unionByName(rsk)
    folded = lines.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), "").alias("markdown"),
        F.max("score0").alias("score0"))
    return folded.select(L(name).alias("dataset_name"),
                         F.replace(L(REPORT_FILE.replace("{prefix}", file_prefix)), L("{score}"),
                                   F.col("score0").cast("string")).alias("file_name"),
                         "markdown")


def first_risk(risks: DataFrame) -> DataFrame:
    """The headline risk: the first by severity, else a default text."""
    top = risks.agg(F.min(F.struct("severity", "risk")).alias("r"))
    return top.select(F.coalesce(F.col("r.risk"), F.lit(NO_RISK)).alias("headline_risk"))


def write_profile_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """Profile / analysis documents as JSON lines, partitioned by dataset."""
    df.write.mode(mode).partitionBy("dataset_name").json(path)


def write_reports(report: DataFrame, path: str, mode: str = "append") -> None:
    """One Markdown text per dataset and file name, in folders named by both."""
    (report.select("dataset_name", "file_name", "markdown").write.mode(mode)
     .partitionBy("dataset_name", "file_name").text(path))


def read_reports(spark, path: str) -> DataFrame:
    """``dataset_name, file_name, markdown`` of written reports."""
    texts = spark.read.schema("value string, dataset_name string, file_name string").text(path, wholetext=True)
    return texts.select("dataset_name", "file_name", F.regexp_replace("value", r"\n\z", "").alias("markdown"))


def append_history(rows: DataFrame, path: str) -> None:
    """Append audit rows to the history table (parquet, partitioned by dataset)."""
    rows.write.mode("append").partitionBy("dataset_name").parquet(path)
