"""Nested profile / analysis documents, their JSON contract, and the profile-analysis merge.

A document is assembled from one-row JSON parts folded by one aggregation
and parsed back with ``from_json`` against the contract schema, which also
drops unknown fields and leaves absent optional ones NULL (filled with the
defaults below).  Validation routes bad documents to a quarantine.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

PROFILE_SCHEMA = (
    "dataset struct<dataset_id:string, dataset_name:string, row_count:bigint, column_count:bigint, "
    "detected_domain:string, ingestion_timestamp:string>, "
    "columns array<struct<column_name:string, inferred_data_type:string, null_count:bigint, null_ratio:double, "
    "unique_count:bigint, unique_ratio:double, sample_values_masked:array<string>>>, "
    "numeric_stats map<string, struct<min_value:double, max_value:double, mean:double, negative_value_ratio:double>>, "
    "categorical_stats map<string, struct<distinct_values:bigint, top_values:array<struct<value:string, n:bigint>>>>, "
    "temporal_stats map<string, struct<min_timestamp:string, max_timestamp:string, "
    "future_timestamp_ratio:double, stale_record_ratio:double>>, "
    "patterns map<string, struct<regex_match_ratio:double>>, "
    "cross_column_stats struct<duplicates_detected:boolean, dependent_nulls:array<struct<a:string, b:string>>>, "
    "compliance_flags struct<kyc_fields_present:boolean, monetary_fields_present:boolean, "
    "personal_data_present:boolean>")

ANALYSIS_SCHEMA = (
    "status string, "
    "data_quality_issues array<struct<dimension:string, issue:string, affected_columns:array<string>, "
    "description:string>>, "
    "remediation_actions array<struct<action:string, priority:int, description:string>>, "
    "regulatory_compliance_risks array<string>, composite_dqs double, dimension_scores map<string, double>")


def _fold(parts: list[tuple[str, DataFrame]], name_col: str = "_json") -> DataFrame:
    """Fold one-row ``_json`` parts into one JSON object text, keys in the given order."""
    rows = None
    for i, (key, df) in enumerate(parts):
        r = df.select(F.struct(F.lit(i).alias("o"), F.concat(F.lit(f'"{key}":'), F.col(name_col)).alias("t")).alias("e"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("e")),
                                                                   lambda e: e["t"]), ","), F.lit("}")).alias("json"))


def _map_part(df: DataFrame, value: "F.Column") -> DataFrame:
    return df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("column_name", value)))).alias("_json"))


def profile_json(a) -> DataFrame:
    """The full profile document of an ``Audit`` as one JSON text (``json``)."""
    from qualitas.operators.profile import top_values_nested
    ds = a.dataset.select(F.to_json(F.struct(
        "dataset_id", "dataset_name", "row_count", "column_count", "detected_domain",
        F.date_format("ingestion_timestamp", ISO).alias("ingestion_timestamp"))).alias("_json"))
    cols = a.columns.agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "inferred_data_type", "null_count",
                                             "null_ratio", "unique_count", "unique_ratio",
                                             "sample_values_masked"))),
        lambda e: e.dropFields("ordinal"))).alias("_json"))
    num = _map_part(a.numeric, F.struct("min_value", "max_value", "mean", "negative_value_ratio"))
    cat = _map_part(top_values_nested(a.categorical), F.struct("distinct_values", "top_values"))
    tmp = _map_part(a.temporal, F.struct("min_timestamp", "max_timestamp", "future_timestamp_ratio",
                                         "stale_record_ratio"))
    pat = _map_part(a.patterns, F.struct("regex_match_ratio"))
    pair_t = "array<struct<a:string,b:string>>"
    dup = a.duplicates.select(F.col("duplicates_detected").alias("d"), F.lit(None).cast(pair_t).alias("p"))
    dep = a.dependent_nulls.agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("p")).select(
        F.lit(None).cast("boolean").alias("d"), "p")
    cross = dup.unionByName(dep).agg(F.to_json(F.struct(
        F.max("d").alias("duplicates_detected"),
        F.first("p", ignorenulls=True).alias("dependent_nulls"))).alias("_json"))
    flags = a.flags.select(F.to_json(F.struct("*")).alias("_json"))
    return _fold([("dataset", ds), ("columns", cols), ("numeric_stats", num), ("categorical_stats", cat),
                  ("temporal_stats", tmp), ("patterns", pat), ("cross_column_stats", cross),
                  ("compliance_flags", flags)])


def flat_profile(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """A row per column of parsed profile documents, with its statistics from every part of the document."""
    p = docs.select("dataset_name", F.from_json(F.col(json_col), PROFILE_SCHEMA).alias("p"))
    c = p.select("dataset_name", "p.*").withColumn("c", F.explode("columns"))
    of = lambda part: F.try_element_at(F.col(part), F.col("c.column_name"))
    top = F.array_join(F.transform(of("categorical_stats")["top_values"], lambda t: F.concat(
        t["value"], F.lit("="), t["n"].cast("string"))), ",")
    missing_with = F.array_join(F.transform(F.filter(F.col("cross_column_stats.dependent_nulls"), lambda d: (
        d["a"] == F.col("c.column_name"))), lambda d: d["b"]), ",")
    return c.select(
        "dataset_name", F.col("dataset.row_count").alias("row_count"), "c.column_name", "c.inferred_data_type",
        "c.null_count", "c.null_ratio", "c.unique_count", F.array_join("c.sample_values_masked", ",").alias("samples"),
        of("numeric_stats")["min_value"].alias("min_value"), of("numeric_stats")["max_value"].alias("max_value"),
        of("numeric_stats")["negative_value_ratio"].alias("negative_value_ratio"), top.alias("top_values"),
        of("temporal_stats")["min_timestamp"].alias("min_timestamp"),
        of("temporal_stats")["max_timestamp"].alias("max_timestamp"),
        of("patterns")["regex_match_ratio"].alias("regex_match_ratio"), missing_with.alias("missing_with"),
        F.col("cross_column_stats.duplicates_detected").alias("duplicates_detected"),
        F.col("compliance_flags.kyc_fields_present").alias("kyc_fields_present"))


def analysis_json(a) -> DataFrame:
    """The analysis document (issues, actions, risks, scores) of an ``Audit`` as one JSON text."""
    iss = a.issues.agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct(
            "dim_order", F.coalesce("rule", F.lit("")).alias("r"), F.coalesce("column_name", F.lit("")).alias("c"),
            "dimension", "issue", "affected_columns", "description"))),
        lambda e: e.dropFields("dim_order", "r", "c"))).alias("_json"))
    act = a.actions.agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("priority", "rule", "action", "description"))),
        lambda e: F.struct(e["action"].alias("action"), e["priority"].alias("priority"),
                           e["description"].alias("description")))).alias("_json"))
    rsk = a.risks.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("severity", "risk"))),
                                            lambda e: e["risk"])).alias("_json"))
    comp = a.composite.select(F.col("composite_dqs").cast("string").alias("_json"))
    scores = a.scores.agg(F.to_json(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("dim_order", "dimension", "score"))),
        lambda e: F.struct(e["dimension"], e["score"])))).alias("_json"))
    status = a.composite.select(F.lit('"success"').alias("_json"))
    return _fold([("status", status), ("data_quality_issues", iss), ("remediation_actions", act),
                  ("regulatory_compliance_risks", rsk), ("composite_dqs", comp), ("dimension_scores", scores)])


def parse_analysis(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """``from_json`` with the analysis contract; unknown fields dropped, optional ones defaulted."""
    p = F.from_json(F.col(json_col), ANALYSIS_SCHEMA)
    return docs.withColumn("_a", p).select(
        *[c for c in docs.columns if c != json_col],
        F.coalesce(F.col("_a.status"), F.lit("success")).alias("status"),
        F.transform(F.col("_a.data_quality_issues"), lambda i: F.struct(
            i["dimension"].alias("dimension"),
            F.coalesce(i["issue"], F.lit("No issues identified")).alias("issue"),
            F.coalesce(i["affected_columns"], F.array().cast("array<string>")).alias("affected_columns"),
            F.coalesce(i["description"], F.lit("No specific issues were identified for this dimension."))
            .alias("description"))).alias("data_quality_issues"),
        F.transform(F.col("_a.remediation_actions"), lambda x: F.struct(
            x["action"].alias("action"), x["priority"].alias("priority"),
            F.coalesce(x["description"], F.lit("")).alias("description"))).alias("remediation_actions"),
        F.coalesce(F.col("_a.regulatory_compliance_risks"), F.array().cast("array<string>"))
        .alias("regulatory_compliance_risks"),
        F.col("_a.composite_dqs").alias("composite_dqs"),
        F.col("_a.dimension_scores").alias("dimension_scores"))


def validate_analysis(parsed: DataFrame) -> DataFrame:
    """Adds ``reason`` (first failed check, NULL if none) and ``accepted``."""
    acts = F.col("remediation_actions")
    checks = [
        ("missing data_quality_issues", F.col("data_quality_issues").isNull()),
        ("missing remediation_actions", acts.isNull()),
        ("missing dimension_scores", F.col("dimension_scores").isNull()),
        ("missing composite_dqs", F.col("composite_dqs").isNull()),
        ("composite_dqs outside 0..1", ~F.col("composite_dqs").between(0.0, 1.0)),
        ("issue without dimension", F.exists(F.col("data_quality_issues"), lambda i: i["dimension"].isNull())),
        ("action without text", F.exists(acts, lambda x: x["action"].isNull())),
        ("priority outside 1..5", F.exists(acts, lambda x: x["priority"].isNull()
                                           | (x["priority"] < 1) | (x["priority"] > 5))),
    ]
    reason = F.lit(None).cast("string")
    for text, failed in reversed(checks):
        reason = F.when(F.coalesce(failed, F.lit(False)), F.lit(text)).otherwise(reason)
    return parsed.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def split_quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("accepted"), validated.where("NOT accepted")


def merge_profile_analysis(profile: DataFrame, analysis: DataFrame, on: str = "dataset_name") -> DataFrame:
    """Profile left-joined with its analysis; on a field clash the analysis wins; profile alone if none."""
    clash = [c for c in analysis.columns if c in profile.columns and c != on]
    p, a = profile.alias("p"), analysis.alias("a")
    keep = ([F.col(f"p.`{c}`") for c in profile.columns if c not in clash and c != on]
            + [F.coalesce(F.col(f"a.`{c}`"), F.col(f"p.`{c}`")).alias(c) for c in clash]
            + [F.col(f"a.`{c}`") for c in analysis.columns if c not in clash and c != on])
    return p.join(a, on, "left").select(on, *keep)


def pick_analysis(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Nested-result pick: the ``genai_insights`` object when the document has one, else the document.

    Returns the picked object as JSON text in ``json_col`` (other columns kept).
    """
    inner = F.get_json_object(F.col(json_col), "$.genai_insights")
    return docs.withColumn(json_col, F.coalesce(inner, F.col(json_col)))
