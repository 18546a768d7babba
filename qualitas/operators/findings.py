"""Issues, remediation actions and compliance risks derived from rule rows.

The wording tables are small fixed lookups (one row per rule), joined by
broadcast to rule rows that are themselves at most rules x columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.functions.predicates import name_has_any
from qualitas.functions.text import count_sentence

# Wording of each rule (this engine's own texts; the remediation verbs follow
# the "flag and correct" / "validate through source system" convention).
#   rule, issue title, phrase after "have", phrase after "values are", action, action description
RULE_TEXT = (
    ("missing_values", "Missing values", "a missing {column}", "missing",
     "Flag and backfill missing values", "Validate {columns} through the source system and backfill the gaps."),
    ("out_of_range", "Values outside the allowed range", "{column} outside the allowed range",
     "outside the allowed range",
     "Flag and correct out-of-range values", "Flag and correct {columns} values outside the business range."),
    ("negative_amount", "Negative monetary values", "a negative {column}", "negative",
     "Flag and correct negative amounts", "Validate negative {columns} values through the source system."),
    ("future_timestamp", "Timestamps in the future", "{column} in the future", "in the future",
     "Flag and correct future timestamps", "Validate {columns} timestamps later than the audit date through the source system."),
    ("numeric_as_string", "Numeric fields stored as strings", "non-numeric text in numeric field {column}",
     "non-numeric text", "Standardize numeric fields", "Flag and correct text values in numeric fields {columns}."),
    ("datetime_as_string", "Date-time fields stored as strings", "non-date text in date-time field {column}",
     "non-date text", "Standardize date-time fields", "Flag and correct text values in date-time fields {columns}."),
    ("currency_symbol", "Currency symbols in numeric field", "a currency symbol in {column}",
     "prefixed with a currency symbol",
     "Strip currency symbols", "Flag and correct {columns} values carrying currency symbols; keep the currency in its own field."),
    ("non_iso_date", "Non-ISO date format (requires standardization)", "{column} in a non-ISO format",
     "in a non-ISO format", "Standardize dates to ISO 8601", "Convert {columns} to YYYY-MM-DD; these values require standardization."),
    ("pan_length", "Card number length invalid for brand", "a card number length not valid for its brand",
     "of an invalid length for their brand",
     "Validate card numbers by brand", "Validate {columns} through the source system against the length of each card brand."),
    ("stale_records", "Records older than the freshness policy",
     "{column} older than the assumed 2-5 year policy (may violate assumed policy)",
     "older than the assumed 2-5 year policy",
     "Review stale records", "Validate records whose {columns} may violate the assumed 2-5 year freshness policy."),
    ("duplicate_rows", "Duplicate records", "a duplicate of another record", "duplicates",
     "Flag and reconcile duplicates", "Flag duplicate records and reconcile them through the source system."),
    ("duplicate_key", "Duplicate keys", "a duplicated key {column}", "duplicated",
     "Flag and reconcile duplicate keys", "Flag records sharing a key in {columns} and validate them through the source system."),
    ("malformed_rows", "Malformed records", "fields that do not fit the header", "malformed",
     "Flag and correct malformed records", "Flag records that do not fit the columns and validate them through the source system."),
    ("orphan_keys", "Orphan references", "a {column} without a matching parent record", "without a parent record",
     "Flag and correct orphan references", "Validate {columns} against the parent table through the source system."),
)

# Compliance risk per rule, when the affected column belongs to a class
# (kyc / personal / monetary by name tokens, or any).  rank 1 = high.
RISK_TEXT = (
    ("missing_values", "kyc", 1,
     "High Risk: Missing KYC details may lead to non-compliance with AML/KYC directives."),
    ("missing_values", "personal", 2,
     "Medium Risk: Missing personal contact data weakens customer due-diligence records (GDPR/CCPA accuracy)."),
    ("negative_amount", "monetary", 2,
     "Medium Risk: Negative monetary amounts may indicate data entry corruption."),
    ("pan_length", "any", 1,
     "High Risk: Card numbers invalid for their brand may breach payment card data standards."),
    ("orphan_keys", "any", 2,
     "Medium Risk: References without a parent record break the audit trail required for AML monitoring."),
    ("duplicate_rows", "any", 3,
     "Low Risk: Duplicate records may double-count transactions in regulatory reports."),
)
NO_RISK = "No regulatory compliance risks identified."


def _dims(spark):
    return spark.createDataFrame([(d, i) for i, d in enumerate(G.DIMENSIONS)], "dimension string, dim_order int")


def _texts(spark):
    return spark.createDataFrame(list(RULE_TEXT), "rule string, issue string, phrase string, all_phrase string, "
                                                  "action string, action_template string")


def issues(rule_rows: DataFrame) -> DataFrame:
    """One issue per (rule, column) with bad > 0, plus a healthy row for every clean dimension."""
    spark = rule_rows.sparkSession
    col = F.col("column_name")
    found = (rule_rows.where(F.col("bad") > 0)
             .join(F.broadcast(_texts(spark)), "rule")
             .join(F.broadcast(_dims(spark)), "dimension"))
    all_bad = F.concat(F.lit("All "), col, F.lit(" values are "), F.col("all_phrase"), F.lit(" ("),
                       F.col("distinct_values").cast("string"), F.lit(" distinct values observed)"))
    desc = F.when(F.col("bad") == F.col("eligible"), all_bad).otherwise(
        count_sentence(F.col("bad"), F.col("eligible"), F.replace(F.col("phrase"), F.lit("{column}"), col)))
    found = found.select("dimension", "dim_order", "rule", "column_name", "issue",
                         F.array(col).alias("affected_columns"), desc.alias("description"), "bad", "eligible")
    healthy = (_dims(spark).join(found.select("dimension").distinct(), "dimension", "left_anti")
               .select("dimension", "dim_order", F.lit(None).cast("string").alias("rule"),
                       F.lit(None).cast("string").alias("column_name"), F.lit(G.HEALTHY_ISSUE).alias("issue"),
                       F.array().cast("array<string>").alias("affected_columns"),
                       F.lit(G.HEALTHY_DESCRIPTION).alias("description"),
                       F.lit(0).cast("bigint").alias("bad"), F.lit(0).cast("bigint").alias("eligible")))
    return found.unionByName(healthy)


def reportable(issue_rows: DataFrame) -> DataFrame:
    """Issues worth showing: some affected column, and not the healthy placeholder."""
    return issue_rows.where((F.size("affected_columns") > 0) & (F.col("issue") != G.HEALTHY_ISSUE))


def _priority(bad, eligible):
    b = bad.cast("decimal(38,0)") * 100
    e = eligible.cast("decimal(38,0)")
    p = F.lit(5)
    for i, share in reversed(list(enumerate(G.PRIORITY_SHARE_BUCKETS))):
        p = F.when(b >= e * int(round(share * 100)), F.lit(i + 1)).otherwise(p)
    return p


def remediation_actions(rule_rows: DataFrame) -> DataFrame:
    """One action per failing rule; priority 1 (most urgent) .. 5 by the worst share of bad values."""
    spark = rule_rows.sparkSession
    per_rule = (rule_rows.where(F.col("bad") > 0)
                .groupBy("rule")
                .agg(F.min(_priority(F.col("bad"), F.col("eligible"))).alias("priority"),
                     F.array_join(F.array_sort(F.collect_set("column_name")), ", ").alias("columns")))
    return (per_rule.join(F.broadcast(_texts(spark)), "rule")
            .select("rule", "action", F.col("priority").cast("int").alias("priority"),
                    F.replace(F.col("action_template"), F.lit("{columns}"), F.col("columns")).alias("description")))


def compliance_risks(rule_rows: DataFrame) -> DataFrame:
    """Distinct risk texts triggered by failing rules on columns of the matching class."""
    spark = rule_rows.sparkSession
    risks = spark.createDataFrame(list(RISK_TEXT), "rule string, column_class string, severity int, risk string")
    name = F.col("column_name")
    in_class = (F.when(F.col("column_class") == "kyc", name_has_any(name, G.KYC_TOKENS))
                .when(F.col("column_class") == "personal", name_has_any(name, G.PERSONAL_TOKENS))
                .when(F.col("column_class") == "monetary", name_has_any(name, G.MONETARY_TOKENS))
                .otherwise(F.lit(True)))
    return (rule_rows.where(F.col("bad") > 0).join(F.broadcast(risks), "rule")
            .where(in_class).select("severity", "risk").distinct())
