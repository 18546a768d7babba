"""The registered queries: one function ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver's tables (or the fixture Spark derives from them) in
full and returns a flat DataFrame whose column names match the oracle SQL.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.functions.urls import is_public_url, is_valid_table_name
from qualitas.operators import crosscol, findings, profile as P, rules as R, score as S, windows as W
from qualitas.operators.approx import approx_profile
from qualitas.operators.cells import cells, column_kinds
from qualitas.operators.discovery import candidate_keys, inclusion_dependencies
from qualitas.operators.evidence import evidence, iban_digits, luhn_digit
from qualitas.operators.formats import formats
from qualitas.operators.sampling import bottom_k
from qualitas.operators.states import merged_profile, write_states
from qualitas.plans import document as D
from qualitas.plans.audit import Audit
from qualitas.plans.many import Datasets
from qualitas.plans.report import (
    append_history, first_risk, read_reports, remediation_report as _report, write_profile_json, write_reports,
)
from qualitas.session import work_folder
from qualitas.sources.bson import read_bson, write_bson
from qualitas.sources.readers import read_csv, read_json_array, read_json_documents
from qualitas.sources.tables import load_dirty_payments, table
from qualitas.streaming.windowed import latest_windows, stream_profile_to_history, windowed_profile as _windowed

AS_OF_ORDERS = "2000-06-01"
AS_OF_EVENTS = "2024-01-20"
RULE_COLUMNS = ["dimension", "rule", "column_name", "bad", "eligible"]


def _dirty(spark, sf_dir):
    return load_dirty_payments(spark, sf_dir)


def _dirty_audit(spark, sf_dir, **options) -> Audit:
    return Audit(_dirty(spark, sf_dir), "dirty_payments", as_of=AS_OF_ORDERS, keys=["txn_id"],
                 parents={"client_id": (table(spark, sf_dir, "customer"), "c_custkey")}, **options)


def _land(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder, for what a query writes before it reads it back."""
    return work_folder(spark, name)


def _profile_flat(prof: DataFrame) -> DataFrame:
    return prof.select("column_name", "inferred_data_type", "null_count", "null_ratio", "unique_count",
                       "unique_ratio", F.array_join("sample_values_masked", ",").alias("sample_values_masked"))


# ------------------------------------------------------------------ profile
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_flat(_dirty_audit(spark, sf_dir).columns)


def _numeric_flat(df: DataFrame) -> DataFrame:
    return df.select("column_name", "numeric_count", "min_value", "max_value",
                     F.round("mean", 6).alias("mean"), "negative_value_ratio")


def numeric_stats(spark, sf_dir):
    return _numeric_flat(_dirty_audit(spark, sf_dir).numeric)


def numeric_stats_blank_as_zero(spark, sf_dir):
    return _numeric_flat(_dirty_audit(spark, sf_dir, blank_as_zero=True).numeric)


def categorical_top3(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).categorical


def _temporal_flat(df):
    return df.select("column_name", "row_count", "date_count", "min_timestamp", "max_timestamp",
                     "future_timestamp_ratio", "stale_record_ratio")


def temporal_stats(spark, sf_dir):
    return _temporal_flat(_dirty_audit(spark, sf_dir).temporal)


def pattern_stats(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).patterns


def compliance_flags(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).flags


def dataset_summary(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).dataset.select("dataset_name", "row_count", "column_count",
                                                      "detected_domain")


def duplicate_rows(spark, sf_dir):
    return crosscol.duplicate_summary(_dirty(spark, sf_dir))


def dependent_nulls(spark, sf_dir):
    return crosscol.dependent_nulls(_dirty(spark, sf_dir))


# -------------------------------------------------------------------- rules
def _column_rule(*names):
    def q(spark, sf_dir):
        columns = _dirty(spark, sf_dir).columns
        wanted = [c for c in columns if any(c in R.rule_columns(n, columns) for n in names)]
        a = _dirty_audit(spark, sf_dir, columns=wanted)
        return R.column_rules(a.summary).where(F.col("rule").isin(*names)).select(*RULE_COLUMNS)
    return q


def rule_pan_length(spark, sf_dir):
    return R.pan_length_rule(_dirty(spark, sf_dir)).select(*RULE_COLUMNS)


def rule_orphans(spark, sf_dir):
    return R.orphan_rule(_dirty(spark, sf_dir), "client_id", table(spark, sf_dir, "customer"),
                         "c_custkey").select(*RULE_COLUMNS)


def rule_uniqueness(spark, sf_dir):
    """Duplicate rows and duplicate keys from one grouping-sets scan."""
    rows = R.row_rules(_dirty(spark, sf_dir), keys=["txn_id"])
    return rows.where(F.col("dimension") == "Uniqueness").select(*RULE_COLUMNS)


# ------------------------------------------------------- findings and scores
def issues(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).issues.select(
        "dimension", "rule", "column_name", "issue", "description", "bad", "eligible")


def reportable_issues(spark, sf_dir):
    return findings.reportable(_dirty_audit(spark, sf_dir).issues).select(
        "dimension", "rule", "column_name", "issue", "description")


def remediation_actions(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).actions


def compliance_risks(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).risks


def headline_risk(spark, sf_dir):
    """T5: the first compliance risk by severity, else the default text."""
    return first_risk(_dirty_audit(spark, sf_dir).risks)


def dimension_scores(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).scores.select("dimension", "bad", "eligible", "score")


def composite_score(spark, sf_dir):
    return _dirty_audit(spark, sf_dir).composite.select("composite_dqs")


# ------------------------------------------------- documents, report, merge
def _contract_summary(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (key, json) through pick, contract and range checks."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    checked = D.validate_analysis(D.parse_analysis(D.pick_analysis(docs)))
    return checked.select(
        key, "status", "composite_dqs", count("data_quality_issues").alias("issue_count"),
        count("remediation_actions").alias("action_count"), count("regulatory_compliance_risks").alias("risk_count"),
        "accepted", "reason")


def _analysis_summary(a: Audit) -> DataFrame:
    return _contract_summary(D.analysis_json(a).withColumn("dataset_name", F.lit(a.name)), "dataset_name")


def contract_own_document(spark, sf_dir):
    """The analysis document that the engine writes passes its own contract."""
    return _analysis_summary(_dirty_audit(spark, sf_dir))


def order_documents(orders: DataFrame) -> DataFrame:
    """An analysis document for every order, many of them broken in one way or several (by the order's key).

    Fields are missing (4th, 9th, 11th, 13th key), a score lies outside 0..1 (10th), priorities are 0 or 6 (7th),
    an issue lacks its dimension (17th) or an action its text (19th); the 3rd are nested, the 5th carry unknown
    fields, the 6th lack optional ones.
    """
    k = F.col("o_orderkey")
    gone = lambda n, c: F.when(k % n != 0, c)
    issues = F.array(F.struct(gone(17, F.lit("Validity")).alias("dimension"), F.col("o_orderstatus").alias("issue"),
                              F.array(F.lit("o_totalprice")).alias("affected_columns")),
                     F.struct(F.lit("Accuracy").alias("dimension"), F.lit("late").alias("issue"),
                              F.array(F.lit("o_orderdate")).alias("affected_columns")))
    priority = F.when(k % 14 == 0, 0).when(k % 7 == 0, 6).otherwise(1 + k % 5)
    actions = F.array(F.struct(gone(19, F.col("o_orderpriority")).alias("action"), priority.cast("int").alias("priority")))
    composite = F.when(k % 10 == 0, F.lit(1.25)).otherwise((k % 100) / 100)
    document = F.struct(
        gone(6, F.lit("done")).alias("status"), gone(4, issues).alias("data_quality_issues"),
        gone(9, actions).alias("remediation_actions"), gone(6, F.array(F.lit("risk"))).alias("regulatory_compliance_risks"),
        gone(13, composite).alias("composite_dqs"),
        gone(11, F.create_map(F.lit("Validity"), F.lit(0.5))).alias("dimension_scores"),
        F.when(k % 5 == 0, F.col("o_orderkey")).alias("unknown_field"))
    nested = F.to_json(F.struct(document.alias("genai_insights"), F.lit(1).alias("other")))
    return orders.select("o_orderkey", F.when(k % 3 == 0, nested).otherwise(F.to_json(document)).alias("json"))


def contract_quarantine(spark, sf_dir):
    """Contract, range and nested-result checks over a document for every order: accepted and rejected with reason."""
    return _contract_summary(order_documents(table(spark, sf_dir, "orders")), "o_orderkey")


def audit_merge(spark, sf_dir):
    a = _dirty_audit(spark, sf_dir)
    profile = a.dataset.select("dataset_name", "row_count", "column_count", "detected_domain")
    analysis = _analysis_summary(a).select("dataset_name", "status", "composite_dqs", "issue_count",
                                           "action_count", "risk_count")
    return D.merge_profile_analysis(profile, analysis, "dataset_name")


def remediation_report(spark, sf_dir):
    """The report as the report sink writes it and gives it back."""
    a = _dirty_audit(spark, sf_dir)
    folder = _land(spark, "reports")
    write_reports(_report(a.name, a.as_of, a.composite, a.issues, a.actions, a.risks), folder)
    return read_reports(spark, folder)


def issues_all_values(spark, sf_dir):
    """Findings on columns whose every value breaks the rule ("All ... values"): old order dates, no customer at all."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("txn_id"),
                                                   F.lit("").alias("email"),
                                                   F.date_format("o_orderdate", "MM/dd/yyyy").alias("txn_date"))
    a = Audit(orders, "orders", as_of="2031-01-01", keys=["txn_id"])
    return findings.reportable(a.issues).select("dimension", "rule", "column_name", "issue", "description")


# ------------------------------------------------------- sources and sinks
def source_csv(spark, sf_dir):
    """The fixture landed as CSV files and profiled through the CSV reader."""
    folder = _land(spark, "csv")
    _dirty(spark, sf_dir).write.csv(folder, header=True, quote='"', escape='"')
    return _profile_flat(Audit(read_csv(spark, folder), "csv", as_of=AS_OF_ORDERS).columns)


def source_csv_scores(spark, sf_dir):
    """Dimension scores of the fixture landed as CSV files and audited as they are read."""
    folder = _land(spark, "csv")
    _dirty(spark, sf_dir).write.csv(folder, header=True, quote='"', escape='"')
    a = Audit(read_csv(spark, folder), "csv", as_of=AS_OF_ORDERS, keys=["txn_id"],
              parents={"client_id": (table(spark, sf_dir, "customer"), "c_custkey")})
    return a.scores.select("dimension", "bad", "eligible", "score")


def order_notes(orders: DataFrame) -> DataFrame:
    """Orders with a text of several lines, quotes and separators."""
    key = F.col("o_orderkey")
    note = F.concat(F.lit('said "'), F.col("o_orderstatus"), F.lit('",\nthen\r\n"'), (key % 100).cast("string"), F.lit('"'))
    return orders.select(key.cast("string").alias("order_id"), F.when(key % 7 != 0, note).alias("note"),
                         F.col("o_orderpriority").alias("priority"))


def source_csv_multiline(spark, sf_dir):
    """Texts of several lines landed as CSV files, read by ranges and audited."""
    folder = _land(spark, "csv-multiline")
    order_notes(table(spark, sf_dir, "orders")).write.csv(folder, header=True, quote='"', escape='"')
    a = Audit(read_csv(spark, folder, multiline=True, split_bytes=1 << 20), "notes", as_of=AS_OF_ORDERS)
    return a.categorical


def categorical_documents(spark, sf_dir):
    """Top values of the documents' texts, also under a common opening that is longer than a value's key."""
    docs = table(spark, sf_dir, "documents")
    opened = docs.select("text", F.concat(F.lit("All of these texts begin with one and the same long sentence. " * 4), "text")
                         .alias("opened"), "lang")
    return Audit(opened, "texts", as_of=AS_OF_ORDERS).categorical


def sample_rows(spark, sf_dir):
    """Exactly 1000 rows of ``lineitem``, the ones of the least priorities."""
    return bottom_k(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 1000, seed=7,
                    keys=["l_orderkey", "l_linenumber"])


#: Tables whose references are looked for.
REFERRING = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def find_references(spark, sf_dir):
    """Columns of whole numbers whose values all occur in a unique column: the candidates for foreign keys."""
    frames = {name: table(spark, sf_dir, name) for name in REFERRING}
    whole = {name: [c for c, kind in column_kinds(df).items() if kind == "i"] for name, df in frames.items()}
    return inclusion_dependencies(frames, whole).where("parent_unique").drop("parent_unique")


def find_keys(spark, sf_dir):
    """Minimal keys of one or two columns of each table."""
    found = [candidate_keys(table(spark, sf_dir, name)).select(F.lit(name).alias("table_name"),
                                                               F.array_join("columns", ",").alias("key_columns"))
             for name in REFERRING]
    return reduce(DataFrame.unionAll, found)


def column_formats(spark, sf_dir):
    """The formats of the values of each column of the fixture."""
    return formats(cells(_dirty(spark, sf_dir))).withColumn("share", F.round("share", 9))


def evidence_payments(orders: DataFrame) -> DataFrame:
    """Personal data under column names that say nothing: card numbers and accounts with right check digits, mail
    addresses, and numbers that only look alike."""
    key = F.col("o_orderkey")
    card = F.concat(F.lit("4"), F.lpad(key.cast("string"), 14, "0"))
    account = F.lpad((key * 7919 + 13).cast("string"), 16, "0")
    return orders.select(
        F.concat(card, luhn_digit(card)).alias("c1"),
        F.concat(F.lit("DE"), iban_digits(F.lit("DE"), account), account).alias("c2"),
        F.when(key % 5 != 0, F.concat(F.lit("u"), key.cast("string"), F.lit("@mail.example"))).otherwise("none").alias("c3"),
        F.concat(F.lit("4"), F.lpad(key.cast("string"), 15, "0")).alias("c4"),
        F.concat(F.lit("DE00"), account).alias("c5"), F.col("o_orderpriority").alias("c6"))


def personal_data_evidence(spark, sf_dir):
    """What the values of neutrally named columns say about personal data."""
    return evidence(cells(evidence_payments(table(spark, sf_dir, "orders")))).withColumn("share", F.round("share", 9))


def source_bson(spark, sf_dir):
    """Orders landed as collection dumps, read back by ranges with a filter on a top-level field, and profiled."""
    folder = _land(spark, "bson")
    orders = table(spark, sf_dir, "orders")
    write_bson(orders, folder)
    schema = T.StructType([f for f in orders.schema.fields])
    read = read_bson(spark, folder, schema, split_bytes=1 << 20, equals={"o_orderstatus": "O"})
    return _profile_flat(Audit(read, "orders", as_of=AS_OF_ORDERS).columns)


def audit_incremental(spark, sf_dir):
    """Orders profiled by years into a history of states, the last year later than the others, and merged; without
    the estimates, for SQL."""
    whole = audit_incremental_sketches(spark, sf_dir).drop("distinct_estimate", "top_values")
    return whole.withColumn("mean", F.round("mean", 6))


def audit_incremental_sketches(spark, sf_dir):
    """The whole merged profile, with its distinct estimates and top values."""
    folder, orders = _land(spark, "states"), table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    last = orders.agg(F.max(year)).first()[0]
    write_states(orders.where((year < last) | year.isNull()), folder, "orders", year)
    write_states(orders.where(year == last), folder, "orders", str(last))
    return merged_profile(spark.read.parquet(folder), "orders")


def source_json_documents(spark, sf_dir):
    """The fixture landed as JSON lines, NULL fields left out, and profiled through the document reader."""
    folder = _land(spark, "json-lines")
    _dirty(spark, sf_dir).write.json(folder)
    return _profile_flat(Audit(read_json_documents(spark, folder), "json", as_of=AS_OF_ORDERS).columns)


def source_json_array(spark, sf_dir):
    """The fixture landed as JSON arrays of about 10,000 records each and profiled through the payload reader."""
    folder, rows = _land(spark, "json-arrays"), _dirty(spark, sf_dir)
    arrays = F.greatest(F.lit(1), F.ceil(rows.agg(F.count(F.lit(1))).scalar() / 10_000))
    (rows.select(F.to_json(F.struct("*")).alias("record"), F.pmod(F.xxhash64("txn_id"), arrays).alias("payload"))
     .groupBy("payload").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("value"))
     .select("value").write.text(folder))
    return _profile_flat(Audit(read_json_array(spark, folder), "array", as_of=AS_OF_ORDERS).columns)


def sink_audit_history(spark, sf_dir):
    """Two audits of ``lineitem`` and one of ``orders`` appended to a history table, and the latest of each dataset."""
    folder = _land(spark, "history")
    for name, as_of in (("lineitem", "2000-01-01"), ("orders", "2000-01-01"), ("lineitem", "2000-06-01")):
        append_history(Audit(table(spark, sf_dir, name), name, as_of=as_of).dataset.drop("dataset_id"), folder)
    history = spark.read.parquet(folder)
    return W.latest_per_key(history, "dataset_name", "ingestion_timestamp").select(
        "dataset_name", "row_count", "column_count", "detected_domain",
        F.date_format("ingestion_timestamp", D.ISO).alias("ingestion_timestamp"))


# ------------------------------------------------------------ windows
def transcripts_tail(spark, sf_dir):
    return W.transcripts_tail(table(spark, sf_dir, "conversations"))


def transcripts_tail_4(spark, sf_dir):
    return W.transcripts_tail(table(spark, sf_dir, "conversations"), keep=4)


def audit_history_latest(spark, sf_dir):
    """Daily audit runs of ``events`` per event type, and the latest run of each."""
    ev = table(spark, sf_dir, "events")
    runs = ev.groupBy(F.col("event_type").alias("dataset_name"), F.to_date("ts").alias("run_date")).agg(
        F.max("ts").alias("ingestion_timestamp"), F.count(F.lit(1)).cast("bigint").alias("row_count"))
    latest = W.latest_per_key(runs, "dataset_name", "ingestion_timestamp")
    return latest.select("dataset_name", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"),
                         F.date_format("ingestion_timestamp", D.ISO).alias("ingestion_timestamp"), "row_count")


# --------------------------------------------------- evaluation, predicates
def detector_evaluation(spark, sf_dir):
    """Duplicate-text detector on ``documents`` scored against ``labels.quality == 0``."""
    truth = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("low_quality"))
    return S.confusion(crosscol.duplicate_evaluation(table(spark, sf_dir, "documents"), ["text"], truth, "doc_id",
                                                     "low_quality"))


def public_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", is_public_url(F.col("url")).alias("is_public"))


def audit_target_filter(spark, sf_dir):
    """Candidate table names (brands, part types, market segments) checked against the name grammar."""
    part, cust = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    names = (part.select(F.explode(F.array("p_brand", "p_type")).alias("target_name"))
             .unionByName(cust.select(F.col("c_mktsegment").alias("target_name"))).distinct())
    return names.select("target_name", is_valid_table_name(F.col("target_name")).alias("is_valid"))


# ------------------------------------------------------ typed table profiles
def profile_lineitem(spark, sf_dir):
    return _profile_flat(Audit(table(spark, sf_dir, "lineitem"), "lineitem", as_of=AS_OF_ORDERS).columns)


def profile_orders_typed(spark, sf_dir):
    a = Audit(table(spark, sf_dir, "orders"), "orders", as_of=AS_OF_ORDERS)
    both = P.profile_finish(P.with_distinct(a.per_column, a.distinct), also=("min_value", "max_value", "mean"))
    return both.select("column_name", "inferred_data_type", "null_count", "unique_count", "min_value", "max_value",
                       F.round("mean", 6).alias("mean"))


MANY = ("region", "nation", "customer", "supplier", "part", "orders")


def _many(spark, sf_dir) -> Datasets:
    return Datasets({name: table(spark, sf_dir, name) for name in MANY}, as_of=AS_OF_ORDERS)


def profile_datasets(spark, sf_dir):
    """Column profiles of six tables in one job."""
    return _many(spark, sf_dir).columns.select("dataset_name", "column_name", "inferred_data_type", "row_count",
                                               "null_count", "unique_count")


def rules_datasets(spark, sf_dir):
    """Column rules of six tables in one job."""
    return _many(spark, sf_dir).rules.select("dataset_name", *RULE_COLUMNS)


def profile_lineitem_approx(spark, sf_dir):
    """One-pass profile: its exact columns, for SQL (``profile_lineitem_sketches`` has the whole result)."""
    return approx_profile(table(spark, sf_dir, "lineitem"), k=None).select(
        "column_name", "inferred_data_type", "null_count", "null_ratio", "numeric_count",
        "min_value", "max_value", "negative_value_ratio", "row_count")


def profile_lineitem_sketches(spark, sf_dir):
    """One-pass profile, the whole result: with its distinct estimates and top values, which no SQL can state."""
    return approx_profile(table(spark, sf_dir, "lineitem"))


def profile_document(spark, sf_dir):
    """The nested profile document of the fixture, written by the profile sink, read back and flattened."""
    a = _dirty_audit(spark, sf_dir)
    a.dataset_id = "dirty_payments"
    a.materialize()            # eight document parts share the small per-column results
    folder = _land(spark, "profiles")
    write_profile_json(D.profile_json(a).select(F.lit(a.name).alias("dataset_name"), "json"), folder)
    doc = spark.read.schema("json string, dataset_name string").json(folder)
    return D.flat_profile(doc)


def windowed_profile(spark, sf_dir):
    out = _windowed(table(spark, sf_dir, "events"), "ts", "1 day")
    return out.withColumn("mean", F.round("mean", 6))


def windowed_profile_stream(spark, sf_dir):
    """The exact columns of ``windowed_profile_stream_sketches``, for SQL."""
    return windowed_profile_stream_sketches(spark, sf_dir).select(
        "window_start", "column_name", "row_count", "null_count", "min_value", "max_value", "negative_count")


def windowed_profile_stream_sketches(spark, sf_dir):
    """X1 as a Structured Streaming job: daily windows of ``events`` streamed into a history table, the last state
    of each, with mean and distinct estimate."""
    folder = _land(spark, "windowed-profile")
    stream_profile_to_history(spark, f"{sf_dir.rstrip('/')}/events.parquet", table(spark, sf_dir, "events").schema, "ts",
                              f"{folder}/history", f"{folder}/checkpoint", dataset_name="events").awaitTermination()
    return latest_windows(spark.read.parquet(f"{folder}/history"))


QUERIES = {
    "column_profile": column_profile,
    "numeric_stats": numeric_stats,
    "numeric_stats_blank_as_zero": numeric_stats_blank_as_zero,
    "categorical_top3": categorical_top3,
    "temporal_stats": temporal_stats,
    "pattern_stats": pattern_stats,
    "compliance_flags": compliance_flags,
    "dataset_summary": dataset_summary,
    "duplicate_rows": duplicate_rows,
    "dependent_nulls": dependent_nulls,
    "rule_completeness": _column_rule("missing_values"),
    "rule_range": _column_rule("out_of_range"),
    "rule_negative_amount": _column_rule("negative_amount"),
    "rule_future_dates": _column_rule("future_timestamp"),
    "rule_mixed_type": _column_rule("numeric_as_string", "datetime_as_string"),
    "rule_currency_symbol": _column_rule("currency_symbol"),
    "rule_non_iso_date": _column_rule("non_iso_date"),
    "rule_pan_length": rule_pan_length,
    "rule_freshness": _column_rule("stale_records"),
    "rule_orphans": rule_orphans,
    "rule_uniqueness": rule_uniqueness,
    "issues": issues,
    "reportable_issues": reportable_issues,
    "remediation_actions": remediation_actions,
    "compliance_risks": compliance_risks,
    "headline_risk": headline_risk,
    "dimension_scores": dimension_scores,
    "composite_score": composite_score,
    "contract_quarantine": contract_quarantine,
    "contract_own_document": contract_own_document,
    "audit_merge": audit_merge,
    "remediation_report": remediation_report,
    "issues_all_values": issues_all_values,
    "source_csv": source_csv,
    "source_csv_scores": source_csv_scores,
    "source_csv_multiline": source_csv_multiline,
    "categorical_documents": categorical_documents,
    "sample_rows": sample_rows,
    "find_references": find_references,
    "find_keys": find_keys,
    "column_formats": column_formats,
    "personal_data_evidence": personal_data_evidence,
    "source_bson": source_bson,
    "audit_incremental": audit_incremental,
    "audit_incremental_sketches": audit_incremental_sketches,
    "source_json_documents": source_json_documents,
    "source_json_array": source_json_array,
    "sink_audit_history": sink_audit_history,
    "transcripts_tail": transcripts_tail,
    "transcripts_tail_4": transcripts_tail_4,
    "audit_history_latest": audit_history_latest,
    "detector_evaluation": detector_evaluation,
    "public_url_filter": public_url_filter,
    "audit_target_filter": audit_target_filter,
    "profile_lineitem": profile_lineitem,
    "profile_orders_typed": profile_orders_typed,
    "profile_datasets": profile_datasets,
    "rules_datasets": rules_datasets,
    "windowed_profile": windowed_profile,
    "profile_lineitem_approx": profile_lineitem_approx,
    "profile_lineitem_sketches": profile_lineitem_sketches,
    "profile_document": profile_document,
    "windowed_profile_stream": windowed_profile_stream,
    "windowed_profile_stream_sketches": windowed_profile_stream_sketches,
}
