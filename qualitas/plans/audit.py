"""``audit(df, name, ...)``: every profile, rule and score of one dataset as DataFrames.

Plan shape:

    source --unpivot--> cells --project--> facts per cell --groupBy(column)--> ``per_column``
        one shuffle of at most one row per column and task; it feeds the profile, numeric, temporal and pattern
        statistics and all column rules, exactly; a single output prunes the other aggregates away
    cells --groupBy(column, value key)--> ``counts``       distinct counts and top values only
    source --groupBy(row digest)--> duplicates | card-number lengths;  child keys --> orphans

``materialize()`` writes the small results (``per_column``, top values, distinct counts) into the cluster's
checkpoint folder, so all outputs read them and lineage is cut (survives executor loss).  The rule table (at most
rules x columns rows) is checkpointed when it is first used; every finding, score and report reads it.

Approximate mode (``approx=True``): distinct counts and top values come from sketches in ``per_column``, so values
are never shuffled; every other count is as exact as without.
"""
from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.operators import cells as C
from qualitas.operators import crosscol, findings, profile as P, rules as R, score as S
from qualitas.operators.sampling import bottom_k
from qualitas.session import ensure_checkpoint_dir, work_folder


class Audit:
    def __init__(self, df: DataFrame, name: str, *, as_of, columns=None, domain: str = G.DEFAULT_DOMAIN,
                 sample_fraction: float | None = None, sample_rows: int | None = None, sample_seed: int = 0, blank_as_zero: bool = False, day_first: bool = False,
                 range_rules=G.DEFAULT_RANGE_RULES, keys=None, parents: dict | None = None,
                 pan_columns=("card_brand", "card_number"), dependent_null_columns=None,
                 freshness_years: int = G.FRESHNESS_YEARS, weights: dict | None = None,
                 dataset_id: str | None = None, checkpoint_rules: bool = True, approx: bool = False):
        read = df if sample_fraction is None else df.sample(float(sample_fraction), int(sample_seed))
        read = read if sample_rows is None else bottom_k(read, int(sample_rows), int(sample_seed))
        # malformed rows as the readers keep them are counted (see rules); the column is none of the dataset's
        self.malformed = read if G.CORRUPT_COLUMN in df.columns and not columns else None
        names = list(columns) if columns else [c for c in df.columns if c != G.CORRUPT_COLUMN]
        self.source = read.select(*[F.col(f"`{c}`") for c in names])
        self.name = name
        self.as_of = as_of
        self.domain = domain
        self.blank_as_zero = blank_as_zero
        self.day_first = day_first
        self.range_rules = range_rules
        self.keys = keys
        self.parents = parents or {}
        self.pan_columns = pan_columns
        self.dependent_null_columns = dependent_null_columns
        self.freshness_years = freshness_years
        self.weights = weights
        self.dataset_id = dataset_id
        self.checkpoint_rules = checkpoint_rules
        self.approx = approx
        self.spark = df.sparkSession

    # ------------------------------------------------------------ shared scan
    @cached_property
    def facts(self) -> DataFrame:
        """Facts of every cell."""
        return C.cell_facts(self.source, day_first=self.day_first)

    def _small(self, df: DataFrame) -> DataFrame:
        """A table of a few rows per column, checkpointed where the session has a place for it."""
        return df.checkpoint(eager=True) if ensure_checkpoint_dir(self.spark) is not None else df

    def materialize(self) -> "Audit":
        """Compute the small per-column results once, into the checkpoint folder."""
        self.__dict__["per_column"] = self._small(self.per_column)
        if not self.approx:
            self.__dict__["categorical"] = self._small(self.categorical)
            self.__dict__["distinct"] = self.categorical.select("column_name", "distinct_values").distinct()
        return self

    @cached_property
    def per_column(self) -> DataFrame:
        """Every per-column aggregate in one scan and one shuffle of a row per column and task."""
        aggregates = {**P.profile_aggregates(), **P.numeric_aggregates(), **P.temporal_aggregates(self.as_of),
                      **P.pattern_aggregates(),
                      **R.summary_aggregates(self.as_of, self.freshness_years, self.range_rules)}
        if self.approx:
            aggregates |= P.approx_top_aggregates()
        f = self.facts.select("*", *P.numeric_inputs(self.facts, self.blank_as_zero))
        wide = f.groupBy("column_name").agg(*P.named(aggregates))
        return self._small(wide) if self.approx and self.checkpoint_rules else wide

    @cached_property
    def counts(self) -> DataFrame:
        """How often each present value occurs (long ones by digest): the only shuffle of values."""
        return C.value_counts(self.source)

    @cached_property
    def distinct(self) -> DataFrame:
        if self.approx:
            return self.per_column.select("column_name", "distinct_values")
        return C.distinct_counts(self.counts)

    # ---------------------------------------------------------------- profile
    @cached_property
    def columns(self) -> DataFrame:
        return P.profile_finish(P.with_distinct(self.per_column.drop("distinct_values"), self.distinct),
                                columns=list(self.source.columns))

    @cached_property
    def numeric(self) -> DataFrame:
        return P.numeric_finish(self.per_column)

    @cached_property
    def categorical(self) -> DataFrame:
        """Top values and distinct counts; of long values only ties are compared, and only top ones fetched.

        Values are counted when this is first used (the counts' top is a written table)."""
        if self.approx:
            return P.approx_categorical_finish(self.per_column)
        return P.top_values(C.cells(self.source), work_folder(self.spark, "top-values"))

    @cached_property
    def temporal(self) -> DataFrame:
        return P.temporal_finish(self.per_column)

    @cached_property
    def patterns(self) -> DataFrame:
        return P.pattern_finish(self.per_column)

    @cached_property
    def flags(self) -> DataFrame:
        names = self.spark.createDataFrame([(c,) for c in self.source.columns], "column_name string")
        return P.compliance_flags(names)

    @cached_property
    def dataset(self) -> DataFrame:
        """A1: id, name, row and column counts, domain, ingestion time (= as_of)."""
        ncols = len(self.source.columns)
        ds_id = F.lit(self.dataset_id) if self.dataset_id else F.expr("uuid()")
        return self.source.agg(F.count(F.lit(1)).cast("bigint").alias("row_count")).select(
            ds_id.alias("dataset_id"), F.lit(self.name).alias("dataset_name"), "row_count",
            F.lit(ncols).cast("bigint").alias("column_count"), F.lit(self.domain).alias("detected_domain"),
            P._as_of_lit(self.as_of).alias("ingestion_timestamp"))

    @cached_property
    def duplicates(self) -> DataFrame:
        return crosscol.duplicate_summary(self.source)

    @cached_property
    def dependent_nulls(self) -> DataFrame:
        return crosscol.dependent_nulls(self.source, self.dependent_null_columns)

    # ------------------------------------------------------------------ rules
    @cached_property
    def summary(self) -> DataFrame:
        return R.summary_finish(self.per_column)

    @cached_property
    def rules(self) -> DataFrame:
        out = R.with_distinct(R.column_rules(self.summary), self.distinct).unionByName(
            R.row_rules(self.source, keys=self.keys, parents=self.parents, pan_columns=self.pan_columns))
        if self.malformed is not None:
            out = out.unionByName(R.malformed_rule(self.malformed))
        return self._small(out) if self.checkpoint_rules else out

    @cached_property
    def issues(self) -> DataFrame:
        return findings.issues(self.rules)

    @cached_property
    def actions(self) -> DataFrame:
        return findings.remediation_actions(self.rules)

    @cached_property
    def risks(self) -> DataFrame:
        return findings.compliance_risks(self.rules)

    @cached_property
    def scores(self) -> DataFrame:
        return S.dimension_scores(self.rules)

    @cached_property
    def composite(self) -> DataFrame:
        return S.composite_score(self.scores, self.weights)


def audit(df: DataFrame, name: str, *, as_of=None, **kw) -> Audit:
    """Build the lazy audit of ``df``; ``as_of`` defaults to today (pass it for reproducible runs)."""
    if as_of is None:
        as_of = _dt.datetime.now().replace(microsecond=0)
    return Audit(df, name, as_of=as_of, **kw)


def _attach_document_methods():
    """Convenience views on an Audit: documents and the Markdown report."""
    from qualitas.plans import document as D
    from qualitas.plans.report import remediation_report

    def profile_document(self) -> DataFrame:
        return D.profile_json(self).select(F.lit(self.name).alias("dataset_name"), "json")

    def analysis_document(self) -> DataFrame:
        return D.analysis_json(self).select(F.lit(self.name).alias("dataset_name"), "json")

    def report(self) -> DataFrame:
        return remediation_report(self.name, self.as_of, self.composite, self.issues, self.actions, self.risks)

    Audit.profile_document = profile_document
    Audit.analysis_document = analysis_document
    Audit.report = report


_attach_document_methods()
