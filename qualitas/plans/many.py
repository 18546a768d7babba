"""Profiles of many datasets in one job: every statistic keyed by dataset and column."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.operators import cells as C
from qualitas.operators import profile as P
from qualitas.operators import rules as R
from qualitas.session import work_folder

BY = ("dataset_name",)


class Datasets:
    """Datasets by name.  Their cells are one table, so a statistic is one aggregation however many there are."""

    def __init__(self, frames: dict[str, DataFrame], as_of, freshness_years: int = G.FRESHNESS_YEARS,
                 range_rules=G.DEFAULT_RANGE_RULES):
        self.frames = frames
        self.as_of = as_of
        self.options = (freshness_years, range_rules)

    def _all(self, of) -> DataFrame:
        return reduce(DataFrame.unionByName, [of(df).withColumn("dataset_name", F.lit(name))
                                              for name, df in self.frames.items()])

    @property
    def facts(self) -> DataFrame:
        return self._all(C.cell_facts)

    @property
    def distinct(self) -> DataFrame:
        return C.distinct_counts(C.count_values(self._all(C.cells), BY), BY)

    @property
    def columns(self) -> DataFrame:
        return P.column_profile(self.facts, BY, distinct=self.distinct)

    @property
    def numeric(self) -> DataFrame:
        return P.numeric_stats(self.facts, BY)

    @property
    def temporal(self) -> DataFrame:
        return P.temporal_stats(self.facts, self.as_of, BY)

    @property
    def categorical(self) -> DataFrame:
        """Top values and distinct counts."""
        spark = next(iter(self.frames.values())).sparkSession
        return P.top_values(self._all(C.cells), work_folder(spark, "top-values"), BY)

    @property
    def rules(self) -> DataFrame:
        return R.column_rules(R.column_summary(self.facts, self.as_of, BY, *self.options), BY)
