"""Mergeable states of column profiles: a partition of a dataset is profiled alone, and merged with the others.

A state is a row per column: counts, extremes and exact decimal sums, an HLL sketch of the values (distinct count) and
a frequent-items sketch (top values), both binary.  Merging is an aggregation over states, so the profile of a
dataset costs a scan of its newest partition and a few rows of history.  Exact columns of a merged profile equal
those of the whole dataset; the distinct count lies within the sketch's error (a relative standard error of
1.04 / sqrt(2 ** LG_K)), and a top value's count is off by at most 3.5 * rows / TRACKED.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.operators import cells as C
from qualitas.operators import profile as P

LG_K = 14
TRACKED = 1024
#: Sums of DECIMAL(24,6) values keep their digits for 10**14 rows.
SUM_DECIMAL = "decimal(38,6)"


def column_states(df: DataFrame, day_first: bool = False, by=()) -> DataFrame:
    """One state per column of ``df`` (and value of ``by``)."""
    facts = C.cell_facts(df, by=by, day_first=day_first)
    f = facts.select("*", *P.numeric_inputs(facts), P.temporal_date().alias("is_date"))
    n_if = lambda c: F.count_if(c).cast("bigint")
    value = F.when(F.col("present"), C.value_key(F.col("value")))
    return f.groupBy(*by, "column_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("row_count"), n_if(F.col("present")).alias("present_count"),
        F.bool_and(F.when(F.col("present"), F.col("is_num"))).alias("all_num"),
        F.bool_and(F.when(F.col("present"), F.col("ts").isNotNull())).alias("all_date"),
        n_if(F.col("x").isNotNull()).alias("numeric_count"), F.min("x").alias("min_value"), F.max("x").alias("max_value"),
        n_if(F.col("x").isNotNull() & F.col("d").isNull()).alias("inexact_count"),
        F.sum(F.col("d").cast(SUM_DECIMAL)).cast(SUM_DECIMAL).alias("exact_sum"), F.sum("x").alias("double_sum"),
        n_if(F.col("x") < 0).alias("negative_count"), n_if(F.col("is_date")).alias("date_count"),
        F.min(F.when(F.col("is_date"), F.col("ts"))).alias("min_ts"),
        F.max(F.when(F.col("is_date"), F.col("ts"))).alias("max_ts"),
        n_if(F.col("is_code")).alias("match_count"),
        F.hll_sketch_agg(value, F.lit(LG_K)).alias("values_sketch"),
        F.expr(f"approx_top_k_accumulate(CASE WHEN present THEN {_KEY_SQL} END, {TRACKED})").alias("top_sketch"))


#: ``cells.value_key`` in SQL, for functions that are not in the DataFrame API.
_KEY_SQL = (f"CASE WHEN octet_length(value) <= {C.KEY_BYTES} THEN value ELSE "
            f"concat(substring(value, 1, {C.KEY_CHARS}), char(0), sha2(value, 256)) END")


def merge_states(states: DataFrame) -> DataFrame:
    """The state of each column of the union of the parts."""
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    return states.groupBy("column_name").agg(
        total("row_count"), total("present_count"), F.bool_and("all_num").alias("all_num"),
        F.bool_and("all_date").alias("all_date"), total("numeric_count"), F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"), total("inexact_count"),
        F.sum("exact_sum").cast(SUM_DECIMAL).alias("exact_sum"), F.sum("double_sum").alias("double_sum"),
        total("negative_count"), total("date_count"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"),
        total("match_count"), F.hll_union_agg("values_sketch").alias("values_sketch"),
        F.expr("approx_top_k_combine(top_sketch)").alias("top_sketch"))


def profile_of(state: DataFrame, k: int = G.TOP_K) -> DataFrame:
    """Column profile of states: exact counts, types and statistics, estimated distinct count and top values."""
    rows = F.col("row_count")
    inferred = (F.when(F.coalesce(F.col("all_num"), F.lit(True)), F.lit("numeric"))
                .when(F.coalesce(F.col("all_date"), F.lit(True)), F.lit("datetime")).otherwise(F.lit("string")))
    mean = F.when(F.col("numeric_count") > 0, F.when(
        (F.col("inexact_count") == 0) & F.col("exact_sum").isNotNull(),
        (F.col("exact_sum") / F.col("numeric_count")).cast("double")).otherwise(F.col("double_sum") / F.col("numeric_count")))
    top = F.expr(f"approx_top_k_estimate(top_sketch, {int(k) + P.SPARE})")
    return state.select(
        "column_name", inferred.alias("inferred_data_type"), "row_count", (rows - F.col("present_count")).alias("null_count"),
        F.when(rows > 0, (rows - F.col("present_count")) / rows).otherwise(F.lit(0.0)).alias("null_ratio"),
        "numeric_count", "min_value", "max_value", mean.alias("mean"), "negative_count", "date_count",
        F.date_format("min_ts", P.ISO).alias("min_timestamp"), F.date_format("max_ts", P.ISO).alias("max_timestamp"),
        "match_count", F.hll_sketch_estimate("values_sketch").alias("distinct_estimate"),
        F.transform(P.ranked_items(top, k), lambda e: F.struct(e["item"].alias("value"), e["count"].alias("n")))
        .alias("top_values"))


def write_states(df: DataFrame, folder: str, dataset: str, part, day_first: bool = False) -> None:
    """Profile partitions of a dataset and keep their states: ``part`` names the one that ``df`` is, or is a column
    that gives every row's.  The same partition written again replaces its states."""
    rows = df.withColumn("part", F.lit(part) if isinstance(part, str) else part.cast("string"))
    (column_states(rows, day_first, ["part"]).withColumn("dataset_name", F.lit(dataset))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_name", "part").parquet(folder))


def merged_profile(history: DataFrame, dataset: str) -> DataFrame:
    """The profile of a dataset out of the states of its partitions."""
    return profile_of(merge_states(history.where(F.col("dataset_name") == dataset)))
