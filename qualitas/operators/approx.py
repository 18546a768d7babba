"""Approximate profile: one wide aggregation, no value shuffle.

Every column's statistics are computed in a single ``agg`` over the rows
(partial aggregate per task, one row per task shuffled), then unpivoted.
Distinct counts use HyperLogLog (``approx_count_distinct``) and top values
``approx_top_k``; counts, ratios, min/max/mean and type inference stay
exact.  Typed columns skip the text grammar: a numeric column is
number-like wherever it is not NaN/Infinity, a date/timestamp column is a
date wherever it is not NULL.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.functions import grammar as G
from qualitas.functions.predicates import as_text, is_likely_date, is_number_like, is_present
from qualitas.operators.profile import TRACKED, approx_top, ranked_items

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _cell_facts(field: T.StructField):
    """(distinct key, present, is_num, num, is_date) column expressions for one column.

    Typed columns never render a value as text here: a typed non-NULL value is
    present (its text is never empty) and is hashed as it is.
    """
    c = F.col(f"`{field.name}`")
    dt = field.dataType
    if isinstance(dt, _INTEGRAL):
        return c, c.isNotNull(), c.isNotNull(), c.cast("double"), F.lit(False)
    if isinstance(dt, _FRACTIONAL):
        finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        return c, c.isNotNull(), finite, F.when(finite, c.cast("double")), F.lit(False)
    if isinstance(dt, _TEMPORAL):
        return c, c.isNotNull(), F.lit(False), F.lit(None).cast("double"), c.isNotNull()
    if isinstance(dt, T.BooleanType):
        return c, c.isNotNull(), F.lit(False), F.lit(None).cast("double"), F.lit(False)
    v = as_text(field)
    present = is_present(v)
    num_like = present & is_number_like(v)
    return v, present, num_like, F.when(num_like, v.try_cast("double")), present & is_likely_date(v)


def approx_profile(df: DataFrame, columns=None, k: int | None = G.TOP_K, rsd: float = 0.02,
                   tracked: int = TRACKED) -> DataFrame:
    """Per column: inferred type, null and approximate distinct counts, numeric stats, approximate top-k.

    ``tracked`` bounds the frequent-items sketch per column (memory and merge cost per task); ``k=None`` leaves the
    sketch and the ``top_values`` column out.
    """
    fields = {f.name: f for f in df.schema.fields}
    cols = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        v, present, is_num, num, is_date = _cell_facts(fields[c])
        pv = F.when(present, v)
        aggs += [
            F.count_if(present).alias(f"p{i}"),
            F.approx_count_distinct(pv, rsd).alias(f"d{i}"),
            F.bool_and(F.when(present, is_num)).alias(f"an{i}"),
            F.bool_and(F.when(present, is_date)).alias(f"ad{i}"),
            F.min(num).alias(f"mn{i}"), F.max(num).alias(f"mx{i}"),
            F.avg(num).alias(f"av{i}"), F.count(num).alias(f"nc{i}"),
            F.count_if(num < 0).alias(f"ng{i}"),
        ]
        if k is not None:
            aggs.append(approx_top(f"CASE WHEN {_present_sql(fields[c])} THEN {_item_sql(fields[c])} END", k, tracked)
                        .alias(f"t{i}"))
    wide = df.agg(*aggs)
    entries = [F.struct(
        F.lit(c).alias("column_name"), F.lit(i).alias("ordinal"),
        F.col(f"p{i}").alias("present"), F.col(f"d{i}").alias("approx_unique"),
        F.col(f"an{i}").alias("all_num"), F.col(f"ad{i}").alias("all_date"),
        F.col(f"mn{i}").alias("min_value"), F.col(f"mx{i}").alias("max_value"),
        F.col(f"av{i}").alias("mean"), F.col(f"nc{i}").alias("numeric_count"),
        F.col(f"ng{i}").alias("negatives"),
        *([_top_values(F.col(f"t{i}"), fields[c], k)] if k is not None else []))
        for i, c in enumerate(cols)]
    long = wide.select("rows", F.explode(F.array(*entries)).alias("e")).select("rows", "e.*")
    rows = F.col("rows")
    inferred = (F.when(F.coalesce("all_num", F.lit(True)), F.lit("numeric"))
                .when(F.coalesce("all_date", F.lit(True)), F.lit("datetime")).otherwise(F.lit("string")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return long.select(
        "column_name", "ordinal", inferred.alias("inferred_data_type"),
        (rows - F.col("present")).cast("bigint").alias("null_count"),
        ratio(rows - F.col("present"), rows).alias("null_ratio"),
        F.col("approx_unique").cast("bigint").alias("approx_unique_count"),
        ratio(F.col("approx_unique"), rows).alias("unique_ratio"),
        F.col("numeric_count").cast("bigint").alias("numeric_count"), "min_value", "max_value", "mean",
        F.when(F.col("numeric_count") > 0, F.col("negatives") / F.col("numeric_count")).alias("negative_value_ratio"),
        *(["top_values"] if k is not None else []), rows.cast("bigint").alias("row_count"))


def _top_values(top, field: T.StructField, k: int):
    """The sketch's top k as ``array<struct<value, n>>``, values as text."""
    return F.transform(ranked_items(top, k), lambda e: F.struct(
        _item_text(field, e["item"]).alias("value"), e["count"].alias("n"))).alias("top_values")


def _item_sql(field: T.StructField) -> str:
    """Top-k item: the typed value for atomic types, JSON text for nested ones."""
    name = f"`{field.name}`"
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return f"to_json({name})"
    if isinstance(field.dataType, T.BinaryType):
        return f"base64({name})"
    return name


def _item_text(field: T.StructField, item):
    return item if isinstance(field.dataType, (T.StringType, T.StructType, T.ArrayType, T.MapType, T.BinaryType)) \
        else item.cast("string")


def _present_sql(field: T.StructField) -> str:
    name = f"`{field.name}`"
    if isinstance(field.dataType, T.StringType):
        return f"({name} IS NOT NULL AND {name} <> '')"
    return f"({name} IS NOT NULL)"
