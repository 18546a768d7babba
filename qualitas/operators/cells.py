"""Cells, frequency table and per-value facts: the shared scan of every profile.

    cells  = df as text -> a row per cell (*by, column_name, value)
    freq   = cells.groupBy(*by, column_name, value).count()       one shuffle, map-side combine
    facts  = freq + presence / number / date / pattern flags        scalars once per DISTINCT value

All column statistics are aggregations of ``facts`` weighted by ``n``, so the
source is scanned once and every value-level expression runs once per
distinct value.  A hot value (one value holding a third of the rows) is
collapsed by the partial aggregation before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.functions import grammar as G
from qualitas.functions.predicates import (
    as_text, is_present, is_number_like, is_year_only, parse_timestamp,
)


def profiled_columns(df: DataFrame, columns=None, by=()) -> list[str]:
    cols = list(columns) if columns else list(df.columns)
    return [c for c in cols if c not in set(by)]


def cells(df: DataFrame, columns=None, by=()) -> DataFrame:
    """Long form ``(*by, column_name, value)``; one row per cell, values as text."""
    by = list(by)
    cols = profiled_columns(df, columns, by)
    fields = {f.name: f for f in df.schema.fields}
    wide = df.select(*[F.col(f"`{b}`") for b in by], *[as_text(fields[c]).alias(c) for c in cols])
    # not DataFrame.unpivot: whole-stage code of a wide aggregate on top of it does not compile (Spark 4.1)
    return wide.select(*[F.col(f"`{b}`") for b in by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in cols])))


def frequency(df: DataFrame, columns=None, by=()) -> DataFrame:
    """``(*by, column_name, value, n)``: how often each value occurs in each column."""
    return (cells(df, columns, by)
            .groupBy(*by, "column_name", "value")
            .agg(F.count(F.lit(1)).alias("n")))


#: Values up to this many bytes are their own key; of longer ones the key has so many first characters.
KEY_BYTES, KEY_CHARS = 64, 40


def value_key(value):
    """A value's key: itself, or for a long one its first characters and a digest, so no long text is shuffled."""
    return F.when(F.octet_length(value) <= KEY_BYTES, value).otherwise(
        F.concat(F.substring(value, 1, KEY_CHARS), F.lit("\u0000"), F.sha2(value, 256)))


def value_counts(df: DataFrame, columns=None, by=()) -> DataFrame:
    """``(*by, column_name, value, n)`` of present values, long ones as their keys: one shuffle, combined map-side."""
    return count_values(cells(df, columns, by), by)


def count_values(cells: DataFrame, by=()) -> DataFrame:
    """``value_counts`` of cells."""
    return (cells.where(is_present(F.col("value"))).select(*by, "column_name", value_key(F.col("value")).alias("value"))
            .groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def distinct_counts(counts: DataFrame, by=()) -> DataFrame:
    """``(*by, column_name, distinct_values)`` of ``value_counts``."""
    # `n > 0` always holds; with it this branch reads the same exchange as one that ranks values by n
    return counts.groupBy(*by, "column_name").agg(F.count_if(F.col("n") > 0).cast("bigint").alias("distinct_values"))


def long_texts(cells: DataFrame, keys: DataFrame, by=()) -> DataFrame:
    """The texts of long keys: ``(*by, column_name, value, text)``; ``keys`` holds k values a column, so it is broadcast."""
    names = [*by, "column_name", "value"]
    wanted = keys.where(F.octet_length("value") > KEY_BYTES).select(*names)
    long = (cells.where(F.octet_length("value") > KEY_BYTES)
            .select(*by, "column_name", value_key(F.col("value")).alias("value"), F.col("value").alias("text")))
    return long.join(F.broadcast(wanted), names).groupBy(*names).agg(F.first("text").alias("text"))


_KINDS = (("i", (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)),
          ("f", (T.FloatType, T.DoubleType)),
          ("t", (T.DateType, T.TimestampType, T.TimestampNTZType)),
          ("b", (T.BooleanType,)))


def column_kinds(df: DataFrame, columns=None, by=()) -> dict:
    """Column name -> value kind from the schema: i(ntegral/decimal), f(loat), t(emporal), b(oolean), s(tring/other)."""
    out = {}
    for f in df.schema.fields:
        if f.name in set(by) or (columns and f.name not in columns):
            continue
        out[f.name] = next((k for k, types in _KINDS if isinstance(f.dataType, types)), "s")
    return out


#: All date patterns start so.  The parser behind it is called as a function of its own (a lambda): written into the
#: generated code of the cells it makes a method too large for the JVM to compile.
_DATE_START = r"^\d\d"


def facts(freq: DataFrame, day_first: bool = False, code_pattern: str = G.CODE_PATTERN,
          kinds: dict | None = None) -> DataFrame:
    """Per distinct value: presence, number, date and pattern facts.

    ``kinds`` (from ``column_kinds``) lets typed columns skip the text grammar:
    the text of an integer is always number-like and can only be a date as a
    bare year; a float is number-like unless NaN/Infinity and never a date;
    a date/timestamp is an ISO date and never a number.  The results equal the
    full grammar's; only text columns pay for the regular expressions.  On a
    near-unique typed column that is the difference between one regex per
    cell and none.
    """
    v = F.col("value")
    present = is_present(v)
    kind = F.lit("s")
    if kinds:
        typed = {}
        for name, k in kinds.items():
            typed.setdefault(k, []).append(name)
        kind = None
        for k, names in typed.items():
            if k == "s":
                continue
            cond = F.col("column_name").isin(*names)
            kind = F.when(cond, F.lit(k)) if kind is None else kind.when(cond, F.lit(k))
        kind = F.lit("s") if kind is None else kind.otherwise(F.lit("s"))
    num_text = present & is_number_like(v)
    year_text = present & is_year_only(v)
    is_num = (F.when(kind == "i", present)
              .when(kind == "f", present & ~v.isin("NaN", "Infinity", "-Infinity"))
              .when(kind.isin("t", "b"), F.lit(False))
              .otherwise(num_text))
    year_only = F.when(kind == "i", year_text).when(kind.isin("f", "t", "b"), F.lit(False)).otherwise(year_text)
    year_ts = F.when(year_text & (v.try_cast("int") <= G.YEAR_MAX),
                     F.concat(v, F.lit("-01-01")).try_cast("timestamp_ntz"))
    ts = F.when(~present, F.lit(None).cast("timestamp_ntz")) \
        .when(kind == "t", v.try_cast("timestamp_ntz")) \
        .when(kind == "i", year_ts) \
        .when(kind.isin("f", "b"), F.lit(None).cast("timestamp_ntz")) \
        .otherwise(F.element_at(F.transform(F.array(F.when(kind == "s", v)), lambda x: F.when(
            x.rlike(_DATE_START), parse_timestamp(x, day_first))), 1))
    text_only = lambda pattern: F.when(kind == "s", present & F.coalesce(v.rlike(pattern), F.lit(False))) \
        .otherwise(F.lit(False))
    return freq.select(
        "*",
        present.alias("present"),
        is_num.alias("is_num"),
        F.when(is_num, v.try_cast("double")).alias("num"),
        ts.alias("ts"),
        year_only.alias("year_only"),
        text_only(code_pattern).alias("is_code"),
        F.when(kind == "t", present).otherwise(text_only(G.ISO_DATE_PREFIX)).alias("is_iso"),
        text_only(G.CURRENCY_PATTERN).alias("is_currency"),
    )


def facts_of(df: DataFrame, columns=None, by=(), day_first: bool = False) -> DataFrame:
    """``facts(frequency(df))`` with the typed fast path taken from ``df``'s schema."""
    return facts(frequency(df, columns, by), day_first=day_first, kinds=column_kinds(df, columns, by))


def cell_facts(df: DataFrame, columns=None, by=(), day_first: bool = False) -> DataFrame:
    """Per-CELL facts (``n = 1`` per row): what every statistic but distinct counts and top values is made from.

    No value shuffle at all: a weighted sum over ``facts`` is the same sum
    over cells, aggregated per column with a map-side partial aggregate (one
    row per column per task).  Distinct counts and top values come from
    ``value_counts``, or from sketches in an approximate audit.
    """
    c = cells(df, columns, by).withColumn("n", F.lit(1).cast("bigint"))
    return facts(c, day_first=day_first, kinds=column_kinds(df, columns, by))
