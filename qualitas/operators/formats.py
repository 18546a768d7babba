"""The formats of a column's values, as run-length patterns of character classes, merged by description length.

A value's exact pattern replaces upper-case letters by ``A``, lower-case ones by ``a``, digits by ``9`` and letters
beyond ASCII by ``u``; its general pattern forgets how long the runs of a class are (``A+9+``).  Exact patterns under
one general pattern are reported one by one, or as the general one, whichever describes the column in fewer bits:
every pattern has to be written down, every value has to say which pattern it has, and under a general pattern also
how long its runs are.  So ``ORD12345`` stays ``A{3}9{5}`` and free amounts become ``9+.9+``.
"""
from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitas.functions.predicates import is_present

#: Values over so many characters are described by the general pattern of their beginning.
LONGEST = 64
#: Bits to write down a character of a pattern.
CHARACTER_BITS = 8
RUNS = "A+|a+|9+|u+"
_CLASSES = (string.ascii_uppercase + string.ascii_lowercase + string.digits, "A" * 26 + "a" * 26 + "9" * 10)


def exact_pattern(value: Column) -> Column:
    return F.regexp_replace(F.translate(F.substring(value, 1, LONGEST), *_CLASSES), r"[^\x00-\x7f]", "u")


def general_pattern(exact: Column) -> Column:
    return F.regexp_replace(exact, f"({RUNS.replace('+', '')})\\1*", "$1+")


def written_out(exact: Column) -> Column:
    """An exact pattern with its runs' lengths: ``A{3}9``."""
    pieces = F.regexp_extract_all(exact, F.lit(f"(?s)({RUNS}|.)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) > 1, F.concat(
        F.substring(p, 1, 1), F.lit("{"), F.length(p).cast("string"), F.lit("}"))).otherwise(p)), "")


def _length_bits(exact: Column) -> Column:
    """Bits to say how long the runs of a value are (Elias gamma)."""
    runs = F.regexp_extract_all(exact, F.lit(f"({RUNS})"), F.lit(1))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda bits, r: bits + 2 * F.floor(F.log2(F.length(r).cast("double"))) + 1)


def formats(cells: DataFrame, by=()) -> DataFrame:
    """``(*by, column_name, format, values, share)`` of the present values of every column.

    Patterns are counted map-side, so a shuffled row is a pattern and a count.
    """
    keys = [*by, "column_name"]
    counts = (cells.where(is_present(F.col("value"))).select(*keys, exact_pattern(F.col("value")).alias("exact"))
              .groupBy(*keys, "exact").agg(F.count(F.lit(1)).alias("n")).withColumn("general", general_pattern(F.col("exact"))))
    named = counts.join(counts.groupBy(*keys).agg(F.sum("n").alias("all")), keys)
    choose = lambda n: n * F.log2(F.col("all") / n)
    groups = named.groupBy(*keys, "general", "all").agg(
        F.sum("n").alias("total"),
        F.sum(CHARACTER_BITS * F.length("exact") + choose(F.col("n"))).alias("one_by_one"),
        F.sum(F.col("n") * _length_bits(F.col("exact"))).alias("lengths"))
    general = (F.col("lengths") + CHARACTER_BITS * F.length("general") + choose(F.col("total"))) < F.col("one_by_one")
    merged = groups.where(general).select(*keys, F.col("general").alias("format"), F.col("total").alias("values"), "all")
    single = named.join(groups.where(~general).select(*keys, "general"), [*keys, "general"]).select(
        *keys, written_out(F.col("exact")).alias("format"), F.col("n").alias("values"), "all")
    # an exact pattern without runs may read like a general one
    return (merged.unionAll(single).groupBy(*keys, "format", "all").agg(F.sum("values").cast("bigint").alias("values"))
            .select(*keys, "format", "values", (F.col("values") / F.col("all")).alias("share")))
