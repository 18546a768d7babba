"""Exact text formatting of counts, ratios and scores.

Percentages and scores are rounded half-up in integer arithmetic so that the
text does not depend on how an engine rounds binary doubles.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def scaled_ratio(num: Column, den: Column, scale: int) -> Column:
    """round_half_up(num / den * scale) as BIGINT, exact; NULL when den is 0.

    Floor division written as (a - a % b) / b on DECIMAL(38,0), which is exact.
    """
    a = _dec(num) * (2 * scale) + _dec(den)
    b = _dec(den) * 2
    return F.when(den > 0, ((a - a % b) / b).cast("bigint"))


def fixed_text(scaled: Column, decimals: int) -> Column:
    """Render an integer holding value * 10**decimals as text with that many decimals."""
    if decimals == 0:
        return scaled.cast("string")
    unit = 10 ** decimals
    return F.concat(F.floor(scaled / unit).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((scaled % unit).cast("string"), decimals, "0"))


def percent_text(num: Column, den: Column, decimals: int = 2) -> Column:
    """'12.34%' for num/den, half-up, exact."""
    return F.concat(fixed_text(scaled_ratio(num, den, 100 * 10 ** decimals), decimals), F.lit("%"))


def count_sentence(bad: Column, eligible: Column, phrase: Column) -> Column:
    """'X records (Y%) have <phrase>', or '1 record (Y%) has <phrase>'."""
    one = bad == 1
    return F.concat(bad.cast("string"),
                    F.when(one, F.lit(" record (")).otherwise(F.lit(" records (")),
                    percent_text(bad, eligible, 2),
                    F.when(one, F.lit(") has ")).otherwise(F.lit(") have ")),
                    phrase)
