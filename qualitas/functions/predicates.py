"""Column expressions for the value grammar: presence, numbers, dates, names.

Everything here is a plain ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.  The expressions are meant
to run on the *distinct* values of the frequency table, not on every cell.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.functions import grammar as G


def as_text(field: T.StructField) -> Column:
    """String form of a column, the one value space every statistic works on."""
    c = F.col(f"`{field.name}`")
    dt = field.dataType
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(dt, T.BinaryType):
        return F.base64(c)
    if isinstance(dt, T.StringType):
        return c
    return c.cast("string")


def is_present(v: Column) -> Column:
    """Not NULL and not the empty string; whitespace-only counts as present."""
    return v.isNotNull() & (v != F.lit(""))


def is_number_like(v: Column) -> Column:
    return F.coalesce(v.rlike(G.NUMBER_PATTERN), F.lit(False))


def to_number(v: Column) -> Column:
    return F.when(is_number_like(v), v.try_cast("double"))


def whole(pattern: str) -> str:
    """The pattern with its ``$`` at the very end of the text, not before a last line break."""
    return pattern.removesuffix("$") + r"\z"


def is_year_only(v: Column) -> Column:
    return F.coalesce(v.rlike(whole(G.DATE_PATTERN_YEAR)), F.lit(False))


# a date in slashes, alone or followed by a time of day
_SLASH = (r"^(\d{2})/(\d{2})/(\d{4})(?: +(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,9})?)?(?: *([AaPp])[Mm])?)?\s*\z")
_MONTH_YEAR = r"^(\d{2})/(\d{4})\s*\z"
# a time of day followed by an explicit zone: Z, UTC/GMT or a numeric offset
_ZONE_SUFFIX = r"\d:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)$"


def parse_timestamp(v: Column, day_first: bool = False) -> Column:
    """Parse a date-like string as TIMESTAMP_NTZ (wall clock), or NULL.

    One parser per prefix pattern, independent of the session time zone:
    ISO values go through the cast grammar (a value with an explicit zone is
    converted to the session zone's wall clock); ``MM/DD/YYYY`` (or
    ``DD/MM/YYYY`` with ``day_first``), alone or with a time of day in 24
    hours or with AM/PM, ``MM/YYYY`` and a bare year up to YEAR_MAX are
    rewritten to ISO text and cast, so an impossible calendar date such as
    02/30/2024, or anything else behind the date, is refused.
    """
    ntz = lambda c: c.try_cast("timestamp_ntz")
    iso = F.when(v.rlike(G.DATE_PATTERN_ISO),
                 F.when(v.rlike(_ZONE_SUFFIX), v.try_cast("timestamp").cast("timestamp_ntz")).otherwise(ntz(v)))
    part = lambda i: F.regexp_extract(v, _SLASH, i)
    month, day = (part(2), part(1)) if day_first else (part(1), part(2))
    hour, half = part(4).try_cast("int"), F.lower(part(8))
    hour = (F.when(half == "", hour).when(~hour.between(1, 12), F.lit(None))
            .otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0)))
    clock = F.when(part(4) == "", F.lit("")).otherwise(F.concat(
        F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(5), F.lit(":"),
        F.when(part(6) == "", F.lit("00")).otherwise(part(6)), part(7)))
    slash = F.when(v.rlike(G.DATE_PATTERN_SLASH) & v.rlike(_SLASH), ntz(
        F.concat(part(3), F.lit("-"), month, F.lit("-"), day, clock)))
    both = lambda i: F.regexp_extract(v, _MONTH_YEAR, i)
    month_year = F.when(v.rlike(G.DATE_PATTERN_MONTH_YEAR) & v.rlike(_MONTH_YEAR),
                        ntz(F.concat(both(2), F.lit("-"), both(1), F.lit("-01"))))
    year = F.when(is_year_only(v) & (v.try_cast("int") <= G.YEAR_MAX), ntz(F.concat(v, F.lit("-01-01"))))
    return F.coalesce(iso, slash, month_year, year).cast("timestamp_ntz")


def is_likely_date(v: Column, day_first: bool = False) -> Column:
    return parse_timestamp(v, day_first).isNotNull()


def name_has_any(name: Column, tokens) -> Column:
    low = F.lower(name)
    out = F.lit(False)
    for t in tokens:
        out = out | low.contains(t)
    return out


def is_id_column(name: Column) -> Column:
    return (F.lower(name) == G.ID_COLUMN_NAME) | name_has_any(name, G.ID_COLUMN_SUBSTRINGS)


def is_year_column(name: Column) -> Column:
    return name_has_any(name, G.YEAR_COLUMN_TOKENS)
