"""Personal data recognised by its values: shapes and check digits, as Column expressions, counted per column."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualitas.functions.predicates import is_present

#: A column is flagged if at least this share of its present values is of one kind.
SHARE = 0.5
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\z"
PHONE = r"^\+[0-9][0-9 ().-]{6,20}[0-9]\z"
CARD = r"^[0-9]([ -]?[0-9]){12,18}\z"
IBAN = r"^[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}\z"
NATIONAL_ID = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn_sum(digits: Column, doubled_first: int) -> Column:
    """The Luhn automaton over digits from the last one on; its state is the sum and whether to double next."""
    state = F.struct(F.lit(0).alias("sum"), F.lit(doubled_first).alias("double"))

    def step(s, c):
        d = c.cast("int") * (1 + s["double"])
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (1 - s["double"]).alias("double"))
    return F.aggregate(F.reverse(_characters(digits)), state, step, lambda s: s["sum"])


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes ``digits`` valid when it is put behind them."""
    return ((10 - _luhn_sum(digits, 1) % 10) % 10).cast("string")


def mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as a number (A is 10): an automaton with 97 states."""
    def step(r, c):
        letter = F.ascii(c) - 55
        return F.when(F.ascii(c) < 58, (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + letter) % 97)
    return F.aggregate(_characters(text), F.lit(0), step)


def iban_valid(iban: Column) -> Column:
    return mod97(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))) == 1


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits of an account number."""
    return F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")


def kind_of(value: Column) -> Column:
    """The kind of personal data that a value is, or NULL."""
    compact = F.regexp_replace(value, "[ -]", "")
    return (F.when(value.rlike(EMAIL), "email").when(value.rlike(IBAN) & iban_valid(compact), "iban")
            .when(value.rlike(NATIONAL_ID), "national_id")
            .when(value.rlike(CARD) & luhn_valid(compact), "card").when(value.rlike(PHONE), "phone"))


def evidence(cells: DataFrame, by=(), share: float = SHARE) -> DataFrame:
    """``(*by, column_name, kind, values, present_values, share, personal_data)``: kinds found in each column.

    A sum over cells, so no value is shuffled; a column with no value of any kind gives no row.
    """
    keys = [*by, "column_name"]
    seen = cells.where(is_present(F.col("value"))).select(*keys, kind_of(F.col("value")).alias("kind"))
    counts = seen.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("present_values"))
    part = F.col("n") / F.col("present_values")
    return (counts.where("kind IS NOT NULL").join(total, keys)
            .select(*keys, "kind", F.col("n").cast("bigint").alias("values"), "present_values", part.alias("share"),
                    (part >= share).alias("personal_data")))
