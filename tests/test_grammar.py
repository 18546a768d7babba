"""Value grammar: numbers, dates, names (FIXTURES §4 literal edge cases)."""
from pyspark.sql import functions as F

from qualitas.functions.predicates import is_id_column, is_number_like, is_year_column, parse_timestamp, to_number


def _eval(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_numbers_accepted_and_refused(spark):
    ok = ["1e3", " 12 ", ".5", "5.", "+5", "-3.25", "0"]
    bad = ["0x10", "1d", "inf", "NaN", "1,000", "$5", "   ", "", "Infinity", "1e", "--1"]
    assert _eval(spark, ok, is_number_like) == [True] * len(ok)
    assert _eval(spark, bad, is_number_like) == [False] * len(bad)
    assert _eval(spark, ["1e3", " 12 ", ".5"], to_number) == [1000.0, 12.0, 0.5]


def test_dates(spark):
    vals = ["2024", "2100", "2101", "2024-02-30", "13/02/2024", "01/2024", "2024-01-02T10:00:00Z", "20240102",
            "02/29/2024", "12/31/1999", "2024-01-02", "1995-01-01 00:00:00"]
    got = _eval(spark, vals, lambda c: F.date_format(parse_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-01 00:00:00", "2100-01-01 00:00:00", None, None, None, "2024-01-01 00:00:00",
                   "2024-01-02 10:00:00", None, "2024-02-29 00:00:00", "1999-12-31 00:00:00",
                   "2024-01-02 00:00:00", "1995-01-01 00:00:00"]


def test_slash_dates_with_a_time_of_day(spark):
    vals = ["01/15/2024 10:30", "01/15/2024 10:30:05", "01/15/2024 1:05 PM", "12/31/1999 12:00 am", "01/15/2024 25:00",
            "01/15/2024 13:00 PM", "01/15/2024abc", "01/15/2024 soon", "02/30/2024 10:00", "2024\n", "01/15/2024 10:30:05.25"]
    got = _eval(spark, vals, lambda c: F.date_format(parse_timestamp(c), "yyyy-MM-dd HH:mm:ss.SS"))
    assert got == ["2024-01-15 10:30:00.00", "2024-01-15 10:30:05.00", "2024-01-15 13:05:00.00", "1999-12-31 00:00:00.00",
                   None, None, None, None, None, None, "2024-01-15 10:30:05.25"]


def test_day_first(spark):
    got = _eval(spark, ["13/02/2024", "02/13/2024"],
                lambda c: F.date_format(parse_timestamp(c, day_first=True), "yyyy-MM-dd"))
    assert got == ["2024-02-13", None]


def test_zone_suffix_is_converted(spark):
    got = _eval(spark, ["2024-01-02T10:00:00+02:00"], lambda c: F.date_format(parse_timestamp(c), "HH:mm"))
    assert got == ["08:00"]


def test_name_tests(spark):
    names = ["id", "ID", "client_id", "txn_id", "identity", "status", "created_at", "amount"]
    assert _eval(spark, names, is_id_column) == [True, True, True, True, False, False, False, False]
    assert _eval(spark, names, is_year_column) == [False, False, False, False, False, True, True, False]
