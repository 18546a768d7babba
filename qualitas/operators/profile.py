"""Column, numeric, categorical, temporal and pattern statistics from ``facts`` (per cell or per distinct value).

Every function groups by ``(*by, column_name)``: a handful of groups, each fed
by a partial aggregate per map task, so the second shuffle is tiny whatever
the data size.  ``by`` lets one job profile many datasets (or event-time
windows) at once.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.functions.predicates import is_id_column, is_year_column, name_has_any
from qualitas.operators import cells as C
from qualitas.session import written


def _n_if(cond) -> "F.Column":
    return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("bigint")


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def distinct_present(approx: bool = False, rsd: float = 0.02) -> "F.Column":
    """Distinct present values of a column: rows of the frequency table, or a HyperLogLog estimate over cells."""
    if approx:
        return F.approx_count_distinct(F.when(F.col("present"), F.col("value")), rsd).cast("bigint")
    return F.count_if(F.col("present") & (F.col("n") > 0)).cast("bigint")


def named(aggregates: dict) -> list:
    """Aggregates ``{name: column}`` as aliased columns."""
    return [c.alias(n) for n, c in aggregates.items()]


def profile_aggregates() -> dict:
    """Everything of a column profile but the distinct count."""
    present = F.col("present")
    return {"row_count": F.sum("n").cast("bigint"),
            "present_count": _n_if(present),
            "_all_num": F.bool_and(F.when(present, F.col("is_num"))),
            "_all_date": F.bool_and(F.when(present, F.col("ts").isNotNull()))}


def with_distinct(agg: DataFrame, distinct: DataFrame, by=()) -> DataFrame:
    """Per-column aggregates with ``unique_count`` from ``cells.distinct_counts`` (0 where a column has no value)."""
    keys = [*by, "column_name"]
    joined = agg.join(distinct.select(*keys, F.col("distinct_values").alias("unique_count")), keys, "left")
    return joined.withColumn("unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint")))


def profile_finish(agg: DataFrame, by=(), columns=None, also=()) -> DataFrame:
    """Column profile of finished aggregates; ``also`` names further aggregates to keep."""
    by = list(by)
    if columns is not None and not by:
        spark = agg.sparkSession
        names = spark.createDataFrame([(c, i) for i, c in enumerate(columns)],
                                      "column_name string, ordinal int")
        agg = names.join(agg, "column_name", "left").select(
            "column_name", "ordinal",
            *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
              for c in ("row_count", "present_count", "unique_count")],
            "_all_num", "_all_date", *also)
    rows = F.col("row_count")
    null_count = (rows - F.col("present_count")).alias("null_count")
    inferred = (F.when(F.coalesce(F.col("_all_num"), F.lit(True)), F.lit("numeric"))
                .when(F.coalesce(F.col("_all_date"), F.lit(True)), F.lit("datetime"))
                .otherwise(F.lit("string")))
    return agg.select(
        *by, "column_name", *(["ordinal"] if "ordinal" in agg.columns else []),
        inferred.alias("inferred_data_type"),
        null_count,
        _ratio(rows - F.col("present_count"), rows).alias("null_ratio"),
        "unique_count",
        _ratio(F.col("unique_count"), rows).alias("unique_ratio"),
        F.array_repeat(F.lit(G.MASK),
                       F.least(F.lit(G.SAMPLE_COUNT), F.col("present_count")).cast("int"))
        .alias("sample_values_masked"),
        "row_count", "present_count", *also,
    )


def column_profile(facts: DataFrame, by=(), columns=None, approx: bool = False,
                   distinct: DataFrame | None = None) -> DataFrame:
    """Per column: inferred type, null and distinct counts and ratios, masked samples.

    ``columns`` (list of names, schema-sized) keeps columns of an empty
    dataset in the output with zero counts.  ``facts`` are per distinct
    value; over per-cell facts give ``distinct`` (``cells.distinct_counts``),
    or ``approx=True`` to estimate it.
    """
    agg = facts.groupBy(*by, "column_name")
    if distinct is not None:
        agg = with_distinct(agg.agg(*named(profile_aggregates())), distinct, by)
    else:
        agg = agg.agg(*named(profile_aggregates()), distinct_present(approx).alias("unique_count"))
    return profile_finish(agg, by, columns)


MEAN_DECIMAL = "decimal(24,6)"   # exact mean path: up to 18 integer digits, 6 decimals


def numeric_inputs(facts: DataFrame, blank_as_zero: bool = False):
    """``(x, d)``: the value as a double and as an exact decimal, NULL where not number-like.

    ``blank_as_zero`` counts missing cells as 0, as coercing a blank to a number does.
    """
    x = F.when(F.col("is_num"), F.col("num"))
    d = F.when(F.col("is_num"), F.col("value").try_cast(MEAN_DECIMAL))
    if blank_as_zero:
        x = x.when(~F.col("present"), F.lit(0.0))
        d = d.when(~F.col("present"), F.lit(0).cast(MEAN_DECIMAL))
    return x.alias("x"), d.alias("d")


def numeric_aggregates() -> dict:
    """Aggregates over rows carrying ``x``, ``d`` and ``n`` (see ``numeric_inputs``).

    The mean is an exact decimal sum (value as DECIMAL(24,6) times its count)
    divided by the count, rounded half-up to 6 decimals, so it does not depend
    on summation order; a column holding a value outside DECIMAL(24,6) falls
    back to a double sum.  Conditional aggregates (not a row filter) keep the
    frequency subtree shareable with other branches of the same query.
    """
    has_x = F.col("x").isNotNull()
    cnt = F.sum(F.when(has_x, F.col("n")))
    exact_sum = F.try_sum(F.col("d") * F.col("n").cast("decimal(13,0)"))
    exact_ok = (F.count_if(has_x & F.col("d").isNull()) == 0) & exact_sum.isNotNull()
    mean = F.when(exact_ok, (exact_sum / cnt).cast("double")).otherwise(
        F.sum(F.when(has_x, F.col("x") * F.col("n"))) / cnt)
    return {"numeric_count": cnt.cast("bigint"), "min_value": F.min("x"), "max_value": F.max("x"), "mean": mean,
            "negative_value_ratio": _n_if(F.col("x") < 0) / cnt, "negative_count": _n_if(F.col("x") < 0)}


NUMERIC_COLUMNS = ["numeric_count", "min_value", "max_value", "mean", "negative_value_ratio", "negative_count"]


def numeric_finish(agg: DataFrame, by=()) -> DataFrame:
    return agg.where(F.col("numeric_count") > 0).select(*by, "column_name", *NUMERIC_COLUMNS)


def numeric_stats(facts: DataFrame, by=(), blank_as_zero: bool = False) -> DataFrame:
    """min / max / mean / negative ratio over number-like values, for every column having one."""
    by = list(by)
    f = facts.select(*by, "column_name", "n", *numeric_inputs(facts, blank_as_zero))
    return numeric_finish(f.groupBy(*by, "column_name").agg(*named(numeric_aggregates())), by)


def categorical_stats(facts: DataFrame, by=(), k: int = G.TOP_K) -> DataFrame:
    """Distinct count plus the top-k present values by count (ties: value ascending).

    Long form ``(*by, column_name, distinct_values, rank, value, n)``.  The
    ``rank <= k`` filter becomes a WindowGroupLimit that keeps k rows per
    column in each map task before the shuffle, so a column with billions of
    distinct values still ships only k rows per task.
    """
    by = list(by)
    present = F.col("present")
    # missing values are ranked after every present one and dropped after the limit (instead of a
    # filter that Catalyst would push below the frequency aggregate, breaking exchange reuse)
    w = Window.partitionBy(*by, "column_name").orderBy(present.desc(), F.col("n").desc(), F.col("value").asc())
    top = (facts.select(*by, "column_name", "value", "n", "present")
           .withColumn("rank", F.row_number().over(w))
           .where((F.col("rank") <= k) & F.col("present"))
           .withColumn("rank", F.col("rank").cast("bigint")))
    # `n > 0` always holds; referencing n keeps this branch's frequency aggregate identical to the
    # top-k branch's, so both read one exchange (ReusedExchange) instead of scanning twice
    distinct = facts.groupBy(*by, "column_name").agg(
        F.count_if(present & (F.col("n") > 0)).alias("distinct_values"))
    return top.join(distinct, [*by, "column_name"]).select(
        *by, "column_name", "distinct_values", "rank", "value", F.col("n").cast("bigint").alias("n"))


#: The first refinement of tied long values looks at so many characters, each further one at four times as many.
REFINED_CHARS = 160


def top_values(cells: DataFrame, folder: str, by=(), k: int = G.TOP_K) -> DataFrame:
    """The k most frequent present values of each column, ties by value ascending, and the distinct counts.

    ``(*by, column_name, distinct_values, rank, value, n)`` of ``cells``.  Values are counted by their keys, so long
    texts aren't shuffled, and ranked by count and first characters.  A key's digest says nothing about the order of
    texts that share these, so ties at the k-th place are refined: of the tied values alone, longer and longer
    prefixes are compared until the order is decided.  Steps are tables in ``folder``.
    """
    keys = [*by, "column_name"]
    counts = C.count_values(cells, by)
    head = F.substring("value", 1, C.KEY_CHARS)
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "head")
    # rank() keeps all that tie with the k-th; a WindowGroupLimit drops the rest in each task before the shuffle
    first = written(counts.withColumn("head", head).withColumn("place", F.rank().over(w)).where(F.col("place") <= k)
                    .join(C.distinct_counts(counts, by), keys), f"{folder}/first")
    long = F.octet_length("value") > C.KEY_BYTES
    last = Window.partitionBy(*keys)
    groups = (first.withColumn("_last", F.max("place").over(last)).where("place = _last").groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("tied"), F.max(long).alias("long"), F.first("head").alias("head"),
                   F.first("place").alias("place"))
              .where("long").withColumn("need", F.lit(k + 1) - F.col("place")).where("tied > need"))
    groups = written(groups.select(*keys, "head", "place", "need"), f"{folder}/open")      # a row a column at most
    chosen = first
    if not groups.isEmpty():
        tied = first.join(F.broadcast(groups.select(*keys, "place", "need")), [*keys, "place"])
        chosen = first.join(F.broadcast(groups.select(*keys, "place")), [*keys, "place"], "left_anti").unionByName(
            _refined(cells, tied, groups, keys, folder).select(*first.columns))
    chosen = chosen.select(*keys, "distinct_values", "value", "n")
    # few of the chosen are long: k a column, once ties are refined
    texts = C.long_texts(cells, chosen, by)
    value = F.coalesce("text", "value")
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), value.asc())
    return (chosen.join(texts, [*keys, "value"], "left").withColumn("rank", F.row_number().over(order).cast("bigint"))
            .where(F.col("rank") <= k).select(*keys, "distinct_values", "rank", value.alias("value"),
                                              F.col("n").cast("bigint").alias("n")))


def _refined(cells: DataFrame, tied: DataFrame, groups: DataFrame, keys: list, folder: str) -> DataFrame:
    """The first ``need`` of the tied values of each column, by their texts."""
    chars = REFINED_CHARS
    head = F.substring("value", 1, C.KEY_CHARS)
    while True:
        near = (cells.withColumn("head", head).join(F.broadcast(groups.select(*keys, "head")), [*keys, "head"])
                .select(*keys, C.value_key(F.col("value")).alias("value"), F.substring("value", 1, chars).alias("prefix"),
                        F.length("value").alias("size"))
                .groupBy(*keys, "value").agg(F.first("prefix").alias("prefix"), F.first("size").alias("size")))
        place = F.rank().over(Window.partitionBy(*keys).orderBy("prefix"))
        tied = written(tied.join(near, [*keys, "value"]).withColumn("at", place).where("at <= need"), f"{folder}/tied-{chars}")
        left = tied.groupBy(*keys).agg((F.count(F.lit(1)) > F.first("need")).alias("open"), F.max("size").alias("size"))
        state = left.agg(F.max("open"), F.max("size")).first()
        tied = tied.drop("prefix", "size", "at")
        if not state[0] or chars >= state[1]:
            return tied
        chars *= 4


#: Items that a frequent-items sketch tracks in a column, and how many more than k it is asked for, so that ties at
#: the k-th place are broken by value as in the exact path.
TRACKED, SPARE = 1000, 8


def approx_top(item_sql: str, k: int = G.TOP_K, tracked: int = TRACKED) -> "F.Column":
    """Sketch of a column's frequent items; ``ranked_items`` reads the top k out of it."""
    return F.expr(f"approx_top_k({item_sql}, {int(k) + SPARE}, {int(tracked)})")


def ranked_items(top, k: int = G.TOP_K) -> "F.Column":
    """The k most frequent items of a sketch as ``array<struct<neg, item, count>>``, ties by item."""
    ranked = F.array_sort(F.transform(F.filter(top, lambda e: e["item"].isNotNull()), lambda e: F.struct(
        (-e["count"]).alias("neg"), e["item"].alias("item"), e["count"].alias("count"))))
    return F.slice(ranked, 1, int(k))


def approx_top_aggregates(k: int = G.TOP_K, tracked: int = TRACKED) -> dict:
    return {"distinct_values": distinct_present(True),
            "_top": approx_top("CASE WHEN present THEN value END", k, tracked)}


def approx_categorical_finish(agg: DataFrame, by=(), k: int = G.TOP_K) -> DataFrame:
    by = list(by)
    items = ranked_items("_top", k)
    return (agg.where(F.col("distinct_values") > 0)
            .select(*by, "column_name", "distinct_values", F.posexplode(items).alias("_pos", "_e"))
            .select(*by, "column_name", "distinct_values", (F.col("_pos") + 1).cast("bigint").alias("rank"),
                    F.col("_e.item").alias("value"), F.col("_e.count").cast("bigint").alias("n")))


def approx_categorical_stats(cell_facts: DataFrame, by=(), k: int = G.TOP_K, tracked: int = TRACKED) -> DataFrame:
    """Approximate twin of ``categorical_stats`` over per-cell facts: HLL distinct count, sketch top-k."""
    agg = cell_facts.groupBy(*by, "column_name").agg(*named(approx_top_aggregates(k, tracked)))
    return approx_categorical_finish(agg, by, k)


def top_values_nested(categorical: DataFrame, by=()) -> DataFrame:
    """One row per column with ``top_values: array<struct<value, n>>`` (at most k entries)."""
    by = list(by)
    return (categorical.groupBy(*by, "column_name", "distinct_values")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("_t"))
            .select(*by, "column_name", "distinct_values",
                    F.transform("_t", lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n")))
                    .alias("top_values")))


def _as_of_lit(as_of) -> "F.Column":
    """``as_of`` as a TIMESTAMP_NTZ literal built from text, so no time zone is involved."""
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    elif isinstance(as_of, _dt.date) and not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime(as_of.year, as_of.month, as_of.day)
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def temporal_date(name=None) -> "F.Column":
    """A fact row is a date for temporal statistics and the date rules.

    Id-like columns are skipped; a bare year counts only in a column whose
    name suggests a date or year.
    """
    name = F.col("column_name") if name is None else name
    return (F.col("ts").isNotNull() & ~is_id_column(name)
            & (~F.col("year_only") | is_year_column(name)))


def temporal_aggregates(as_of) -> dict:
    as_of_c = _as_of_lit(as_of)
    is_date = temporal_date()
    return {"row_count": F.sum("n").cast("bigint"),
            "date_count": _n_if(is_date),
            "min_ts": F.min(F.when(is_date, F.col("ts"))),
            "max_ts": F.max(F.when(is_date, F.col("ts"))),
            "future_count": _n_if(is_date & (F.col("ts") > as_of_c)),
            "stale_count": _n_if(is_date & (F.col("ts") < as_of_c - F.expr(f"INTERVAL {G.STALE_DAYS} DAYS")))}


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def temporal_finish(agg: DataFrame, by=(), min_coverage: float = G.TEMPORAL_MIN_COVERAGE) -> DataFrame:
    by = list(by)
    # coverage test in exact integer arithmetic: dates / rows >= min_coverage
    scale = 1000
    need = int(round(min_coverage * scale))
    agg = agg.where((F.col("date_count") > 0)
                    & (F.col("date_count") * scale >= F.col("row_count") * need))
    return agg.select(
        *by, "column_name", "row_count", "date_count",
        F.date_format("min_ts", ISO).alias("min_timestamp"),
        F.date_format("max_ts", ISO).alias("max_timestamp"),
        (F.col("future_count") / F.col("date_count")).alias("future_timestamp_ratio"),
        (F.col("stale_count") / F.col("date_count")).alias("stale_record_ratio"),
        "future_count", "stale_count", "min_ts", "max_ts",
    )


def temporal_stats(facts: DataFrame, as_of, by=(),
                   min_coverage: float = G.TEMPORAL_MIN_COVERAGE) -> DataFrame:
    """min / max timestamp, future and stale ratios for columns whose dates cover >= 10 % of rows."""
    agg = facts.groupBy(*by, "column_name").agg(*named(temporal_aggregates(as_of)))
    return temporal_finish(agg, by, min_coverage)


def pattern_aggregates() -> dict:
    return {"present_count": _n_if(F.col("present")), "match_count": _n_if(F.col("is_code"))}


def pattern_finish(agg: DataFrame, by=()) -> DataFrame:
    by = list(by)
    return (agg.where(F.col("match_count") > 0)
            .select(*by, "column_name", "match_count",
                    (F.col("match_count") / F.col("present_count")).alias("regex_match_ratio")))


def pattern_stats(facts: DataFrame, by=()) -> DataFrame:
    """Share of present values matching the code pattern; only columns with a match."""
    return pattern_finish(facts.groupBy(*by, "column_name").agg(*named(pattern_aggregates())), by)


def compliance_flags(column_names: DataFrame, by=()) -> DataFrame:
    """KYC / monetary / personal-data flags: does any column name carry the tokens."""
    by = list(by)
    name = F.col("column_name")
    return column_names.groupBy(*by).agg(
        F.coalesce(F.bool_or(name_has_any(name, G.KYC_TOKENS)), F.lit(False)).alias("kyc_fields_present"),
        F.coalesce(F.bool_or(name_has_any(name, G.MONETARY_TOKENS)), F.lit(False)).alias("monetary_fields_present"),
        F.coalesce(F.bool_or(name_has_any(name, G.PERSONAL_TOKENS)), F.lit(False)).alias("personal_data_present"),
    )
