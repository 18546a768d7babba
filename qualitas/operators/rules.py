"""Deterministic rule checks over the seven quality dimensions.

Every rule yields rows ``(dimension, rule, column_name, bad, eligible,
distinct_values)``.  Column rules all come from ONE aggregation of the
per-value facts (``column_summary``); row rules (card-number length,
duplicates, orphans) pre-aggregate the rows by their key before any join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.functions.predicates import as_text, is_present, name_has_any
from qualitas.operators.crosscol import row_digest
from qualitas.operators.profile import _as_of_lit, named, temporal_date

RULE_SCHEMA = ("dimension string, rule string, column_name string, bad bigint, eligible bigint, "
               "distinct_values bigint")


def _n_if(cond):
    return F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("bigint")


def range_violation(range_rules=G.DEFAULT_RANGE_RULES):
    """(has_rule, violates) for a number-like value, rule picked by column-name token."""
    name = F.lower(F.col("column_name"))
    has = F.lit(False)
    bad = None
    for token, lo, hi in range_rules:
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (F.col("num") < F.lit(float(lo)))
        if hi is not None:
            cond = cond | (F.col("num") > F.lit(float(hi)))
        match = name.contains(token.lower())
        bad = F.when(match, cond) if bad is None else bad.when(match, cond)
        has = has | match
    return has, (F.coalesce(bad, F.lit(False)) if bad is not None else F.lit(False))


def summary_aggregates(as_of, freshness_years: int = G.FRESHNESS_YEARS, range_rules=G.DEFAULT_RANGE_RULES) -> dict:
    """Every per-column count the column rules need."""
    as_of_c = _as_of_lit(as_of)
    td = temporal_date()
    has_rule, violates = range_violation(range_rules)
    return {
        "rows": F.sum("n").cast("bigint"),
        "present": _n_if(F.col("present")),
        "all_num": F.bool_and(F.when(F.col("present"), F.col("is_num"))),
        "all_date": F.bool_and(F.when(F.col("present"), F.col("ts").isNotNull())),
        "num": _n_if(F.col("is_num")),
        "negative": _n_if(F.col("is_num") & (F.col("num") < 0)),
        "range_eligible": _n_if(F.col("is_num") & has_rule),
        "range_bad": _n_if(F.col("is_num") & has_rule & violates),
        "dates_any": _n_if(F.col("present") & F.col("ts").isNotNull()),
        "currency": _n_if(F.col("is_currency")),
        "tdates": _n_if(td),
        "future": _n_if(td & (F.col("ts") > as_of_c)),
        "non_iso": _n_if(td & ~F.col("is_iso")),
        "stale": _n_if(td & (F.col("ts") < as_of_c - F.expr(f"INTERVAL {int(freshness_years)} YEARS"))),
    }


SUMMARY_COLUMNS = ["rows", "present", "all_num", "all_date", "num", "negative", "range_eligible",
                   "range_bad", "dates_any", "currency", "tdates", "future", "non_iso", "stale"]


def summary_finish(agg: DataFrame, by=()) -> DataFrame:
    inferred = (F.when(F.coalesce(F.col("all_num"), F.lit(True)), F.lit("numeric"))
                .when(F.coalesce(F.col("all_date"), F.lit(True)), F.lit("datetime"))
                .otherwise(F.lit("string")))
    scale = 1000
    need = int(round(G.TEMPORAL_MIN_COVERAGE * scale))
    temporal = (F.col("tdates") > 0) & (F.col("tdates") * scale >= F.col("rows") * need)
    return agg.select(*by, "column_name", *SUMMARY_COLUMNS, inferred.alias("inferred_data_type"),
                      temporal.alias("is_temporal"),
                      (F.col("num") * 2 > F.col("present")).alias("numeric_majority"),
                      (F.col("dates_any") * 2 > F.col("present")).alias("date_majority"))


def column_summary(facts: DataFrame, as_of, by=(), freshness_years: int = G.FRESHNESS_YEARS,
                   range_rules=G.DEFAULT_RANGE_RULES) -> DataFrame:
    """Every per-column count the column rules need, in one pass over the (per-cell) facts."""
    by = list(by)
    agg = facts.groupBy(*by, "column_name").agg(*named(summary_aggregates(as_of, freshness_years, range_rules)))
    return summary_finish(agg, by)


def with_distinct(rules: DataFrame, distinct: DataFrame, by=()) -> DataFrame:
    """Column rules with ``distinct_values`` (used in wording) from ``cells.distinct_counts``; 0 without values."""
    return (rules.drop("distinct_values").join(distinct, [*by, "column_name"], "left")
            .withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint"))))


def rule_columns(rule: str, names, range_rules=G.DEFAULT_RANGE_RULES) -> list[str]:
    """The columns that a column rule can apply to by their name; the others needn't be read."""
    tokens = {"out_of_range": [t for t, _, _ in range_rules], "negative_amount": G.MONETARY_TOKENS}.get(rule)
    if rule in ("future_timestamp", "non_iso_date", "stale_records"):
        return [n for n in names if n.lower() != G.ID_COLUMN_NAME and not any(t in n.lower() for t in G.ID_COLUMN_SUBSTRINGS)]
    return [n for n in names if tokens is None or any(t.lower() in n.lower() for t in tokens)]


def column_rules(summary: DataFrame, by=()) -> DataFrame:
    """Column rules R1-R7, R9 as long rows (one per applicable rule and column)."""
    by = list(by)
    name = F.col("column_name")
    string_typed = F.col("inferred_data_type") == "string"
    monetary = name_has_any(name, G.MONETARY_TOKENS)
    L = F.lit

    def rule(dim, rid, applies, bad, eligible):
        return F.when(applies, F.struct(L(dim).alias("dimension"), L(rid).alias("rule"),
                                        bad.cast("bigint").alias("bad"),
                                        eligible.cast("bigint").alias("eligible")))

    c = F.col
    candidates = [
        rule("Completeness", "missing_values", L(True), c("rows") - c("present"), c("rows")),
        rule("Accuracy", "out_of_range", c("range_eligible") > 0, c("range_bad"), c("range_eligible")),
        rule("Accuracy", "negative_amount", monetary & (c("num") > 0), c("negative"), c("num")),
        rule("Accuracy", "future_timestamp", c("is_temporal"), c("future"), c("tdates")),
        rule("Consistency", "numeric_as_string", string_typed & c("numeric_majority"),
             c("present") - c("num") - c("currency"), c("present")),
        rule("Consistency", "datetime_as_string", string_typed & ~c("numeric_majority") & c("date_majority"),
             c("present") - c("dates_any"), c("present")),
        rule("Validity", "currency_symbol", c("numeric_majority") & (c("present") > 0), c("currency"), c("present")),
        rule("Validity", "non_iso_date", c("is_temporal"), c("non_iso"), c("tdates")),
        rule("Timeliness", "stale_records", c("is_temporal"), c("stale"), c("tdates")),
    ]
    return (summary.select(*by, "column_name",
                           F.explode(F.filter(F.array(*candidates), lambda x: x.isNotNull())).alias("r"))
            .select(*by, "r.dimension", "r.rule", "column_name", "r.bad", "r.eligible",
                    F.lit(0).cast("bigint").alias("distinct_values")))


def pan_length_rule(df: DataFrame, brand_col: str = "card_brand", number_col: str = "card_number") -> DataFrame:
    """Card-number length valid for the brand (R8); unknown brands are never flagged.

    Rows are first reduced to ``(brand, digit count) -> rows`` (map-side
    combine), and only that small table meets the fixed brand table, which is
    broadcast: it has one row per known brand.
    """
    spark = df.sparkSession
    fields = {f.name: f for f in df.schema.fields}
    brand = F.lower(F.trim(as_text(fields[brand_col])))
    number = as_text(fields[number_col])
    lengths = (df.select(brand.alias("brand"), number.alias("number"))
               .where(is_present(F.col("number")) & is_present(F.col("brand")))
               .groupBy("brand", F.length(F.regexp_replace("number", "[^0-9]", "")).alias("digits"))
               .agg(F.count(F.lit(1)).alias("rows"),
                    F.count(F.lit(1)).alias("_n")))
    brands = spark.createDataFrame(list(G.PAN_LENGTHS), "brand string, min_len int, max_len int")
    j = lengths.join(F.broadcast(brands), "brand")
    bad = F.when((F.col("digits") < F.col("min_len")) | (F.col("digits") > F.col("max_len")), F.col("rows"))
    return j.agg(F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("bad"),
                 F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("eligible"),
                 F.count(F.lit(1)).cast("bigint").alias("distinct_values")).select(
        F.lit("Validity").alias("dimension"), F.lit("pan_length").alias("rule"),
        F.lit(number_col).alias("column_name"), "bad", "eligible", "distinct_values")


def duplicate_rule(df: DataFrame, keys=None) -> DataFrame:
    """Uniqueness (R10): bad = rows - distinct rows (or distinct declared keys)."""
    from qualitas.operators.crosscol import duplicate_summary
    s = duplicate_summary(df, keys)
    label = ",".join(keys) if keys else "*"
    return s.select(F.lit("Uniqueness").alias("dimension"),
                    F.lit("duplicate_key" if keys else "duplicate_rows").alias("rule"),
                    F.lit(label).alias("column_name"),
                    F.col("duplicate_rows").alias("bad"), F.col("row_count").alias("eligible"),
                    F.col("distinct_rows").alias("distinct_values"))


def malformed_rule(df: DataFrame) -> DataFrame:
    """Validity: rows that a reader couldn't fit to the columns; no rule row where there are none."""
    # file readers refuse to give that column alone, so the condition also reads another one
    others = [F.col(f"`{c}`") for c in df.columns if c != G.CORRUPT_COLUMN][:1]
    bad = F.count_if(F.col(G.CORRUPT_COLUMN).isNotNull() & (F.length(F.concat_ws("", *[c.cast("string") for c in others])) >= 0))
    return (df.agg(bad.cast("bigint").alias("bad"), F.count(F.lit(1)).cast("bigint").alias("eligible"))
            .where("bad > 0")
            .select(F.lit("Validity").alias("dimension"), F.lit("malformed_rows").alias("rule"),
                    F.lit("*").alias("column_name"), "bad", "eligible", F.lit(0).cast("bigint").alias("distinct_values")))


def orphan_rule(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Integrity (R11): present child keys with no parent key.

    Child keys are counted first (hot keys collapse map-side), so the
    anti-join runs between two distinct-key sets and cannot skew.
    """
    fields = {f.name: f for f in df.schema.fields}
    pfields = {f.name: f for f in parent.schema.fields}
    child = (df.select(as_text(fields[column]).alias("k")).where(is_present(F.col("k")))
             .groupBy("k").agg(F.count(F.lit(1)).alias("c")))
    parents = (parent.select(as_text(pfields[parent_column]).alias("k")).where(F.col("k").isNotNull())
               .distinct().withColumn("_has_parent", F.lit(True)))
    matched = child.join(parents, "k", "left")
    return matched.agg(
        F.coalesce(F.sum(F.when(F.col("_has_parent").isNull(), F.col("c"))), F.lit(0)).cast("bigint").alias("bad"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("eligible"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_values"),
    ).select(F.lit("Integrity").alias("dimension"), F.lit("orphan_keys").alias("rule"),
             F.lit(column).alias("column_name"), "bad", "eligible", "distinct_values")


def row_rules(df: DataFrame, keys=None, parents: dict | None = None, pan_columns=None) -> DataFrame:
    """Row rules: duplicate rows, duplicate keys and card-number lengths in ONE scan; orphans per parent.

    The first three are ``groupBy(key).count()`` over different keys, so they
    are one grouping-sets aggregation (Spark expands each row once per set,
    combines map-side so a hot key collapses to one row per task, and
    shuffles once) followed by one global conditional aggregation, read as
    three rule rows.  Rows and keys are grouped by their 256-bit digest, so a
    shuffled row holds a digest and a count however wide the table is.  The card-brand
    lengths are a fixed CASE over the brand (no join).  Orphans need the
    parent keys and keep their own pre-aggregated anti-match (``orphan_rule``).
    """
    parents = parents or {}
    fields = {f.name: f for f in df.schema.fields}
    names = list(df.columns)
    texts = {c: as_text(fields[c]) for c in names}
    proj = [row_digest([texts[c] for c in names]).alias("_row")]
    sets = [["_row"]]
    if keys:
        proj.append(row_digest([texts[c] for c in keys]).alias("_key"))
        sets.append(["_key"])
    brand, number = pan_columns if pan_columns else (None, None)
    with_pan = brand in fields and number in fields
    if with_pan:
        ok = is_present(texts[number]) & is_present(texts[brand])
        proj.append(F.when(ok, F.lower(F.trim(texts[brand]))).alias("_brand"))
        proj.append(F.when(ok, F.length(F.regexp_replace(texts[number], "[^0-9]", ""))).alias("_digits"))
        sets.append(["_brand", "_digits"])
    group_cols = [c for st in sets for c in st]

    def gid(members):
        return sum(1 << (len(group_cols) - 1 - i) for i, c in enumerate(group_cols) if c not in members)

    g = (df.select(*proj).groupingSets(sets, *group_cols)
         .agg(F.count(F.lit(1)).alias("c"), F.grouping_id().alias("_gid")))
    in_set = {name: F.col("_gid") == gid(members)
              for name, members in (("row", ["_row"]), ("key", ["_key"]), ("pan", ["_brand", "_digits"]))}

    def n_if(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).cast("bigint")

    aggs = [n_if(in_set["row"]).alias("row_n"), F.count_if(in_set["row"]).cast("bigint").alias("row_d")]
    if keys:
        aggs += [n_if(in_set["key"]).alias("key_n"), F.count_if(in_set["key"]).cast("bigint").alias("key_d")]
    if with_pan:
        lo = hi = None
        for b, mn, mx in G.PAN_LENGTHS:
            lo = F.when(F.col("_brand") == b, F.lit(mn)) if lo is None else lo.when(F.col("_brand") == b, F.lit(mn))
            hi = F.when(F.col("_brand") == b, F.lit(mx)) if hi is None else hi.when(F.col("_brand") == b, F.lit(mx))
        known = in_set["pan"] & lo.isNotNull()
        aggs += [n_if(known).alias("pan_n"), F.count_if(known).cast("bigint").alias("pan_d"),
                 n_if(known & ((F.col("_digits") < lo) | (F.col("_digits") > hi))).alias("pan_bad")]
    t = g.agg(*aggs)
    L = F.lit

    def rule_row(dim, rule, column, bad, eligible, distinct):
        return F.struct(L(dim).alias("dimension"), L(rule).alias("rule"), L(column).alias("column_name"),
                        bad.alias("bad"), eligible.alias("eligible"), distinct.alias("distinct_values"))

    rows = [rule_row("Uniqueness", "duplicate_rows", "*", F.col("row_n") - F.col("row_d"), F.col("row_n"),
                     F.col("row_d"))]
    if keys:
        rows.append(rule_row("Uniqueness", "duplicate_key", ",".join(keys), F.col("key_n") - F.col("key_d"),
                             F.col("key_n"), F.col("key_d")))
    if with_pan:
        rows.append(rule_row("Validity", "pan_length", number, F.col("pan_bad"), F.col("pan_n"), F.col("pan_d")))
    out = t.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    for col, (parent, parent_col) in parents.items():
        out = out.unionByName(orphan_rule(df, col, parent, parent_col))
    return out
