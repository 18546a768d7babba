"""Row-level statistics across columns: duplicate rows / keys and dependent nulls."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions.predicates import as_text, is_present


def _key_columns(df: DataFrame, keys=None):
    """(original names, text expressions aliased to safe positional names ``_k0, _k1, ...``)."""
    fields = {f.name: f for f in df.schema.fields}
    names = list(keys) if keys else list(df.columns)
    return names, [as_text(fields[c]).alias(f"_k{i}") for i, c in enumerate(names)]


def row_digest(texts) -> "F.Column":
    """256-bit digest of a row: its values with their lengths, NULL apart from the empty text."""
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_summary(df: DataFrame, keys=None) -> DataFrame:
    """One row: rows, distinct rows (or keys), duplicates = rows - distinct.

    ``groupBy(digest).count()`` with map-side combine: a shuffled row is a
    digest and a count, and a key held by a third of all rows leaves each map
    task as one partial count, so the skew never reaches a single reducer.
    """
    fields = {f.name: f for f in df.schema.fields}
    digest = row_digest([as_text(fields[c]) for c in (keys or df.columns)])
    g = df.select(digest.alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("c"))
    return g.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).cast("bigint").alias("distinct_rows"),
    ).select("row_count", "distinct_rows",
             (F.col("row_count") - F.col("distinct_rows")).alias("duplicate_rows"),
             (F.col("row_count") > F.col("distinct_rows")).alias("duplicates_detected"))


def duplicate_evaluation(df: DataFrame, keys, truth: DataFrame, on: str, truth_col: str) -> DataFrame:
    """Labelled rows by ``(is_duplicate, truth)``: ``predicted, actual, n``, for the detector "its key occurs twice".

    The labels are counted by id and joined to the rows' digests; one
    aggregation by digest then has the copies of a key and its labels, so
    copies are never joined back to rows.  A NULL in a key is a value like
    any other; a label that is NULL counts as false.
    """
    fields = {f.name: f for f in df.schema.fields}
    rows = df.select(F.col(f"`{on}`").alias("_id"), row_digest([as_text(fields[k]) for k in keys]).alias("_key"))
    actual = F.coalesce(F.col(truth_col).cast("boolean"), F.lit(False))
    labels = truth.groupBy(F.col(f"`{on}`").alias("_id")).agg(
        F.count_if(actual).alias("_true"), F.count_if(~actual).alias("_false"))
    by_key = rows.join(labels, "_id", "left").groupBy("_key").agg(
        F.count(F.lit(1)).alias("_copies"), F.sum("_true").alias("_true"), F.sum("_false").alias("_false"))
    sides = F.array(F.struct(F.lit(True).alias("actual"), F.col("_true").alias("n")),
                    F.struct(F.lit(False).alias("actual"), F.col("_false").alias("n")))
    return (by_key.select((F.col("_copies") > 1).alias("predicted"), F.explode(sides).alias("s"))
            .groupBy("predicted", "s.actual").agg(F.coalesce(F.sum("s.n"), F.lit(0)).cast("bigint").alias("n")))


def dependent_nulls(df: DataFrame, columns=None) -> DataFrame:
    """Column pairs (a, b) where every row with ``a`` missing also has ``b`` missing (>= 1 such row).

    One scan, one global aggregate.  Each row gets a bitmask of its missing
    columns (63 columns per BIGINT word); for column ``a`` the bitwise AND
    of the masks of the rows where ``a`` is missing keeps exactly the columns
    missing whenever ``a`` is.  That is k * ceil(k / 63) aggregates instead
    of one per column pair.
    """
    names, exprs = _key_columns(df, columns)
    k = len(names)
    if k < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, a_missing bigint")
    words = [list(range(w, min(w + 63, k))) for w in range(0, k, 63)]
    missing = [(~is_present(e)) for e in exprs]
    masks = [sum((F.when(missing[i], F.lit(1 << (i - ws[0]))).otherwise(F.lit(0)) for i in ws),
                 F.lit(0)).cast("bigint").alias(f"w{w}") for w, ws in enumerate(words)]
    bits = df.select(*[m.alias(f"m{i}") for i, m in enumerate(missing)], *masks)
    aggs = []
    for i in range(k):
        aggs.append(F.count_if(F.col(f"m{i}")).cast("bigint").alias(f"c{i}"))
        for w in range(len(words)):
            aggs.append(F.bit_and(F.when(F.col(f"m{i}"), F.col(f"w{w}"))).alias(f"a{i}_{w}"))
    wide = bits.agg(*aggs)
    # one row per column a (k structs of ceil(k/63) words), then the set bits of a's AND-mask are
    # the columns b: O(k * words) expressions, not one per pair
    per_a = wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("a_missing"),
                 F.array(*[F.col(f"a{i}_{w}") for w in range(len(words))]).alias("words"))
        for i in range(k)])).alias("r")).select("r.*").where(F.col("a_missing") > 0)
    names_arr = F.array(*[F.lit(n) for n in names])

    def implied(j):
        word = F.element_at(F.col("words"), (j / 63).cast("int") + 1)
        shifted = F.call_function("shiftright", word, (j % 63).cast("int"))
        return (j != F.col("i")) & (shifted.bitwiseAND(F.lit(1)) == 1)

    pairs = per_a.select("i", "a_missing", F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), implied)).alias("j"))
    return pairs.select(F.element_at(names_arr, F.col("i") + 1).alias("a"),
                        F.element_at(names_arr, F.col("j") + 1).alias("b"), "a_missing")
