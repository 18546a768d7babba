"""Finding what an audit otherwise has to be told: references between tables, and keys."""
from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.functions.predicates import as_text, is_present
from qualitas.operators import cells as C
from qualitas.operators.crosscol import row_digest
from qualitas.session import shuffles_freed

#: Columns that one word of a set of columns holds.
WORD_BITS = 62
#: Kinds of columns whose texts can mean the same.
_COMPARED = {"i": "n", "f": "f", "t": "t", "b": "b", "s": "s"}


def inclusion_dependencies(frames: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Column pairs (child, parent) in which every present child value occurs as a value of the parent.

    ``child_table, child_column, parent_table, parent_column, child_values, parent_values, parent_unique``, for all
    columns of all tables, or those in ``columns``; a column without values is no child.  Only columns of one kind
    (whole numbers, fractions, times, booleans, texts) are compared.

    Values are shuffled once: each distinct value learns the set of columns that have it, as bits, combined in the
    map tasks.  The candidate parents of a column are what all the sets with it have in common, a bitwise AND, so no
    pair of columns is ever joined.
    """
    spark = next(iter(frames.values())).sparkSession
    listed = [(t, c) for t, df in frames.items() for c in ((columns or {}).get(t) or df.columns)]
    number = {tc: i for i, tc in enumerate(listed)}
    words = range(0, len(listed), WORD_BITS)
    cells = None
    for t, df in frames.items():
        names = [c for tt, c in listed if tt == t]
        if not names:
            continue
        kinds, fields = C.column_kinds(df), {f.name: f for f in df.schema.fields}
        value = lambda c: F.when(is_present(as_text(fields[c])), F.concat(
            F.lit(_COMPARED[kinds[c]]), C.value_key(as_text(fields[c]))))
        part = df.select(F.inline(F.array(*[F.struct(F.lit(number[t, c]).alias("i"), value(c).alias("value"))
                                            for c in names])))
        cells = part if cells is None else cells.unionAll(part)
    counted = cells.where("value IS NOT NULL").groupBy("value", "i").agg(F.count(F.lit(1)).alias("n"))
    bit = lambda w: F.when((F.col("i") >= w) & (F.col("i") < w + WORD_BITS), F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("i") - w)).otherwise(F.lit(0).cast("long"))
    sets = (counted.groupBy("value").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])
            .groupBy(*[f"w{w}" for w in words]).agg(F.count(F.lit(1)).alias("n")))
    has = lambda i, word: F.call_function("shiftright", word(i), (i % WORD_BITS).cast("int")).bitwiseAND(F.lit(1)) == 1
    every = F.sequence(F.lit(0), F.lit(len(listed) - 1))
    word_of = lambda i: F.element_at(F.col("words"), (i / WORD_BITS).cast("int") + 1)
    held = (sets.select("n", F.array(*[F.col(f"w{w}") for w in words]).alias("words"))
            .select("n", "words", F.explode(F.filter(every, lambda i: has(i, word_of))).alias("i")))
    common = held.groupBy("i").agg(F.sum("n").alias("values"), F.array(*[
        F.bit_and(F.col("words")[j]) for j in range(len(words))]).alias("words"))
    unique = counted.groupBy("i").agg((F.max("n") == 1).alias("unique"), F.count(F.lit(1)).alias("values"))
    names = spark.createDataFrame([(i, t, c) for (t, c), i in number.items()], "i int, table string, column string")
    known = F.broadcast(names.join(unique, "i"))                     # a row a column
    pairs = common.select("i", F.col("values").alias("child_values"), F.explode(
        F.filter(every, lambda j: has(j, word_of) & (j != F.col("i")))).alias("j"))
    child, parent = known.alias("child"), known.alias("parent")
    return (pairs.join(child, pairs["i"] == F.col("child.i")).join(parent, F.col("j") == F.col("parent.i"))
            .select(F.col("child.table").alias("child_table"), F.col("child.column").alias("child_column"),
                    F.col("parent.table").alias("parent_table"), F.col("parent.column").alias("parent_column"),
                    "child_values", F.col("parent.values").alias("parent_values"),
                    F.col("parent.unique").alias("parent_unique")))


#: Size of the distinct sketches (2 ** LG_K buckets), their relative error, and how many times it a key's estimate may lie
#: below the number of rows.
LG_K, RSD, TIMES = 12, 0.0163, 10
#: Column sets compared in one job, and the rows (one a set and a row of the table) that a job shuffles: a set at least.
AT_ONCE, ROWS_AT_ONCE = 100, 1 << 24
#: More rows than that are first looked through in one of so many slices of the values.
SLICES = 256
#: Types whose values differ where their texts do, but for the sign of a zero.
_HASHED_AS_IS = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampNTZType, T.StringType)


def candidate_keys(df: DataFrame, max_columns: int = 2, columns=None) -> DataFrame:
    """The minimal column sets of at most ``max_columns`` whose values differ in every row: ``columns`` (by name).

    Sets are tried by size; one with a key in it is not minimal and is left out.  One scan estimates the distinct
    values of each column, which leaves out the sets that have too few.  The others are compared by 64-bit hashes, and
    hashes that come twice by digests of the values.  If that is much to shuffle, a first job takes the rows of
    one slice of the hashes: what comes twice there is no key.  What is left is compared in all rows, a few sets at a
    time, whose shuffle files go before the next.  Columns with missing values are in no key.  A table without rows
    has no keys.
    """
    spark = df.sparkSession
    fields = {f.name: f for f in df.schema.fields}
    names = list(columns or df.columns)
    text = {c: as_text(fields[c]) for c in names}
    as_is = {c: isinstance(fields[c].dataType, _HASHED_AS_IS) for c in names}
    value = {c: F.col(f"`{c}`") if as_is[c] else text[c] for c in names}
    hashed = {c: [value[c], F.when(value[c] == 0, text[c])] if isinstance(fields[c].dataType, (T.DoubleType, T.FloatType))
              else [value[c]] for c in names}
    worded = {c: not as_is[c] or isinstance(fields[c].dataType, T.StringType) for c in names}     # may be empty texts
    size = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(is_present(text[c]) if worded[c] else value[c].isNotNull()).alias(f"c{i}") for i, c in enumerate(names)], *[
        F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*hashed[c]), F.lit(LG_K))).alias(f"v{i}")
        for i, c in enumerate(names)]).first()
    rows = size["_n"]
    values = {c: size[f"v{i}"] for i, c in enumerate(names) if rows and size[f"c{i}"] == rows}     # of whole columns
    found: list[tuple[str, ...]] = []
    for n in range(1, max_columns + 1):
        # a set has no more values than the product of its columns'
        sets = [s for s in combinations(values, n) if not any(set(k) <= set(s) for k in found)
                and _product(values[c] for c in s) >= rows * (1 - TIMES * RSD)]
        if len(sets) * rows > ROWS_AT_ONCE:
            for some in _batches(sets, AT_ONCE):
                repeated = _repeated(df, some, text, hashed, SLICES)
                sets = [s for s in sets if s not in repeated]
        for some in _batches(sets, max(1, min(AT_ONCE, ROWS_AT_ONCE // max(rows, 1)))):
            repeated = _repeated(df, some, text, hashed)
            found += sorted(s for s in some if s not in repeated)
    return spark.createDataFrame([(list(k),) for k in found], "columns array<string>")


def _repeated(df: DataFrame, sets, text, hashed, slices: int = 1) -> set:
    """Those of ``sets`` with values that come twice, in the slice of the values whose hash is a multiple of ``slices``."""
    hashes = [_hash([h for c in s for h in hashed[c]]) for s in sets]
    digests = [row_digest([text[c] for c in s]) for s in sets]
    with shuffles_freed(df.sparkSession):
        doubled = (_of_sets(df, [h % slices == 0 for h in hashes] if slices > 1 else None, hashes).groupBy("s", "v")
                   .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .groupBy("s").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
                   .collect())                                                                     # a row a set
        again = lambda chosen, values: {r["s"] for r in (
            _of_sets(df, chosen, values).groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select("s").distinct().collect())}
        if not doubled:
            return set()
        hit = {r["s"]: hashes[r["s"]].isin(r["low"], r["high"]) for r in doubled}
        real = again([hit.get(i, F.lit(False)) for i in range(len(sets))], digests)
        # different values under one hash, and more such hashes than were looked at: rare, and compared in full
        open_ = {r["s"] for r in doubled if r["s"] not in real and r["n"] > 2}
        if open_ and slices == 1:
            for i in sorted(open_):
                real |= {i} if again(None, [digests[i]]) else set()
    return {sets[i] for i in real}


def _of_sets(df: DataFrame, chosen, values) -> DataFrame:
    """Rows (s, v): of every row the value ``v`` of each set ``s`` that is chosen in it (None: all)."""
    of = [F.struct(F.lit(i).alias("s"), v.alias("v")) for i, v in enumerate(values)]
    if chosen is None:
        return df.select(F.inline(F.array(*of)))
    return (df.where(reduce(Column.__or__, chosen))
            .select(F.inline(F.array_compact(F.array(*[F.when(c, v) for c, v in zip(chosen, of, strict=True)])))))


def _hash(columns) -> Column:
    return F.xxhash64(*columns)


def _batches(items: list, most: int) -> list[list]:
    return [items[at:at + most] for at in range(0, len(items), most)]


def _product(numbers) -> float:
    out = 1.0
    for x in numbers:
        out *= x
    return out
