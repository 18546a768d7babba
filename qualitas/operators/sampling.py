"""Samples of an exact size: the k rows of the least hashed priorities."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions.predicates import as_text

#: Hexadecimal digits that one round of the search decides, and the number of priorities that a last one fetches.
DIGITS, FETCHED = 3, 4_096


def priority(df: DataFrame, seed: int, keys=None):
    """MD5 of the seed and the row's values (or its ``keys``') with their lengths: a uniform number, as hex digits."""
    fields = {f.name: f for f in df.schema.fields}
    texts = [as_text(fields[c]) for c in (keys or df.columns)]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat(F.lit(f"{seed};"), *parts))


def bottom_k(df: DataFrame, k: int, seed: int = 0, keys=None) -> DataFrame:
    """Exactly ``k`` rows of ``df`` (all, if there are fewer), every row as likely as any other.

    The sample depends on the rows and the seed alone, not on their order or partitioning, and is mergeable: the
    bottom k of a union is that of the parts' bottom k.  Rows are ranked by a hash, so no row goes through a common
    task: counts by leading digits of the priorities lead to the k-th one in a few rounds, and a filter takes what
    lies below.  Rows with equal values (of ``keys``, if given) have one priority; at the cut the rest is drawn from
    them by all their values, and rows equal in all of them are interchangeable.
    """
    if k < 0:
        raise ValueError(f"k must not be negative: {k}")
    rows = df.withColumn("_priority", priority(df, seed, keys))
    prefix, need = "", k
    while True:
        digits = F.substring("_priority", len(prefix) + 1, DIGITS)
        counts = sorted((r["d"], r["n"]) for r in rows.where(F.col("_priority").startswith(prefix)).groupBy(
            digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())       # 16 ** DIGITS rows at most
        if not prefix and sum(n for _, n in counts) <= k:
            return df
        for d, n in counts:
            if n >= need:
                break
            need -= n
        prefix += d
        if n <= FETCHED or len(prefix) >= 32:
            break
    last = sorted((r["_priority"], r["n"]) for r in rows.where(F.col("_priority").startswith(prefix)).groupBy("_priority")
                  .agg(F.count(F.lit(1)).alias("n")).collect())                   # FETCHED rows at most
    for cut, n in last:
        if n > need:
            break
        need -= n
        if not need:
            return rows.where(F.col("_priority") <= cut).drop("_priority")
    below = rows.where(F.col("_priority") < cut).drop("_priority")
    if not need:
        return below
    tied = rows.where(F.col("_priority") == cut).drop("_priority")
    if keys:
        return below.unionByName(bottom_k(tied, need, seed))
    copies = tied.agg(F.first(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("r"))
    return below.unionByName(copies.select("r", F.explode(F.sequence(F.lit(1), F.lit(need)))).select("r.*"))
