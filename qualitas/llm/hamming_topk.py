"""Operator 5: exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of an embedding's components.  Codes are cut into m segments, and every segment is an index from
its value to the codes that have it.  Rounds grow the radius r, half of the segments at a time: a round probes, in
its segments, the values at exactly r bits from the query's, and verifies the full distance of what it finds.  When
j segments have been searched to radius r and the others to r - 1, a code not found so far differs in more than r
bits in each of the j and in r at least in each other, so its distance is ``m * r + j`` or more; a query is done
when its k-th best verified distance is below that, which proves that nothing better, or equally good, is left.
Until then the k-th distance so far bounds what is verified further.

Equal codes are indexed once with their k smallest ids, which are all that a top k can need, and equal queries are
searched once; a code that a third of all rows share therefore costs no more than any other.  A code is taken only
by the first of its nearest segments, so no pair is verified twice and nothing has to be de-duplicated.

Results are ordered by distance and then id; a query finds itself too if it is in the table.  Rows without an id or
an embedding are neither found nor searched; null or NaN components count as not positive.  Codes shorter than
the longest are refused.  Repeated rows are found as often as they occur (up to k).  Fewer than k rows give as many
results as there are; an empty table gives none.  Other columns are ignored.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualitas.session import work_folder, written

K = 10
#: Bits of a segment as a part of log2(rows): fewer bits mean fewer probes, more mean fewer candidates.
SEGMENT_SHARE = 0.7


def bits_of(embedding: Column, first: int, width: int) -> Column:
    """The signs of ``width`` components as an integer."""
    part = F.slice(embedding, first + 1, width)
    return F.aggregate(part, F.lit(0), lambda code, x: F.shiftleft(code, 1).bitwiseOR(
        F.when((x > 0) & ~F.isnan(x.cast("double")), 1).otherwise(0)))


def segments_for(dimensions: int, rows: int) -> list[tuple[int, int]]:
    """Cut ``dimensions`` bits into segments: (first, width)."""
    n = max(1, round(dimensions / max(1.0, min(16.0, SEGMENT_SHARE * math.log2(max(rows, 2))))))
    cuts = [dimensions * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", code_col: str = "embedding") -> DataFrame:
    """``query_id, rank, neighbour_id, distance``: the k nearest of ``rows`` for each row of ``queries``."""
    spark = rows.sparkSession
    folder = work_folder(spark, "hamming")
    here = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL")
    size = here(rows).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    dimensions = size["d"] or 0
    if not dimensions:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance int")
    cut = segments_for(dimensions, size["n"])

    def coded(df):
        whole = F.when(F.size("v") == dimensions, F.col("v")).otherwise(
            F.raise_error(F.lit(f"an embedding doesn't have {dimensions} components")))
        return here(df).select("id", F.array(*[bits_of(whole, a, n) for a, n in cut]).alias("code"))

    nearest_ids = Window.partitionBy("code").orderBy("id")
    index = written(coded(rows).withColumn("place", F.row_number().over(nearest_ids)).where(F.col("place") <= k)
                    .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), f"{folder}/index")
    asked = written(coded(queries), f"{folder}/queries")
    open_ = written(asked.select(F.col("code").alias("query")).distinct().withColumn("kth", F.lit(dimensions)),
                    f"{folder}/open-0")
    by_segment = index.select(F.posexplode("code").alias("segment", "value"), "code", "ids")
    best = spark.createDataFrame([], open_.schema).select("query", F.lit(0).alias("distance"), F.lit(0).cast("long").alias("id"))
    done, tasks, half = best, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(cut) // 2)
    rounds = [(radius, part) for radius in range(max(n for _, n in cut) + 1)
              for part in (range(half), range(half, len(cut))) if part]
    for turn, (radius, part) in enumerate(rounds):
        masks = F.array(*[F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda x: F.bit_count(x) == radius)
                          for _, n in cut])
        probes = (open_.repartition(tasks).select("query", "kth", F.posexplode("query").alias("segment", "own"))
                  .where(F.col("segment").between(part[0], part[-1]))
                  .select("query", "kth", "segment", F.explode(F.transform(
                      F.element_at(masks, F.col("segment") + 1), lambda m: m.bitwiseXOR(F.col("own")))).alias("value")))
        differ = [F.bit_count(F.col("query")[i].bitwiseXOR(F.col("code")[i])) for i in range(len(cut))]
        distance = reduce(Column.__add__, differ)
        # taken by the first of the nearest segments only: none is nearer, and none before it is as near
        first = reduce(Column.__and__, [(d >= radius) & ((F.col("segment") <= i) | (d > radius))
                                        for i, d in enumerate(differ)])
        # either side grows with the table, so neither is broadcast
        found = (probes.join(by_segment.where(F.col("segment").between(part[0], part[-1])).hint("merge"),
                             ["segment", "value"])
                 .where((distance <= F.col("kth")) & first)
                 .select("query", distance.alias("distance"), F.explode("ids").alias("id")))
        order = Window.partitionBy("query").orderBy("distance", "id")
        best = written(best.unionAll(found).withColumn("place", F.row_number().over(order))
                       .where(F.col("place") <= k).drop("place"), f"{folder}/best-{turn}")
        covered = len(cut) * radius + part[-1] + 1               # every code nearer than this has been verified
        kth = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last"))
        state = open_.select("query").join(kth, "query", "left").withColumn(
            "kth", F.when(F.col("n") == k, F.col("last")).otherwise(F.lit(dimensions)))
        proved = (F.col("n") == k) & (F.col("kth") < covered)
        open_ = written(state.where(~F.coalesce(proved, F.lit(False))).select("query", "kth"), f"{folder}/open-{turn + 1}")
        done = done.unionAll(best.join(open_, "query", "left_anti"))
        best = best.join(open_, "query", "left_semi")
        if open_.isEmpty():
            break
    done = written(done.unionAll(best), f"{folder}/done")        # what is still open has been compared with every code
    ranked = Window.partitionBy("query").orderBy("distance", "id")
    results = written(done.withColumn("rank", F.row_number().over(ranked)), f"{folder}/results")
    return (asked.join(results.withColumnRenamed("id", "neighbour_id"), asked["code"] == results["query"])
            .select(F.col("id").alias("query_id"), "rank", "neighbour_id", F.col("distance").cast("int").alias("distance")))
