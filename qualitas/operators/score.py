"""Dimension scores, composite score and detector evaluation.

score(d) = 1 - sum(bad) / sum(eligible) over the rules of d (1.0 when nothing
is eligible); composite = sum(w * score) / sum(w).  Both are rounded half-up
to 6 decimals in exact integer arithmetic (parts per million).
"""
from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualitas.functions import grammar as G
from qualitas.functions.text import scaled_ratio

PPM = 1_000_000


def dimension_scores(rule_rows: DataFrame) -> DataFrame:
    spark = rule_rows.sparkSession
    dims = spark.createDataFrame([(d, i) for i, d in enumerate(G.DIMENSIONS)], "dimension string, dim_order int")
    sums = rule_rows.groupBy("dimension").agg(F.sum("bad").cast("bigint").alias("bad"),
                                               F.sum("eligible").cast("bigint").alias("eligible"))
    j = dims.join(sums, "dimension", "left")
    bad = F.coalesce(F.col("bad"), F.lit(0).cast("bigint"))
    elig = F.coalesce(F.col("eligible"), F.lit(0).cast("bigint"))
    ppm = F.when(elig > 0, scaled_ratio(elig - bad, elig, PPM)).otherwise(F.lit(PPM).cast("bigint"))
    return j.select("dimension", "dim_order", bad.alias("bad"), elig.alias("eligible"),
                    ppm.alias("score_ppm"), (ppm / PPM).alias("score"))


def composite_score(scores: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted average of the dimension scores; weights in steps of a millionth, default all 1."""
    spark = scores.sparkSession
    w = weights or {d: 1 for d in G.DIMENSIONS}
    micro = [(d, int((Decimal(str(w.get(d, 0))) * PPM).to_integral_value(ROUND_HALF_UP))) for d in G.DIMENSIONS]
    wdf = spark.createDataFrame(micro, "dimension string, weight bigint")
    j = scores.join(F.broadcast(wdf), "dimension")
    agg = j.agg(F.sum(F.col("weight").cast("decimal(30,0)") * F.col("score_ppm")).alias("num"),
                F.sum("weight").alias("den"))
    ppm = scaled_ratio(F.col("num"), F.col("den"), 1)
    return agg.select(ppm.alias("composite_ppm"), (ppm / PPM).alias("composite_dqs"))


def confusion(counts: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 from rows ``predicted, actual, n``."""
    p, t = F.col("predicted"), F.col("actual")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    agg = counts.agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"), n(~p & ~t).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select("tp", "fp", "fn", "tn",
                      F.try_divide(tp, tp + fp).alias("precision"),
                      F.try_divide(tp, tp + fn).alias("recall"),
                      F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def detector_evaluation(pred: DataFrame, truth: DataFrame, on, pred_col: str, truth_col: str) -> DataFrame:
    """Evaluation of a row-level detector against labels; NULL counts as false on either side."""
    keys = [on] if isinstance(on, str) else list(on)
    false = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    j = pred.select(*keys, false(pred_col).alias("predicted")).join(truth.select(*keys, false(truth_col).alias("actual")), keys)
    return confusion(j.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n")))
