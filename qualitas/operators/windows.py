"""Window operators: conversation tail and latest audit per dataset.

Both are ``row_number() <= k`` filters, which Spark plans as a
WindowGroupLimit on each side of the shuffle: a conversation (or dataset)
holding a third of all rows still ships only k rows per map task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualitas.functions import grammar as G


def message_line(role="role", text="text"):
    """'role: content' line of one message."""
    return F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))


def transcripts_tail(conv: DataFrame, keep: int = G.TRANSCRIPT_KEEP, conv_col: str = "conv_id",
                     turn_col: str = "turn") -> DataFrame:
    """Per conversation (NULL is one): message count, kept count and the transcript of its last ``keep`` messages.

    Messages of one turn are ordered by their line; those without a turn come first.
    """
    rows = conv.select(conv_col, turn_col, message_line().alias("line"))
    w = Window.partitionBy(conv_col).orderBy(F.col(turn_col).desc(), F.col("line").desc())
    tail = rows.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= keep)
    text = tail.groupBy(conv_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("kept_messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_rk")).alias("at"), "line"))),
                                 lambda e: e["line"]), "\n").alias("transcript"))
    counts = conv.groupBy(F.col(conv_col).alias("_conv")).agg(F.count(F.lit(1)).cast("bigint").alias("n_messages"))
    return counts.join(text, F.col("_conv").eqNullSafe(F.col(conv_col))).select(
        conv_col, "n_messages", "kept_messages", "transcript")


def latest_per_key(history: DataFrame, key: str = "dataset_name",
                   order_col: str = "ingestion_timestamp") -> DataFrame:
    """The most recent row per key; of equally recent ones the first by the remaining columns in their order."""
    rest = [F.col(f"`{f.name}`") if not isinstance(f.dataType, T.MapType) else F.to_json(F.col(f"`{f.name}`"))
            for f in history.schema.fields if f.name not in (key, order_col)]
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc(), *rest)
    return history.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk")
