"""The driver's parquet tables and the dirty-payments fixture derived from ``orders``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dirty_payments(orders: DataFrame) -> DataFrame:
    """Payments-like table, all text columns as from a CSV, with planted dirt.

    Derived row by row from ``orders`` (one scan; every 101st key is emitted
    twice through ``explode`` instead of a second scan and a union).
    """
    s = lambda c: c.cast("string")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    amt = s(F.floor("o_totalprice").cast("bigint"))
    d = F.substring(s(F.col("o_orderdate")), 1, 10)
    null = F.lit(None).cast("string")
    shaped = orders.select(
        s(k).alias("txn_id"),
        F.when(k % 97 == 0, s(ck + 10000000)).otherwise(s(ck)).alias("client_id"),
        F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, null)
        .otherwise(F.concat(F.lit("user"), s(ck), F.lit("@mail.example"))).alias("email"),
        F.when(k % 17 == 0, null).otherwise(F.concat(F.lit("Street "), s(ck % 50))).alias("kyc_address"),
        F.when(k % 23 == 0, F.concat(F.lit("$"), amt)).when(k % 29 == 0, F.concat(F.lit("-"), amt))
        .when(k % 31 == 0, F.lit("")).otherwise(amt).alias("amount"),
        F.when(k % 11 == 0, F.concat(F.substring(d, 6, 2), F.lit("/"), F.substring(d, 9, 2), F.lit("/"),
                                     F.substring(d, 1, 4)))
        .when(k % 13 == 0, F.concat(F.substring(d, 6, 2), F.lit("/"), F.substring(d, 1, 4)))
        .otherwise(d).alias("txn_date"),
        F.when(k % 41 == 0, F.lit("2031-01-01")).otherwise(d).alias("updated_at"),
        F.concat(F.upper(F.substring("o_orderpriority", 3, 3)), s(ck)).alias("ref_code"),
        F.when(k % 3 == 0, F.lit("Visa")).when(k % 3 == 1, F.lit("Amex")).otherwise(F.lit("Diners"))
        .alias("card_brand"),
        F.when((k % 3 == 0) & (k % 37 != 0), F.concat(F.lit("4"), F.lpad(s(k), 15, "0")))
        .when(k % 3 == 2, F.concat(F.lit("36"), F.lpad(s(k), 12, "0")))
        .otherwise(F.concat(F.lit("37"), F.lpad(s(k), 13, "0"))).alias("card_number"),
        F.when(k % 43 == 0, F.lit("0")).otherwise(s(100 + k % 900)).alias("cvv"),
        F.col("o_orderstatus").alias("status"),
        F.when(k % 101 == 0, F.lit(2)).otherwise(F.lit(1)).alias("_copies"),
    )
    return (shaped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .drop("_copies", "_copy"))


def load_dirty_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_payments(table(spark, sf_dir, "orders"))
