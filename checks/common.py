"""Table loading and the derived inputs shared by several queries.

Key arithmetic in the checks plants differences: dropped, added, changed, null or unowned rows. It never makes an
input smaller for the sake of the comparison; every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_changed(orders: DataFrame) -> DataFrame:
    """A second environment: some keys dropped, some added, some prices and statuses changed."""
    key = F.col("o_orderkey")
    kept = orders.where(key % 97 != 0).select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 83 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )
    added = orders.where(key % 101 == 0).withColumn("o_orderkey", key + 1_000_000_000)
    return kept.unionByName(added)


ORDERS_CHANGED = """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 83 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 97 <> 0
    UNION ALL
    SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 101 = 0
"""


def orders_dirty(orders: DataFrame) -> DataFrame:
    """Orders with null and unknown statuses and with repeated keys."""
    key = F.col("o_orderkey")
    status = F.when(key % 50 == 0, F.lit(None)).when(key % 70 == 0, "?").otherwise(F.col("o_orderstatus"))
    dirty = orders.withColumn("o_orderstatus", status)
    return dirty.unionByName(dirty.where(key % 60 == 0))


ORDERS_DIRTY = """
    WITH d AS (SELECT o_orderkey, o_custkey,
                      CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 70 = 0 THEN '?' ELSE o_orderstatus END AS o_orderstatus,
                      o_totalprice, o_orderdate, o_orderpriority FROM orders)
    SELECT * FROM d UNION ALL SELECT * FROM d WHERE o_orderkey % 60 = 0
"""
