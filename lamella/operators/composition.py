"""Shares of a total, at the grain of the rows: composition of a group and how much of it is covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.plans import table


def composition_share(rows: DataFrame, group: str, part: str, amount: str) -> DataFrame:
    """(group, part, amount, share): the parts' sums and their shares of the group's sum; null where that is 0."""
    sums = rows.groupBy(group, part).agg(F.sum(amount).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy(group))
    return sums.withColumn("share", F.round(F.when(total != 0, F.col("amount") / total), 9))


def q_composition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_quantity").join(parts, "l_partkey")
    return composition_share(rows, "l_returnflag", "p_brand", "l_quantity")


QUERIES = {"composition_share": q_composition_share}
SQL = {
    "composition_share": """
SELECT l_returnflag, p_brand, sum(l_quantity) AS amount,
  round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 9) AS share
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag, p_brand
"""
}
