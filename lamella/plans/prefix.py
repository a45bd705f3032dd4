"""Running sums, minima and places inside groups, without any task that holds a whole group."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Tables counted to have no more rows are broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where the session runs on it alone and has set none."""
    if folder := spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set; it names a folder that all executors share")
    return tempfile.mkdtemp(prefix="lamella-")


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and kept in the shared folder."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)


def running(rows: DataFrame, groups: list[str], order: list[Column | str], sums: dict[str, Column | str], lows: dict[str, Column | str] | None = None) -> DataFrame:
    """rows with, for each name of sums, the sum of its expression over the group's rows before this one, and for each
    of lows the least value over this row and those before it.

    Rows are range-sorted by (group, order), so that a group with a third of all rows lies in many partitions. Sums run
    inside a partition; those of the partitions before come from a table with a row for each partition and group in it.
    Rows that are equal in order are taken in any order, but all in one partition: order should tell rows apart.
    """
    lows = lows or {}
    keys = [f"_o{i}" for i in range(len(order))]
    made = rows.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)})
    made = made.withColumns({f"_s{i}": F.col(e) if isinstance(e, str) else e for i, e in enumerate(sums.values())} | {f"_l{i}": F.col(e) if isinstance(e, str) else e for i, e in enumerate(lows.values())})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(made.repartitionByRange(parts, *groups, *keys).withColumn("_part", F.spark_partition_id()))
    whole = dealt.groupBy(*groups, "_part").agg(*(F.sum(f"_s{i}").alias(f"_ts{i}") for i in range(len(sums))), *(F.min(f"_l{i}").alias(f"_tl{i}") for i in range(len(lows))), F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)), F.col("_part").alias("_p"), *(F.sum(f"_ts{i}").over(before).alias(f"_bs{i}") for i in range(len(sums))), *(F.min(f"_tl{i}").over(before).alias(f"_bl{i}") for i in range(len(lows))))
    here = Window.partitionBy(*groups, "_part").orderBy(*keys)
    upto, now = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({f"_is{i}": F.sum(f"_s{i}").over(upto) for i in range(len(sums))} | {f"_il{i}": F.min(f"_l{i}").over(now) for i in range(len(lows))})
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    whole = kept(whole)
    joined = local.join(F.broadcast(whole) if whole.count() <= BROADCAST_ROWS else whole.hint("merge"), same)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {n: zero(f"_bs{i}") + zero(f"_is{i}") for i, n in enumerate(sums)} | {n: F.least(f"_bl{i}", f"_il{i}") for i, n in enumerate(lows)}
    return joined.select(*(joined[c] for c in rows.columns), *(e.alias(n) for n, e in out.items()))


def average_ranks(rows: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """rows (with a value) with its rank inside the group, ties sharing the mean of their places, and the number of
    ties. Distinct values are counted before any sort; only their counts run."""
    counts = rows.groupBy(*groups, value).agg(F.count("*").alias(f"{name}_ties"))
    placed = running(counts, groups, [value], {"_before": f"{name}_ties"})
    placed = placed.select(*(F.col(g).alias(f"_k{i}") for i, g in enumerate(groups)), F.col(value).alias("_v"), f"{name}_ties", (F.col("_before") + (F.col(f"{name}_ties") + 1) / F.lit(2.0)).alias(name))
    same = F.col(value).eqNullSafe(F.col("_v"))
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(placed, same).drop("_v", *(f"_k{i}" for i in range(len(groups))))
