"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.plans.prefix import shared_folder

#: The white space of all contracts here: space and the controls from tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\v\f\r"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's folder in spark.checkpoint.dir; one of this machine only where the session runs on it alone."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, where a lost executor can't take it along."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """cut, after which the driver lets go of what finished stages left there: their plans, broadcasts, and the lists of
    their shuffles, which Spark drops (with the files) only once the driver's collector has seen that nothing needs them."""
    out = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    release()
    return out


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all else as it is: lower() would also fold other alphabets, so it takes text of one byte a
    character only."""
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, however its columns are written."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Hands freed memory back to the machine: the driver and Python workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def _then_released(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    try:
        yield from work(batches)
    finally:
        release()


def released(work: Callable) -> Callable:
    """work, a function for mapInArrow, that keeps no freed memory in its worker when a task ends."""
    return partial(_then_released, work=work)
