"""Writing small results for people: one file, whole or not at all."""

from __future__ import annotations

import csv
import gzip
import json
import os
from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, fields: list[str] | None = None, order: list[str] | None = None) -> int:
    """Rows as one CSV in the order of fields, nulls empty; the file appears only when it is whole. Rows stream
    through the driver a partition at a time."""
    fields = rows.columns if fields is None else fields
    if not fields:
        raise ValueError("no columns to write")
    out, n = rows.select(*fields), 0
    out = out.orderBy(*order) if order else out
    with open(f"{path}.part", "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(fields)
        for row in out.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    os.replace(f"{path}.part", path)
    return n


def write_provenance(path: str, facts: dict[str, Any]) -> None:
    """Counts, rules and seeds as JSON with sorted keys."""
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        json.dump(facts, file, indent=2, sort_keys=True, default=str)
        file.write("\n")
    os.replace(f"{path}.part", path)


def write_table(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Parquet, in folders by keys; a table that is there already isn't touched."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_long_genes(rows: DataFrame, path: str, fields: list[str], genes: Sequence[str], gene: str) -> int:
    """The rows of the asked genes as one CSV, packed where the name says so, and beside it the asked genes that no row
    has."""
    if not path.endswith((".csv", ".csv.gz")):
        raise ValueError(f"neither csv nor csv.gz: {path}")
    hit = rows.where(F.col(gene).isin(list(genes)))
    there = {r[0] for r in hit.select(gene).distinct().collect()}  # of the asked ones
    n = 0
    open_ = gzip.open if path.endswith(".gz") else open
    with open_(f"{path}.part", "wt", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(fields)
        for row in hit.select(*fields).toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            n += 1
    os.replace(f"{path}.part", path)
    with open(f"{path}.missing_genes.txt", "w", encoding="utf-8") as file:
        file.writelines(f"{g}\n" for g in genes if g not in there)
    return n


def write_or_csv(rows: DataFrame, path: str) -> str:
    """'parquet', or where that can't be written a CSV beside it and why."""
    try:
        rows.write.mode("errorifexists").parquet(path)
        return "parquet"
    except PySparkException as error:
        write_csv(rows, f"{path}.csv")
        return f"csv: {str(error).splitlines()[0][:200]}"
