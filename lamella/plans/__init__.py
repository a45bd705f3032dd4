"""Reading tables for the registered queries."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """A table's columns by expressions that both engines read: inputs of the registered queries."""
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


def made_sql(name: str, columns: dict[str, str]) -> str:
    return "(SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {name})"
