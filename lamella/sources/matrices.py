"""Count matrices and row tables as array containers lay them out: codes and categories, rows compressed, columns
compressed, dense. A container is staged as a table of its arrays, one row an array slice, and decoded by joins and
explodes; which rows and which genes are read is a filter that reaches the staged files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans import made, made_sql
from lamella.plans.prefix import running


def decoded(codes: DataFrame, categories: DataFrame, row: str, code: str, missing: str | None = "") -> DataFrame:
    """(row, value): a categorical column from its codes and categories (code, value). A negative code, and one that no
    category has, is missing."""
    joined = codes.join(categories.select(F.col(code), "value"), code, "left")
    return joined.select(row, F.coalesce("value", F.lit(missing)).alias("value") if missing is not None else "value")


def rows_compressed(slices: DataFrame) -> DataFrame:
    """(row, column, count) of a matrix by rows: slices have the row, and lists of columns and values."""
    each = slices.select("row", F.explode(F.arrays_zip("columns", "data")).alias("e"))
    return each.select("row", F.col("e.columns").alias("column"), F.col("e.data").alias("count"))


def pointers(indptr: DataFrame) -> DataFrame:
    """(row, start, end) from row pointers (place, at): row k lies between the k-th pointer and the next."""
    after = indptr.select((F.col("place") - 1).alias("place"), F.col("at").alias("end"))
    return indptr.join(after, "place").select(F.col("place").alias("row"), F.col("at").alias("start"), "end")


def from_pointers(indptr: DataFrame, cells: DataFrame, block: int = 4096) -> DataFrame:
    """(row, column, count): cells (place, column, count) of a flat array, whose rows are told by pointers. Rows reach
    over blocks of places, and a cell meets the rows of its block only."""
    spans = pointers(indptr).where("end > start").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    flat = cells.withColumn("_b", F.floor(F.col("place") / block))
    return flat.join(spans, "_b").where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("end"))).select("row", "column", "count")


def dense(rows: DataFrame, row: str, values: str) -> DataFrame:
    """(row, column, count) of a dense matrix, zeros left out."""
    return rows.select(F.col(row).alias("row"), F.posexplode(values).alias("column", "count")).where("count <> 0")


def genes_read(counts: DataFrame, genes: DataFrame, wanted: Sequence[str], column: str = "column") -> DataFrame:
    """counts of the wanted genes (place, symbol) with their symbol; a gene that isn't there, or is there twice, fails."""
    hit = genes.where(F.col("symbol").isin(list(wanted)))
    found = {r["symbol"]: r["n"] for r in hit.groupBy("symbol").agg(F.count("*").alias("n")).collect()}  # the wanted ones
    if missing := sorted(set(wanted) - set(found)):
        raise KeyError(f"no gene {missing}")
    if twice := sorted(g for g, n in found.items() if n > 1):
        raise ValueError(f"several genes {twice}")
    return counts.join(F.broadcast(hit.select(F.col("place").alias(column), "symbol")), column)


def count_storage(counts: DataFrame, value: str) -> DataFrame:
    """One row: whether all values are finite, whole and not negative."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return counts.agg(F.count("*").alias("n"), F.bool_and(finite).alias("finite"), F.bool_and(finite & (v == F.floor(v))).alias("whole"), F.bool_and(finite & (v >= 0)).alias("not_negative"))


def coordinates(arrays: DataFrame, row: str, key: str, values: str, words: Sequence[str] = ("spatial", "coord", "xy", "position", "centroid")) -> DataFrame:
    """(row, x, y) from the array whose key is preferred by the order of words (ties: the smaller key). An array of fewer
    than two columns fails; without a key that holds a word there are no rows."""
    place = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(words))):
        place = F.when(F.lower(F.col(key)).contains(w), i).otherwise(place)
    keys = arrays.select(key).distinct().withColumn("_w", place).where("_w IS NOT NULL")
    best = keys.agg(F.min(F.struct("_w", key)).alias("_b")).select(F.col(f"_b.{key}").alias(key))
    narrow = F.raise_error(F.concat(F.lit("fewer than two columns: "), F.col(key))).cast("double")
    at = lambda i: F.when(F.size(values) >= 2, F.element_at(values, i)).otherwise(narrow)
    return arrays.join(best, key).select(row, at(1).alias("x"), at(2).alias("y"))


def melted(wide: DataFrame, key: str, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """(key, name, value) of a wide table, zeros and missing values left out."""
    return wide.unpivot([key], list(columns), name, value).where(F.col(value) > 0)


def section_cells(cells: DataFrame, genes: DataFrame, barcode: str, pools: dict[str, str], first: int = 300) -> DataFrame:
    """(cell, class, total, ...): the cells of one barcode with the sum of their counts, checked against the stated total
    on the first cells, and for each pool of genes (by prefix) the sum and mean of ln(1 + 10,000 * count / total).

    cells: (cell, place, barcode, class, spots); genes: (cell, gene, count)."""
    own = cells.where(F.col("barcode") == barcode)
    sums = genes.join(own.select("cell"), "cell").groupBy("cell").agg(F.sum("count").alias("total"))
    checked = own.join(sums, "cell", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    early = F.row_number().over(Window.orderBy("place")) <= first  # one section's cells
    bad = early & (F.col("total") != F.col("spots"))
    checked = checked.withColumn("total", F.when(bad, F.raise_error(F.concat(F.lit("counts don't sum to spots in cell "), F.col("cell").cast("string"))).cast("bigint")).otherwise(F.col("total")))
    norm = F.log1p(1e4 * F.col("count") / F.greatest(F.col("spots"), F.lit(1)))
    each = genes.join(own.select("cell", "spots"), "cell").withColumn("_n", norm)
    pool = each.groupBy("cell").agg(*(f(F.when(F.startswith("gene", F.lit(prefix)), F.col("_n"))).alias(f"{name}_{how}") for name, prefix in pools.items() for how, f in (("sum", F.sum), ("mean", F.avg))))
    names = [f"{name}_{how}" for name in pools for how in ("sum", "mean")]
    return checked.join(pool, "cell", "left").select("cell", "class", "total", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in names))


_CELLS = {"row": "l_orderkey", "column": "CAST(l_partkey % 50 AS INT)", "count": "CAST(l_quantity AS INT)"}


def _cells(s, d):
    return made(s, d, "lineitem", _CELLS).groupBy("row", "column").agg(F.sum("count").alias("count"))


def _pointers(s, d):
    """The cells as a flat array by rows, and its pointers."""
    cells = running(_cells(s, d), [], ["row", "column"], {"place": F.lit(1)})
    ends = cells.groupBy("row").agg(F.count("*").alias("n"))
    last = ends.agg(F.max("row")).first()[0]
    rows = s.range((-1 if last is None else last) + 1).select(F.col("id").alias("row")).join(ends, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    upto = running(rows, [], ["row"], {"at": "n"}).select((F.col("row") + 1).alias("place"), (F.col("at") + F.col("n")).alias("at"))
    return upto.union(s.createDataFrame([(0, 0)], "place long, at long")), cells.select("place", "column", "count")


def _section(s, d):
    cells = made(s, d, "orders", {"cell": "o_orderkey", "place": "o_orderkey", "barcode": "'B' || CAST(o_custkey % 4 AS STRING)", "class": "o_orderstatus"})
    genes = made(s, d, "lineitem", {"cell": "l_orderkey", "gene": "CASE l_linenumber % 2 WHEN 0 THEN 'MT' ELSE 'RP' END || CAST(l_partkey % 30 AS STRING)", "count": "CAST(l_quantity AS BIGINT)"})
    spots = genes.groupBy("cell").agg(F.sum("count").alias("spots"))
    cells = cells.join(spots, "cell", "left").withColumn("spots", F.coalesce("spots", F.lit(0)))
    return section_cells(cells, genes, "B2", {"mito": "MT", "ribo": "RP"})


QUERIES = {
    "decoded_categories": lambda s, d: decoded(made(s, d, "orders", {"row": "o_orderkey", "code": "CAST(o_custkey % 30 AS INT) - 2"}), made(s, d, "nation", {"code": "n_nationkey", "value": "n_name"}), "row", "code"),
    "rows_compressed": lambda s, d: rows_compressed(_cells(s, d).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("column", "count"))).alias("l")).select("row", F.col("l.column").alias("columns"), F.col("l.count").alias("data"))),
    "row_pointers": lambda s, d: from_pointers(*_pointers(s, d), block=64),
    "dense_matrix": lambda s, d: dense(made(s, d, "supplier", {"row": "s_suppkey", "a": "s_suppkey % 3", "b": "s_nationkey % 2", "c": "5"}).select("row", F.array("a", "b", "c").cast("array<long>").alias("v")), "row", "v"),
    "genes_read": lambda s, d: genes_read(_cells(s, d), made(s, d, "part", {"place": "CAST(p_partkey AS INT)", "symbol": "'g' || CAST(p_partkey AS STRING)"}).where("place < 50"), ["g3", "g11", "g49"]),
    "count_storage": lambda s, d: count_storage(made(s, d, "lineitem", {"v": "l_quantity - l_discount"}), "v"),
    "coordinate_key": lambda s, d: coordinates(made(s, d, "part", {"row": "p_partkey", "key": "CASE p_partkey % 3 WHEN 0 THEN 'X_umap' WHEN 1 THEN 'X_centroid' ELSE 'my_Coord' END", "a": "p_retailprice", "b": "CAST(p_size AS DOUBLE)"}).withColumn("v", F.array("a", "b")), "row", "key", "v"),
    "abundance_melt": lambda s, d: melted(made(s, d, "customer", {"k": "c_custkey", "a": "c_custkey % 3", "b": "c_custkey % 4", "c": "c_custkey % 5"}), "k", ["a", "b", "c"], "kind", "n"),
    "section_cells": _section,
}
_C = f"c AS (SELECT row, \"column\", sum(count) AS count FROM {made_sql('lineitem', _CELLS)} GROUP BY 1, 2)"
SQL = {
    "decoded_categories": "SELECT o_orderkey AS row, coalesce(n_name, '') AS value FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30 - 2",
    "rows_compressed": f"WITH {_C} SELECT row, \"column\", CAST(count AS BIGINT) AS count FROM c",
    "row_pointers": f"WITH {_C} SELECT row, \"column\", CAST(count AS BIGINT) AS count FROM c",
    "dense_matrix": "SELECT * FROM (SELECT s_suppkey AS row, unnest([0, 1, 2])::INT AS \"column\", unnest([s_suppkey % 3, s_nationkey % 2, 5])::BIGINT AS count FROM supplier) WHERE count <> 0",
    "genes_read": f"WITH {_C} SELECT row, \"column\", CAST(count AS BIGINT) AS count, 'g' || \"column\" AS symbol FROM c WHERE \"column\" IN (3, 11, 49)",
    "count_storage": "SELECT count(*) AS n, true AS finite, bool_and(l_quantity - l_discount = floor(l_quantity - l_discount)) AS whole, bool_and(l_quantity - l_discount >= 0) AS not_negative FROM lineitem",
    "coordinate_key": "SELECT p_partkey AS row, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part WHERE p_partkey % 3 = 2",
    "abundance_melt": "SELECT * FROM (SELECT c_custkey AS k, unnest(['a', 'b', 'c']) AS kind, unnest([c_custkey % 3, c_custkey % 4, c_custkey % 5]) AS n FROM customer) WHERE n > 0",
    "section_cells": """WITH g AS (SELECT l_orderkey AS cell, l_linenumber % 2 = 0 AS mt, CAST(l_quantity AS BIGINT) AS c, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS s FROM lineitem), p AS (SELECT cell, any_value(s) AS s, sum(ln(1 + 1e4 * c / s)) FILTER (WHERE mt) AS ms, avg(ln(1 + 1e4 * c / s)) FILTER (WHERE mt) AS mm, sum(ln(1 + 1e4 * c / s)) FILTER (WHERE NOT mt) AS rs, avg(ln(1 + 1e4 * c / s)) FILTER (WHERE NOT mt) AS rm FROM g GROUP BY 1)
      SELECT o_orderkey AS cell, o_orderstatus AS class, CAST(coalesce(s, 0) AS BIGINT) AS total, round(coalesce(ms, 0), 6) AS mito_sum, round(coalesce(mm, 0), 6) AS mito_mean, round(coalesce(rs, 0), 6) AS ribo_sum, round(coalesce(rm, 0), 6) AS ribo_mean FROM orders LEFT JOIN p ON cell = o_orderkey WHERE o_custkey % 4 = 2""",
}
