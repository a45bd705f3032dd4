"""Placing one measure on another: candidates by correlation of rasters for each turn, scale and flip, and policies that
take out the offsets of methods. A candidate is a row; rasters are bounded by their grid, and go to every task."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.plans import made, made_sql


def raster_masses(rows: DataFrame, x: str, y: str, feature: str, mass: str, origin: tuple[float, float], step: float, shape: tuple[int, int]) -> DataFrame:
    """(feature, row, column, mass): masses summed on a grid, places outside dropped."""
    column, row = (F.floor((F.col(c) - o) / step) for c, o in ((x, origin[0]), (y, origin[1])))
    at = rows.select(feature, row.alias("row"), column.alias("column"), mass).where((F.col("row") >= 0) & (F.col("row") < shape[0]) & (F.col("column") >= 0) & (F.col("column") < shape[1]))
    return at.groupBy(feature, "row", "column").agg(F.sum(mass).alias(mass))


def blurred(grid: np.ndarray, sigma: float) -> np.ndarray:
    """grid (features, rows, columns) under a Gaussian of sigma cells, by its transform."""
    fy, fx = np.fft.fftfreq(grid.shape[1])[:, None], np.fft.rfftfreq(grid.shape[2])[None, :]
    return np.fft.irfft2(np.fft.rfft2(grid) * np.exp(-2 * (math.pi * sigma) ** 2 * (fy**2 + fx**2)), grid.shape[1:])


def shift_candidates(moving: DataFrame, fixed: DataFrame, features: Sequence[str], angles: Sequence[float], scales: Sequence[float], flips: Sequence[bool], step: float, side: int, blur: float, keep: int = 3) -> DataFrame:
    """(angle, scale, flip, dx, dy, score): for each turn, scale and flip of the moving measure the `keep` best shifts onto
    the fixed one, by the cross-correlation of blurred rasters, over their norms. Measures: (x, y, feature, m).

    The rasters are features x side x side cells, whatever the measures' sizes; moving places are summed to cells of a
    quarter of the step first."""
    place = {f: i for i, f in enumerate(features)}
    half = side * step / 2

    def cells(rows: DataFrame, width: float) -> np.ndarray:
        summed = rows.groupBy("feature", F.floor(F.col("x") / width).alias("i"), F.floor(F.col("y") / width).alias("j")).agg(F.sum("m").alias("m"))
        found = summed.where((F.abs((F.col("i") + 0.5) * width) < half) & (F.abs((F.col("j") + 0.5) * width) < half)).toPandas()  # the raster's cells
        return np.column_stack([found["feature"].map(place).to_numpy(float), (found["i"] + 0.5) * width, (found["j"] + 0.5) * width, found["m"]]) if len(found) else np.zeros((0, 4))

    def grid(points: np.ndarray, xy: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), side, side))
        at = np.floor((xy + half) / step).astype(int)
        ok = ((at >= 0) & (at < side)).all(axis=1)
        np.add.at(out, (points[ok, 0].astype(int), at[ok, 1], at[ok, 0]), points[ok, 3])
        return blurred(out, blur / step)

    spark = moving.sparkSession
    target, own = cells(fixed, step / 4), cells(moving, step / 4)
    shared = spark.sparkContext.broadcast((np.fft.rfft2(grid(target, target[:, 1:3])), float(np.sqrt((grid(target, target[:, 1:3]) ** 2).sum())), own))

    def each(frames):
        wave, norm, points = shared.value
        for frame in frames:
            rows = []
            for angle, scale, flip in zip(frame["angle"], frame["scale"], frame["flip"], strict=True):
                t = math.radians(angle)
                xy = points[:, 1:3] * [-1.0 if flip else 1.0, 1.0] * scale @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
                image = grid(points, xy)
                size = float(np.sqrt((image**2).sum())) * norm
                score = np.fft.irfft2((wave * np.conj(np.fft.rfft2(image))).sum(axis=0), (side, side)) / max(size, 1e-300)
                for at in np.argsort(-score.ravel(), kind="stable")[:keep]:
                    dy, dx = ((int(v) + side // 2) % side - side // 2 for v in divmod(int(at), side))
                    rows.append((angle, scale, flip, dx * step, dy * step, float(score.ravel()[at])))
            yield pd.DataFrame(rows, columns=["angle", "scale", "flip", "dx", "dy", "score"])

    ways = spark.createDataFrame(list(itertools.product(map(float, angles), map(float, scales), map(bool, flips))), "angle double, scale double, flip boolean")
    return ways.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(each, "angle double, scale double, flip boolean, dx double, dy double, score double")


def adjusted_means(rows: DataFrame, keys: list[str], method: str, value: str, weight: str, offsets: DataFrame, offset: str) -> DataFrame:
    """(keys, n, methods, equal_mean, weighted_mean, adjusted_mean, adjusted_weighted_mean, spread): means with and without
    the offsets of methods (0 for a method without one) taken out; weighted ones are null without weight, and the spread
    of a single row is null."""
    own = rows.join(offsets.select(method, F.col(offset).alias("_o")), method, "left").withColumn("_a", F.col(value) - F.coalesce("_o", F.lit(0.0)))
    total = F.sum(weight)
    weighted = lambda c: F.round(F.when(total > 0, F.sum(F.col(c) * F.col(weight)) / total), 6)
    return own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(method)), ";").alias("methods"), F.round(F.avg(value), 6).alias("equal_mean"), weighted(value).alias("weighted_mean"),
        F.round(F.avg("_a"), 6).alias("adjusted_mean"), weighted("_a").alias("adjusted_weighted_mean"), F.round(F.when(F.count("*") > 1, F.max(value) - F.min(value)), 6).alias("spread"),
    )


_GRID = {"f": "l_returnflag", "x": "l_quantity - 25.0", "y": "l_discount * 400 - 20.5", "m": "l_tax + 0.01"}
_VALUES = {"k": "l_suppkey", "p": "l_linenumber", "method": "l_returnflag", "v": "l_extendedprice / 1000", "w": "CASE l_linenumber WHEN 7 THEN 0.0 ELSE l_quantity END"}


def _adjusted(s, d):
    offsets = made(s, d, "lineitem", {"method": "l_returnflag", "v": "l_extendedprice / 1000"}).where("method <> 'R'").groupBy("method").agg(F.avg("v").alias("o"))
    return adjusted_means(made(s, d, "lineitem", _VALUES), ["k", "p"], "method", "v", "w", offsets, "o")


QUERIES = {
    "raster_masses": lambda s, d: raster_masses(made(s, d, "lineitem", _GRID), "x", "y", "f", "m", (-20.0, -18.0), 2.5, (12, 14)).withColumn("m", F.round("m", 6)),
    "adjusted_means": _adjusted,
}
SQL = {
    "raster_masses": f"WITH g AS (SELECT f, CAST(floor((y + 18.0) / 2.5) AS BIGINT) AS r, CAST(floor((x + 20.0) / 2.5) AS BIGINT) AS c, m FROM {made_sql('lineitem', _GRID)}) SELECT f, r AS row, c AS \"column\", round(sum(m), 6) AS m FROM g WHERE r BETWEEN 0 AND 11 AND c BETWEEN 0 AND 13 GROUP BY 1, 2, 3",
    "adjusted_means": f"""WITH o AS (SELECT l_returnflag AS method, avg(l_extendedprice / 1000) AS o FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), a AS (SELECT r.*, v - coalesce(o, 0) AS a FROM {made_sql('lineitem', _VALUES)} r LEFT JOIN o ON o.method = r.method)
      SELECT k, p, count(*) AS n, string_agg(DISTINCT method, ';' ORDER BY method) AS methods, round(avg(v), 6) AS equal_mean, round(CASE WHEN sum(w) > 0 THEN sum(v * w) / sum(w) END, 6) AS weighted_mean, round(avg(a), 6) AS adjusted_mean, round(CASE WHEN sum(w) > 0 THEN sum(a * w) / sum(w) END, 6) AS adjusted_weighted_mean, round(CASE WHEN count(*) > 1 THEN max(v) - min(v) END, 6) AS spread FROM a GROUP BY 1, 2""",
}
