"""Particles (place and mass): bins that conserve mass, kernels over grid cells, nearest support, label fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans import table


def bin_2d(rows: DataFrame, x: str, y: str, mass: str, width: float) -> DataFrame:
    """Mass and mass-weighted centre of each square bin; floors, so that negative places bin as others do."""
    total = F.sum(mass)
    return rows.groupBy(F.floor(F.col(x) / width).alias("bx"), F.floor(F.col(y) / width).alias("by")).agg(
        F.count("*").alias("n"), F.round(total, 6).alias("mass"), F.round(F.sum(F.col(x) * F.col(mass)) / total, 6).alias("cx"), F.round(F.sum(F.col(y) * F.col(mass)) / total, 6).alias("cy")
    )


def soft_histogram(rows: DataFrame, unit: str, value: str, bins: int) -> DataFrame:
    """Each value in [0, 1] splits linearly between its two nearest bin centres."""
    place = F.greatest(F.lit(0.0), F.least(F.col(value) * (bins - 1), F.lit(float(bins - 1))))
    low = F.least(F.floor(place), F.lit(bins - 2))
    parts = F.array(F.struct(low.alias("bin"), (1 - (place - low)).alias("mass")), F.struct((low + 1).alias("bin"), (place - low).alias("mass")))
    split = rows.select(unit, F.explode(parts).alias("s")).select(unit, "s.bin", "s.mass").where("mass > 0")
    return split.groupBy(unit, "bin").agg(F.round(F.sum("mass"), 6).alias("mass"))


def slab(rows: DataFrame, coordinates: list[str], origin: list[float], normal: list[float], thickness: float) -> DataFrame:
    """Rows at most half the thickness off a plane (inclusive)."""
    off = sum(((F.col(c) - o) * n for c, o, n in zip(coordinates, origin, normal, strict=True)), F.lit(0.0))
    return rows.where(F.abs(off) <= thickness / 2)


def kernel_sum(targets: DataFrame, sources: DataFrame, key: str, x: str, y: str, mass: str, sigma: float, reach: float = 5.0) -> DataFrame:
    """Sum of mass * exp(-d^2 / 2 sigma^2) over sources within reach sigmas: an equi-join of grid cells of that side
    with their neighbours, so no pair of far cells meets. Points of one place meet once: sources are summed by place,
    and targets take their place's sum."""
    side = reach * sigma
    cell = lambda c: F.floor(F.col(c) / side)
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    own = targets.select(key, F.col(x).alias("tx"), F.col(y).alias("ty"))
    t = targets.select(F.col(x).alias("tx"), F.col(y).alias("ty"), cell(x).alias("gx"), cell(y).alias("gy")).distinct()
    s = sources.groupBy(F.col(x).alias("sx"), F.col(y).alias("sy"), cell(x).alias("gx"), cell(y).alias("gy")).agg(F.count("*").alias("k"), F.sum(mass).alias("w"))
    t = t.withColumn("gx", around("gx")).withColumn("gy", around("gy"))
    d2 = (F.col("tx") - F.col("sx")) * (F.col("tx") - F.col("sx")) + (F.col("ty") - F.col("sy")) * (F.col("ty") - F.col("sy"))
    near = t.join(s, ["gx", "gy"]).where(d2 <= side * side)
    places = near.groupBy("tx", "ty").agg(F.sum("k").alias("n"), F.sum(F.col("w") * F.exp(-d2 / (2 * sigma * sigma))).alias("density"))
    return own.join(places, ["tx", "ty"]).groupBy(key).agg(F.sum("n").alias("n"), F.round(F.sum("density"), 6).alias("density"))


def nearest_support(queries: DataFrame, sections: DataFrame, group: str, at: str, z: str, tolerance: float) -> DataFrame:
    """For each query the nearest section of its group, ties to the lower; none beyond the tolerance. One window over
    both tables, not a join of ranges."""
    both = queries.select(group, F.col(at).alias("z"), F.lit(None).cast("double").alias("s"), F.lit(1).alias("q")).union(sections.select(group, F.col(z).alias("z"), F.col(z).alias("s"), F.lit(0).alias("q")))
    w, back = Window.partitionBy(group).orderBy("z", "q"), Window.partitionBy(group).orderBy(F.col("z").desc(), F.col("q").desc())
    before = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("b", before).withColumn("a", after).where("q = 1")
    best = F.when(F.col("a").isNull() | (F.col("z") - F.col("b") <= F.col("a") - F.col("z")), F.col("b")).otherwise(F.col("a"))
    return found.withColumn("nearest", best).select(group, F.col("z").alias(at), F.when(F.abs(F.col("nearest") - F.col("z")) <= tolerance, F.col("nearest")).alias("section"))


def bracket_interpolation(queries: DataFrame, known: DataFrame, group: str, at: str, place: str, value: str) -> DataFrame:
    """Linear between the known values before and after; beyond them the nearest one."""
    pair = F.struct(F.col(place).alias("p"), F.col(value).alias("v"))
    kind = known.select(pair.alias("k")).schema["k"].dataType
    both = queries.select(group, F.col(at).alias("z"), F.lit(None).cast(kind).alias("k"), F.lit(1).alias("q")).union(known.select(group, F.col(place).alias("z"), pair.alias("k"), F.lit(0).alias("q")))
    w, back = Window.partitionBy(group).orderBy("z", "q"), Window.partitionBy(group).orderBy(F.col("z").desc(), F.col("q").desc())
    upto = lambda x: F.last("k", True).over(x.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("b", upto(w)).withColumn("a", upto(back)).where("q = 1")
    share = (F.col("z") - F.col("b.p")) / (F.col("a.p") - F.col("b.p"))
    between = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * share
    out = F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull() | (F.col("a.p") == F.col("b.p")), F.col("b.v")).otherwise(between)
    return found.select(group, F.col("z").alias(at), F.round(out, 6).alias("value"))


def categorical_fusion(left: DataFrame, right: DataFrame, key: str, label: str, score: str, p: float) -> DataFrame:
    """Each key's label of the largest (1 - p) * left + p * right; ties by left, then right, then the lower label."""
    a = left.select(key, F.col(label).alias("label"), F.col(score).alias("l"))
    b = right.select(key, F.col(label).alias("label"), F.col(score).alias("r"))
    both = a.join(b, [key, "label"], "full").select(key, "label", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("r", F.lit(0.0)).alias("r"))
    mixed = both.withColumn("score", F.round((1 - p) * F.col("l") + p * F.col("r"), 9))
    best = mixed.groupBy(key).agg(F.max_by(F.struct("label", "score"), F.struct("score", "l", "r", -F.col("label"))).alias("b"))
    return best.select(key, "b.label", "b.score")


def dice(a: DataFrame, b: DataFrame, label: str, voxel: str) -> DataFrame:
    """2 |A and B| / max(|A| + |B|, 1) of each label."""
    marked = a.select(label, voxel, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(label, voxel, F.lit(0), F.lit(1))).groupBy(label, voxel).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return marked.groupBy(label).agg(F.round(2.0 * F.sum(F.col("a") * F.col("b")) / F.greatest(F.sum("a") + F.sum("b"), F.lit(1)), 6).alias("dice"))


def _points(s, d):
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_orderkey", (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") + 0.01).alias("m"))


def _events(s, d, odd):
    return table(s, d, "events").where(F.col("event_id") % 2 == odd).groupBy((F.col("user_id") % 40).alias("g"), F.floor(F.col("event_id") / 3).cast("double").alias("z")).agg(F.max("value").alias("v"))


def _scores(s, d, odd):
    return table(s, d, "events").where(F.col("event_id") % 2 == odd).groupBy((F.col("user_id") % 50).alias("voxel"), (F.length("event_type") % 7).alias("label")).agg(F.count("*").cast("double").alias("score"))


_P = "p AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey, l_quantity - 25 AS x, l_discount * 100 AS y, l_tax + 0.01::DOUBLE AS m FROM lineitem)"
_E = "t0 AS (SELECT user_id % 40 AS g, CAST(floor(event_id / 3) AS DOUBLE) AS z, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), t1 AS (SELECT user_id % 40 AS g, CAST(floor(event_id / 3) AS DOUBLE) AS z, max(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)"
QUERIES = {
    "bin_2d": lambda s, d: bin_2d(_points(s, d), "x", "y", "m", 3.0),
    "soft_histogram": lambda s, d: soft_histogram(_points(s, d).withColumn("f", (F.col("x") + 25) / 50), "l_orderkey", "f", 8),
    "slab_filter": lambda s, d: slab(_points(s, d), ["x", "y"], [1.0, 2.0], [0.6, 0.8], 3.0).select("id"),
    "gauss_kernel_sum": lambda s, d: kernel_sum(_points(s, d), _points(s, d), "id", "x", "y", "m", 0.7),
    "nearest_support": lambda s, d: nearest_support(_events(s, d, 0), _events(s, d, 1), "g", "z", "z", 5.0),
    "bracket_interp": lambda s, d: bracket_interpolation(_events(s, d, 0), _events(s, d, 1), "g", "z", "z", "v"),
    "categorical_fusion": lambda s, d: categorical_fusion(_scores(s, d, 0), _scores(s, d, 1), "voxel", "label", "score", 0.25),
    "dice": lambda s, d: dice(table(s, d, "lineitem").where("l_tax > 0.03").select("l_returnflag", "l_suppkey"), table(s, d, "lineitem").where("l_discount > 0.05").select("l_returnflag", "l_suppkey"), "l_returnflag", "l_suppkey"),
}
SQL = {
    "bin_2d": f"WITH {_P} SELECT CAST(floor(x / 3) AS BIGINT) AS bx, CAST(floor(y / 3) AS BIGINT) AS by, count(*) AS n, round(sum(m), 6) AS mass, round(sum(x * m) / sum(m), 6) AS cx, round(sum(y * m) / sum(m), 6) AS cy FROM p GROUP BY 1, 2",
    "soft_histogram": f"WITH {_P}, q AS (SELECT l_orderkey, greatest(0.0, least((x + 25) / 50 * 7, 7.0)) AS pl FROM p), l AS (SELECT *, least(floor(pl), 6) AS lo FROM q), s AS (SELECT l_orderkey, CAST(lo AS BIGINT) AS bin, 1 - (pl - lo) AS mass FROM l UNION ALL SELECT l_orderkey, CAST(lo + 1 AS BIGINT), pl - lo FROM l) SELECT l_orderkey, bin, round(sum(mass), 6) AS mass FROM s WHERE mass > 0 GROUP BY 1, 2",
    "slab_filter": f"WITH {_P} SELECT id FROM p WHERE abs((x - 1.0) * 0.6::DOUBLE + (y - 2.0) * 0.8::DOUBLE) <= 1.5",
    "gauss_kernel_sum": f"WITH {_P}, c AS (SELECT x, y, count(*) AS k, sum(m) AS w FROM p GROUP BY 1, 2), g AS (SELECT t.x, t.y, sum(s.k) AS n, sum(s.w * exp(-((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y)) / 0.98)) AS density FROM c t JOIN c s ON (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) <= 12.25 GROUP BY 1, 2) SELECT id, CAST(sum(n) AS BIGINT) AS n, round(sum(density), 6) AS density FROM p JOIN g ON p.x = g.x AND p.y = g.y GROUP BY 1",
    "nearest_support": f"WITH {_E}, n AS (SELECT t0.g, t0.z, t1.z AS s, row_number() OVER (PARTITION BY t0.g, t0.z ORDER BY abs(t1.z - t0.z), t1.z) AS r FROM t0 LEFT JOIN t1 ON t0.g = t1.g) SELECT g, z, CASE WHEN abs(s - z) <= 5 THEN s END AS section FROM n WHERE r = 1",
    "bracket_interp": f"WITH {_E}, b AS (SELECT t0.g, t0.z, max_by(t1.v, t1.z) FILTER (WHERE t1.z <= t0.z) AS bv, max(t1.z) FILTER (WHERE t1.z <= t0.z) AS bz, min_by(t1.v, t1.z) FILTER (WHERE t1.z > t0.z) AS av, min(t1.z) FILTER (WHERE t1.z > t0.z) AS az FROM t0 LEFT JOIN t1 ON t0.g = t1.g GROUP BY 1, 2) SELECT g, z, round(CASE WHEN bz IS NULL THEN av WHEN az IS NULL OR bz = z THEN bv ELSE bv + (av - bv) * ((z - bz) / (az - bz)) END, 6) AS value FROM b",
    "categorical_fusion": "WITH s AS (SELECT user_id % 50 AS voxel, length(event_type) % 7 AS label, CAST(count(*) FILTER (WHERE event_id % 2 = 0) AS DOUBLE) AS l, CAST(count(*) FILTER (WHERE event_id % 2 = 1) AS DOUBLE) AS r FROM events GROUP BY 1, 2), x AS (SELECT *, round(0.75 * l + 0.25 * r, 9) AS score FROM s) SELECT voxel, label, score FROM (SELECT *, row_number() OVER (PARTITION BY voxel ORDER BY score DESC, l DESC, r DESC, label) AS k FROM x) WHERE k = 1",
    "dice": "WITH v AS (SELECT l_returnflag, l_suppkey, max((l_tax > 0.03)::INT) AS a, max((l_discount > 0.05)::INT) AS b FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(2.0 * sum(a * b) / greatest(sum(a) + sum(b), 1), 6) AS dice FROM v WHERE a + b > 0 GROUP BY 1",
}
