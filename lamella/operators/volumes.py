"""Volumes and images in long form: blocks, weighted means, intensities, entropy, support and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans import table


def block_masses(voxels: DataFrame, axes: list[str], factor: int, mass: str, intensity: str) -> DataFrame:
    """Voxels gathered in cubes of factor: their mass, their mass-weighted intensity (null without mass) and the
    mass-weighted centre along each axis. Indexes are floored, so negative ones fall into the right block."""
    keys = [F.floor(F.col(a) / F.lit(float(factor))).cast("long").alias(f"block_{a}") for a in axes]
    total = F.sum(mass)

    def weighted(c: str) -> Column:
        return F.round(F.when(total > 0, F.sum(F.col(c) * F.col(mass)) / total), 6)

    return voxels.groupBy(*keys).agg(F.round(total, 6).alias("mass"), weighted(intensity).alias("intensity"), *(weighted(a).alias(f"centre_{a}") for a in axes))


def supported(numerator: Column, support: Column, threshold: float = 0.0) -> Column:
    """numerator over support, held to 0..1 first, where the support is above 0 and reaches the threshold; else 0."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), support))
    return F.when((held > 0) & (held >= threshold), numerator / held).otherwise(0.0)


def optical_density(intensity: Column, white: Column) -> Column:
    return -F.ln(F.greatest(F.lit(1e-3), F.least(F.lit(1.0), intensity / white)))


def scaled_intensity(rows: DataFrame, group: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """rows with value brought to 0..1 between two quantiles of its group and clipped; an error in a constant group.

    The quantiles are exact; they are aggregated once a group, and rows meet them by a join."""
    edges = rows.groupBy(group).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"))
    edges = edges.select(group, F.col("q")[0].alias("_low"), F.col("q")[1].alias("_high"))
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(F.raise_error(F.lit("a group's values are constant")).cast("double"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("_low")) / span))
    return rows.join(edges, group).withColumn("scaled", F.round(scaled, 6)).drop("_low", "_high")


def entropy(rows: DataFrame, unit: str, part: str, amount: str) -> DataFrame:
    """Natural-log entropy of each unit's shares; parts of 0 add nothing, units without amount are left out."""
    sums = rows.groupBy(unit, part).agg(F.sum(amount).cast("double").alias("x")).where("x > 0")
    share = F.col("x") / F.sum("x").over(Window.partitionBy(unit))
    terms = sums.select(unit, (share * F.ln(share)).alias("t"))
    return terms.groupBy(unit).agg(F.count("*").alias("parts"), F.round(-F.sum("t"), 6).alias("entropy"))


def mutual_information(rows: DataFrame, group: str, x: str, y: str, bins: int, least: int = 64) -> DataFrame:
    """2 I(x, y) / (H(x) + H(y)) of each group over equal bins between the extremes of each; null below ``least`` rows
    or where a side is constant. At most bins * bins counts a group are left after the first aggregation."""
    edges = rows.groupBy(group).agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def cell(v: str, a: str, b: str) -> Column:
        return F.least(F.lit(bins - 1), F.floor((F.col(v) - F.col(a)) * bins / (F.col(b) - F.col(a)))).cast("int")

    usable = edges.where((F.col("n") >= least) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    joint = rows.join(usable, group).groupBy(group, "n", cell(x, "x0", "x1").alias("i"), cell(y, "y0", "y1").alias("j")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    px = F.sum("c").over(Window.partitionBy(group, "i")) / F.col("n")
    py = F.sum("c").over(Window.partitionBy(group, "j")) / F.col("n")
    # H(x) = -sum p ln px over joint cells, as the cells of a row sum to px
    out = joint.select(group, (p * F.ln(p / (px * py))).alias("i"), (-p * F.ln(px)).alias("hx"), (-p * F.ln(py)).alias("hy")).groupBy(group).agg((2 * F.sum("i") / (F.sum("hx") + F.sum("hy"))).alias("nmi"))
    return edges.select(group, "n").join(out, group, "left").select(group, "n", F.round("nmi", 6).alias("nmi"))


def gap_histogram(sections: DataFrame, group: str, index: str) -> DataFrame:
    """How often each gap between consecutive distinct sections of a group comes."""
    present = sections.select(group, index).distinct()
    gap = F.lead(index).over(Window.partitionBy(group).orderBy(index)) - F.col(index)
    return present.select(group, gap.alias("gap")).where("gap IS NOT NULL").groupBy(group, "gap").agg(F.count("*").alias("times"))


def pair_channels(anchors: DataFrame, group: str, place: str, label: str) -> DataFrame:
    """For each two consecutive places of a group, the labels of either: whether the left and the right one have it."""
    present = anchors.select(group, place, label).distinct()
    places = present.select(group, place).distinct().withColumn("next", F.lead(place).over(Window.partitionBy(group).orderBy(place))).where("next IS NOT NULL")
    left = places.join(present, [group, place]).select(group, place, "next", label, F.lit(1).alias("l"), F.lit(0).alias("r"))
    right = places.join(present.withColumnRenamed(place, "next"), [group, "next"]).select(group, place, "next", label, F.lit(0).alias("l"), F.lit(1).alias("r"))
    return left.union(right).groupBy(group, place, "next", label).agg(F.max("l").alias("on_left"), F.max("r").alias("on_right"))


def pseudotimes(steps: DataFrame, group: str, z: str) -> DataFrame:
    """(z - first) / (last - first) at the distinct places between the ends of each group."""
    w = Window.partitionBy(group)
    s = (F.col(z) - F.min(z).over(w)) / (F.max(z).over(w) - F.min(z).over(w))
    return steps.select(group, z).distinct().select(group, z, s.alias("s")).where("s > 0 AND s < 1").withColumn("s", F.round("s", 9))


def memory_fit(pilots: DataFrame, group: str, score: str, peak: str, margin: float = 1.15) -> DataFrame:
    """The line of peak on score by group, its largest residual above it (0 at least) and the margin that estimates are
    multiplied by; nulls below three different scores."""
    line = pilots.groupBy(group).agg(F.countDistinct(score).alias("scores"), F.regr_slope(peak, score).alias("slope"), F.regr_intercept(peak, score).alias("start"))
    above = pilots.join(line, group).groupBy(group, "scores", "slope", "start").agg(F.greatest(F.lit(0.0), F.max(F.col(peak) - F.col("start") - F.col("slope") * F.col(score))).alias("above"))
    known = lambda c: F.round(F.when(F.col("scores") >= 3, F.col(c)), 4).alias(c)
    return above.select(group, "scores", known("slope"), known("start"), known("above"), F.lit(margin).alias("margin"))


def _voxels(s, d):
    return table(s, d, "lineitem").select((F.col("l_linenumber") - 4).alias("i"), F.col("l_quantity").alias("j"), F.round(F.col("l_tax") * 100).alias("mass"), F.col("l_extendedprice").alias("v"))


def _supported(s, d):
    value = supported(F.col("l_extendedprice"), F.col("l_discount") * 12, 0.24)
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(value), 4).alias("total"), F.round(F.sum(optical_density(F.col("l_extendedprice"), F.lit(90000.0))), 4).alias("density"))


def _days(s, d):
    return table(s, d, "events").select("event_type", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "user_id")


QUERIES = {
    "block_masses": lambda s, d: block_masses(_voxels(s, d), ["i", "j"], 5, "mass", "v"),
    "supported_image": _supported,
    "scaled_intensity": lambda s, d: scaled_intensity(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice"),
    "composition_entropy": lambda s, d: entropy(table(s, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity"),
    "mutual_information": lambda s, d: mutual_information(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", 64),
    "section_gaps": lambda s, d: gap_histogram(_days(s, d), "user_id", "day"),
    "pair_channels": lambda s, d: pair_channels(_days(s, d).withColumn("label", F.col("event_type")), "user_id", "day", "label"),
    "pseudotime": lambda s, d: pseudotimes(_days(s, d), "user_id", "day"),
    "memory_fit": lambda s, d: memory_fit(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"),
}
SQL = {
    "block_masses": """
WITH v AS (SELECT l_linenumber - 4 AS i, l_quantity AS j, round(l_tax * 100) AS m, l_extendedprice AS v FROM lineitem)
SELECT floor(i / 5.0)::BIGINT AS block_i, floor(j / 5.0)::BIGINT AS block_j, round(sum(m), 6) AS mass, round(sum(v * m) / nullif(sum(m), 0), 6) AS intensity,
  round(sum(i * m) / nullif(sum(m), 0), 6) AS centre_i, round(sum(j * m) / nullif(sum(m), 0), 6) AS centre_j FROM v GROUP BY 1, 2
""",
    "supported_image": """
SELECT l_suppkey, round(sum(CASE WHEN least(1.0, l_discount * 12) >= 0.24 AND l_discount > 0 THEN l_extendedprice / least(1.0, l_discount * 12) ELSE 0 END), 4) AS total,
  round(sum(-ln(greatest(0.001, least(1.0, l_extendedprice / 90000.0)))), 4) AS density FROM lineitem GROUP BY l_suppkey
""",
    "scaled_intensity": """
WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders GROUP BY 1)
SELECT o_orderpriority, o_orderkey, o_totalprice, round(greatest(0.0, least(1.0, (o_totalprice - a) / (b - a))), 6) AS scaled FROM orders JOIN q ON p = o_orderpriority
""",
    "composition_entropy": """
SELECT l_suppkey, count(*) AS parts, round(-sum(x / t * ln(x / t)), 6) AS entropy FROM (
  SELECT l_suppkey, x, sum(x) OVER (PARTITION BY l_suppkey) AS t FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS x FROM lineitem GROUP BY 1, 2) WHERE x > 0) GROUP BY l_suppkey
""",
    "mutual_information": """
WITH e AS (SELECT l_returnflag AS g, count(*) AS n, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1),
j AS (SELECT g, n, least(63, floor((l_quantity - x0) * 64 / (x1 - x0))) AS i, least(63, floor((l_extendedprice - y0) * 64 / (y1 - y0))) AS j, count(*) AS c
  FROM lineitem JOIN e ON g = l_returnflag WHERE n >= 64 AND x1 > x0 AND y1 > y0 GROUP BY ALL),
p AS (SELECT g, c / n AS p, sum(c) OVER (PARTITION BY g, i) / n AS px, sum(c) OVER (PARTITION BY g, j) / n AS py FROM j),
o AS (SELECT g, 2 * sum(p * ln(p / (px * py))) / (sum(-p * ln(px)) + sum(-p * ln(py))) AS nmi FROM p GROUP BY g)
SELECT e.g AS l_returnflag, n, round(nmi, 6) AS nmi FROM e LEFT JOIN o ON e.g = o.g
""",
    "section_gaps": """
SELECT user_id, gap, count(*) AS times FROM (
  SELECT user_id, lead(day) OVER (PARTITION BY user_id ORDER BY day) - day AS gap FROM (SELECT DISTINCT user_id, ts::DATE - DATE '2024-01-01' AS day FROM events)) WHERE gap IS NOT NULL GROUP BY 1, 2
""",
    "pair_channels": """
WITH a AS (SELECT DISTINCT user_id, ts::DATE - DATE '2024-01-01' AS day, event_type AS label FROM events),
p AS (SELECT * FROM (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next FROM (SELECT DISTINCT user_id, day FROM a)) WHERE next IS NOT NULL)
SELECT p.user_id, p.day, p.next, a.label, max((a.day = p.day)::INT) AS on_left, max((a.day = p.next)::INT) AS on_right
FROM p JOIN a ON a.user_id = p.user_id AND a.day IN (p.day, p.next) GROUP BY 1, 2, 3, 4
""",
    "pseudotime": """
WITH a AS (SELECT DISTINCT user_id, ts::DATE - DATE '2024-01-01' AS day FROM events)
SELECT user_id, day, round(s, 9) AS s FROM (SELECT user_id, day, (day - min(day) OVER w) / (max(day) OVER w - min(day) OVER w) AS s FROM a WINDOW w AS (PARTITION BY user_id)) WHERE s > 0 AND s < 1
""",
    "memory_fit": """
WITH l AS (SELECT l_returnflag AS g, count(DISTINCT l_quantity) AS scores, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS start FROM lineitem GROUP BY 1)
SELECT g AS l_returnflag, scores, round(slope, 4) AS slope, round(start, 4) AS start, round(greatest(0, max(l_extendedprice - start - slope * l_quantity)), 4) AS above, 1.15::DOUBLE AS margin
FROM lineitem JOIN l ON g = l_returnflag GROUP BY g, scores, slope, start
""",
}
