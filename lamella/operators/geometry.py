"""Places and shapes: transforms, planes, nearest neighbours by grid cells, rings and their rasters, measures and their
distances. Everything that meets by nearness meets by an equi-join of grid cells."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans import made, made_sql
from lamella.plans.prefix import BROADCAST_ROWS, kept

Matrix = tuple[tuple[float, ...], ...]
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def identity(n: int = 3) -> Matrix:
    return tuple(tuple(float(i == j) for j in range(n)) for i in range(n))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(x * y for x, y in zip(row, column, strict=True)) for column in zip(*b, strict=True)) for row in a)


def drawing_transform(text: str | None) -> Matrix:
    """The 3 x 3 matrix of a drawing's transform list, first one outermost. Anything that isn't of its grammar fails."""
    out, rest = identity(), (text or "").strip()
    while rest:
        found = re.match(rf"(matrix|translate|scale|rotate|skewX|skewY)\s*\(\s*((?:{NUMBER}[\s,]*)*)\)[\s,]*", rest)
        if not found:
            raise ValueError(f"not a transform: {rest!r}")
        out = product(out, _one_transform(found[1], [float(x) for x in re.findall(NUMBER, found[2])]))
        rest = rest[found.end() :]
    return out


def _one_transform(name: str, n: list[float]) -> Matrix:
    turned = lambda angle: ((math.cos(angle), -math.sin(angle), 0.0), (math.sin(angle), math.cos(angle), 0.0), (0.0, 0.0, 1.0))
    moved = lambda x, y: ((1.0, 0.0, x), (0.0, 1.0, y), (0.0, 0.0, 1.0))
    match name, len(n):
        case "matrix", 6:
            return ((n[0], n[2], n[4]), (n[1], n[3], n[5]), (0.0, 0.0, 1.0))
        case "translate", 1 | 2:
            return moved(n[0], n[1] if len(n) > 1 else 0.0)
        case "scale", 1 | 2:
            return ((n[0], 0.0, 0.0), (0.0, n[-1], 0.0), (0.0, 0.0, 1.0))
        case "rotate", 1:
            return turned(math.radians(n[0]))
        case "rotate", 3:
            return product(product(moved(n[1], n[2]), turned(math.radians(n[0]))), moved(-n[1], -n[2]))
        case "skewX", 1:
            return ((1.0, math.tan(math.radians(n[0])), 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
        case "skewY", 1:
            return ((1.0, 0.0, 0.0), (math.tan(math.radians(n[0])), 1.0, 0.0), (0.0, 0.0, 1.0))
    raise ValueError(f"{name} with {len(n)} numbers")


class Frames:
    """Transforms between named frames; only those whose frames meet combine."""

    def __init__(self, matrix: Matrix, source: str, target: str):
        self.matrix, self.source, self.target = matrix, source, target

    def then(self, other: Frames) -> Frames:
        if other.source != self.target:
            raise ValueError(f"{self.target} isn't {other.source}")
        return Frames(product(other.matrix, self.matrix), self.source, other.target)

    def inverse(self) -> Frames:
        (a, b, x), (c, d, y), _ = self.matrix
        size = a * d - b * c
        if abs(size) < 1e-12:
            raise ValueError("no inverse")
        return Frames(((d / size, -b / size, (b * y - d * x) / size), (-c / size, a / size, (c * x - a * y) / size), (0.0, 0.0, 1.0)), self.target, self.source)


def transformed(rows: DataFrame, axes: Sequence[str], matrix: Matrix) -> DataFrame:
    """rows with their places mapped by a matrix in homogeneous coordinates (the last column moves)."""
    at = [*(F.col(a) for a in axes), F.lit(1.0)]
    return rows.withColumns({a: sum((F.lit(float(m)) * c for m, c in zip(row, at, strict=True)), F.lit(0.0)) for a, row in zip(axes, matrix, strict=False)})


def centred_places(rows: DataFrame, axes: Sequence[str], scale: float, centre: str = "none") -> tuple[DataFrame, DataFrame]:
    """(rows scaled and centred, a row of counts): scale above 0; rows with a place that is no finite number go; the
    centre is none, the mean, or that of the bounding box."""
    if scale <= 0 or centre not in ("none", "mean", "box"):
        raise ValueError("scale must be above 0, and the centre none, mean or box")
    ok = F.lit(True)
    for a in axes:
        ok &= F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(F.col(a).cast("double")) < float("inf"))
    kept = rows.where(ok).withColumns({a: F.col(a) * scale for a in axes})
    counts = rows.agg(F.count("*").alias("rows"), F.count(F.when(ok, 1)).alias("kept"))
    if centre == "none":
        return kept, counts
    of = (lambda a: F.avg(a)) if centre == "mean" else (lambda a: (F.min(a) + F.max(a)) / 2)
    middle = kept.agg(*(of(a).alias(f"_c_{a}") for a in axes))  # one row
    return kept.crossJoin(middle).withColumns({a: F.col(a) - F.col(f"_c_{a}") for a in axes}).drop(*(f"_c_{a}" for a in axes)), counts


def plane_basis(pitch: float, yaw: float) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """(u, v, n): the axes x and z of an upright plane after a turn about x by pitch and then about z by yaw, and u x v."""
    p, y = math.radians(pitch), math.radians(yaw)
    u = (math.cos(y), math.sin(y), 0.0)
    v = (math.sin(y) * math.sin(p), -math.cos(y) * math.sin(p), math.cos(p))
    return u, v, (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def lattice_z(index: Column, spacing: float, count: Column | int) -> Column:
    """The place of a slot, so that the middle of all slots is 0."""
    return (index - (F.lit(count) - 1) / 2) * spacing


def slab_sides(rows: DataFrame, axes: Sequence[str], origin: Sequence[float], u: Sequence[float], v: Sequence[float], thickness: float, mass: str, side: str | None = None) -> DataFrame:
    """rows within half a thickness of the plane through origin, with their place (a, b) in it and their mass per
    thickness; side keeps x below ('left') or above ('right') 0. u and v must be orthonormal."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    if max(abs(dot(u, u) - 1), abs(dot(v, v) - 1), abs(dot(u, v))) > 1e-9:
        raise ValueError("u and v aren't orthonormal")
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    along = lambda w: sum(((F.col(a) - o) * x for a, o, x in zip(axes, origin, w, strict=True)), F.lit(0.0))
    kept = rows.where(F.abs(along(n)) <= thickness / 2)
    if side:
        kept = kept.where(F.col(axes[0]) < 0 if side == "left" else F.col(axes[0]) > 0)
    return kept.withColumn("a", along(u)).withColumn("b", along(v)).withColumn(mass, F.col(mass) / thickness)


def masked(rows: DataFrame, value: str, mode: str, threshold: float = 0.0, outside: str | None = None) -> DataFrame:
    """rows that a mask keeps: finite, nonzero, positive, or above a threshold, and where given a true column besides.
    An empty mask fails."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rule = {"finite": finite, "nonzero": finite & (v != 0), "positive": finite & (v > 0), "threshold": finite & (v > threshold)}[mode]
    own = rows.where(rule if outside is None else rule & F.col(outside))
    if own.isEmpty():
        raise ValueError("the mask is empty")
    return own


def transformed_intensity(rows: DataFrame, group: str, value: str, mode: str = "robust", low: float = 0.0, high: float = 255.0) -> DataFrame:
    """rows with value brought to 0..1 and clipped: between the 1 % and 99 % quantiles of the group ('robust'), between
    its extremes ('minmax'), between two given values ('fixed'), or of whole bytes ('bytes'). A constant group fails."""
    edges = {
        "robust": (F.percentile(value, F.lit(0.01)), F.percentile(value, F.lit(0.99))), "minmax": (F.min(value), F.max(value)),
        "fixed": (F.first(F.lit(low)), F.first(F.lit(high))), "bytes": (F.first(F.lit(0.0)), F.first(F.lit(255.0))),
    }[mode]
    ends = rows.groupBy(group).agg(edges[0].cast("double").alias("_a"), edges[1].cast("double").alias("_b"))
    span = F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a")).otherwise(F.raise_error(F.lit("a group's values are constant")).cast("double"))
    at = F.rint(value) if mode == "bytes" else F.col(value)
    return rows.join(ends, group).withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - F.col("_a")) / span))).drop("_a", "_b")


def density_by_channel(rows: DataFrame, channel: str, value: str, white: float = 0.995) -> DataFrame:
    """rows with -ln of value over the channel's white level (a high quantile), held to 0.001..1."""
    level = rows.groupBy(channel).agg(F.percentile(value, F.lit(white)).alias("_w"))
    return rows.join(level, channel).withColumn("density", 0.0 - F.ln(F.greatest(F.lit(1e-3), F.least(F.lit(1.0), F.col(value) / F.col("_w"))))).drop("_w")


def cells_around(*axes: str) -> dict[str, Column]:
    return {a: F.explode(F.sequence(F.col(a) - 1, F.col(a) + 1)) for a in axes}


def neighbours(queries: DataFrame, points: DataFrame, query: str, point: str, axes: Sequence[str], k: int, radius: float, by: Sequence[str] = (), beside: Sequence[str] = ()) -> DataFrame:
    """(query, rank, point, distance, the point's columns `beside`): up to k nearest points within radius (ties: the
    smaller point), of equal `by` columns. Cells have the radius as side, so a query meets the points of its own and the
    neighbouring cells only.

    Equal places are one: queries of a place have the same neighbours, and of the points of a place only the k smallest
    can be among the k nearest. So places meet places, and ranks are cut before any query is listed. Rows of one query
    are ranked as one, rows of one point count each."""
    cell = lambda a: F.floor(F.col(a) / radius)
    qa, pa = [f"_q{i}" for i in range(len(axes))], [f"_p{i}" for i in range(len(axes))]
    place = lambda rows, own, names: rows.select(*own, *by, *(F.col(a).alias(n) for a, n in zip(axes, names, strict=True)))
    asked = place(queries, [query], qa)
    q = asked.select(*by, *qa).distinct().withColumns({f"_g{i}": cell(a) for i, a in enumerate(qa)})
    for i in range(len(axes)):
        q = q.withColumns(cells_around(f"_g{i}"))
    own = Window.partitionBy(*by, *pa).orderBy(point)
    p = place(points, [point, *beside], pa).withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= k).drop("_k").withColumns({f"_g{i}": cell(a) for i, a in enumerate(pa)})
    d2 = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(qa, pa, strict=True)), F.lit(0.0))
    near = q.join(p, [*by, *(f"_g{i}" for i in range(len(axes)))]).withColumn("_d", F.sqrt(d2)).where(F.col("_d") <= radius)
    order = Window.partitionBy(*by, *qa).orderBy("_d", point)
    found = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, *qa, "rank", point, "_d", *beside)
    listed = asked.join(found, [*by, *qa])
    if not asked.groupBy(query).count().where("count > 1").isEmpty():
        listed = listed.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_d", point))).where(F.col("rank") <= k)
    return listed.select(query, "rank", point, F.col("_d").alias("distance"), *beside)


def reconstructed(grid: DataFrame, points: DataFrame, node: str, point: str, axes: Sequence[str], mass: str, moment: str, sigma: float = 0.25, k: int = 8, radius: float | None = None, least: float = 1e-8) -> DataFrame:
    """(node, value, weight, support): at each node of a grid the kernel-weighted mean moment / mass of its k nearest
    points; 0 without support, that is without weight above the least."""
    found = neighbours(grid, points, node, point, axes, k, radius or 4 * sigma, beside=[mass, moment])
    kernel = F.exp(-0.5 * (F.col("distance") / sigma) ** 2)
    sums = found.groupBy(node).agg(F.sum(kernel * F.col(mass)).alias("_m"), F.sum(kernel * F.col(moment)).alias("_q"))
    some = F.coalesce(F.col("_m") > least, F.lit(False))
    return grid.select(node).join(sums, node, "left").select(node, F.when(some, F.col("_q") / F.col("_m")).otherwise(0.0).alias("value"), F.coalesce("_m", F.lit(0.0)).alias("weight"), some.cast("int").alias("support"))


def reconstructed_labels(grid: DataFrame, points: DataFrame, masses: DataFrame, node: str, point: str, axes: Sequence[str], label: str, mass: str, sigma: float = 0.25, k: int = 8, radius: float | None = None, least: float = 1e-8) -> DataFrame:
    """(node, label): at each node the label of the largest kernel-weighted mass (ties: the smallest), 0 without support.
    masses: (point, label, mass)."""
    found = neighbours(grid, points, node, point, axes, k, radius or 4 * sigma).join(masses, point)
    per = found.groupBy(node, label).agg(F.sum(F.exp(-0.5 * (F.col("distance") / sigma) ** 2) * F.col(mass)).alias("_m"))
    best = per.groupBy(node).agg(F.max(F.struct(F.round("_m", 12), -F.col(label))).alias("_b"), F.sum("_m").alias("_t"))
    return grid.select(node).join(best, node, "left").select(node, F.when(F.col("_t") > least, -F.col("_b").getField("col2")).otherwise(0).alias("label"))


def grouped_features(rows: DataFrame, labels: str, mass: str, groups: dict[str, Sequence[str]], drop: Sequence[str] = ()) -> DataFrame:
    """rows with each label's group instead of the label. A label in no group or in two fails, and so does one that a
    group names and no row has."""
    pairs = [(m, g) for g, members in groups.items() for m in members]
    if len({m for m, _ in pairs}) < len(pairs):
        raise ValueError("a label is in two groups")
    there = {r[0] for r in rows.select(labels).distinct().limit(10_000).collect()}  # the labels of one feature set
    if unknown := sorted({m for m, _ in pairs} - there):
        raise KeyError(f"no row has {unknown}")
    if lost := sorted(there - {m for m, _ in pairs} - set(drop)):
        raise ValueError(f"in no group: {lost}")
    mapped = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    return rows.withColumn(labels, F.try_element_at(mapped, F.col(labels))).where(F.col(labels).isNotNull())


def area_masses(pixels: DataFrame, x: str, y: str, label: str, classes: dict[str, Sequence[int]], spacing: float, factor: int, side: int) -> DataFrame:
    """(a, b, one column for each class): the area of each class in blocks of factor x factor pixels, at the blocks'
    centres; blocks beyond the last whole one and blocks without any class go."""
    whole = side // factor * factor
    block = lambda c: F.floor(F.col(c) / factor)
    area = {n: F.count(F.when(F.col(label).isin(*members), 1)) * F.lit(spacing * spacing) for n, members in classes.items()}
    centre = lambda c: ((F.col(c) * factor) + (factor - 1) / 2) * spacing
    sums = pixels.where((F.col(x) < whole) & (F.col(y) < whole)).groupBy(block(x).alias("_x"), block(y).alias("_y")).agg(*(F.round(e, 9).alias(n) for n, e in area.items()))
    return sums.where(sum((F.col(n) for n in classes), F.lit(0.0)) > 0).select(F.round(centre("_x"), 9).alias("a"), F.round(centre("_y"), 9).alias("b"), *classes)


def inner_products(a: DataFrame, b: DataFrame, axes: Sequence[str], feature: str, mass: str, sigmas: Sequence[float], reach: float = 6.0) -> DataFrame:
    """A row with, for each sigma, the sum over pairs of exp(-d^2 / 2 sigma^2) times the product of their masses of the
    same feature. Masses of one place and feature are summed first; the kernel beyond reach sigmas is below 2e-8."""
    side = reach * max(sigmas)
    cell = lambda c: F.floor(F.col(c) / side)
    place = lambda rows, n: rows.groupBy(F.col(feature).alias("_f"), *(F.col(c).alias(f"_{n}{i}") for i, c in enumerate(axes)), *(cell(c).alias(f"_g{i}") for i, c in enumerate(axes))).agg(F.sum(mass).alias(f"_{n}m"))
    left, right = place(a, "a"), place(b, "b")
    for i in range(len(axes)):
        left = left.withColumns(cells_around(f"_g{i}"))
    d2 = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) ** 2 for i in range(len(axes))), F.lit(0.0))
    pairs = left.join(right, ["_f", *(f"_g{i}" for i in range(len(axes)))]).select(d2.alias("_d2"), (F.col("_am") * F.col("_bm")).alias("_w"))
    return pairs.agg(*(F.coalesce(F.sum(F.when(F.col("_d2") <= (reach * s) ** 2, F.col("_w") * F.exp(-F.col("_d2") / (2 * s * s)))), F.lit(0.0)).alias(f"s{i}") for i, s in enumerate(sigmas)))


def varifold_distance(a: DataFrame, b: DataFrame, axes: Sequence[str], feature: str, mass: str, sigmas: Sequence[float] = (2.0, 1.0, 0.5)) -> DataFrame:
    """(score): the mean over sigmas of |a - b|^2 / |b|^2 of two measures, 0 for equal ones."""
    named = lambda x, y, n: inner_products(x, y, axes, feature, mass, sigmas).toDF(*(f"{n}{i}" for i in range(len(sigmas))))
    one = named(a, a, "aa").crossJoin(named(b, b, "bb")).crossJoin(named(a, b, "ab"))  # three single rows
    each = [F.greatest(F.col(f"aa{i}") + F.col(f"bb{i}") - 2 * F.col(f"ab{i}"), F.lit(0.0)) / F.col(f"bb{i}") for i in range(len(sigmas))]
    return one.select((sum(each[1:], each[0]) / len(sigmas)).alias("score"))


def footprint(targets: DataFrame, section: DataFrame, key: str, axes: Sequence[str], mass: str, sigma: float = 0.5, saturation: float = 0.25, cutoff: float = 1e-3) -> DataFrame:
    """targets with their weight of support by a section: its density there over a share of its own median density, held
    to 1; those at or below the cutoff go."""
    from lamella.operators.particles import kernel_sum

    x, y = axes
    numbered = section.withColumn("_n", F.monotonically_increasing_id())
    # the density at a place is that of all rows there
    own = numbered.groupBy(x, y).agg(F.min("_n").alias("_n"), F.count("*").alias("_k"))
    density = lambda rows, k: kernel_sum(rows, section, k, x, y, mass, sigma)
    levels = density(own, "_n").join(own.select("_n", "_k"), "_n").groupBy().agg(F.percentile("density", F.lit(0.5), F.col("_k")).alias("_m"))
    at = density(targets.select(key, x, y), key).crossJoin(levels)
    weight = F.least(F.col("density") / (F.lit(saturation) * F.col("_m")), F.lit(1.0))
    return targets.join(at.select(key, weight.alias("weight")), key).where(F.col("weight") > cutoff)


def distinct_candidates(candidates: list[tuple[float, float, float, float, bool]], k: int, shift: float = 3.0, angle: float = 20.0) -> list[tuple[float, float, float, float, bool]]:
    """The best k of (score, x, y, degrees, flip), lowest score first, each apart from those before it by more than a
    shift or an angle, or by its flip. The list is the search's, a few hundred at most."""
    kept: list[tuple[float, float, float, float, bool]] = []
    for one in sorted(candidates):
        same = lambda c, o=one: c[4] == o[4] and math.hypot(c[1] - o[1], c[2] - o[2]) <= shift and abs((c[3] - o[3] + 180) % 360 - 180) <= angle
        if len(kept) < k and not any(same(c) for c in kept):
            kept.append(one)
    return kept


#: Points or rings that are listed as one value; rings that one point after another takes; points and rings for a task.
LISTED, TURN, DEALT = 4_096, 256, 20_000


def _lists(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """(by, name): each group's values, in lists of LISTED or fewer (about, as they are dealt by hash)."""
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64(value), F.expr(f"1 + _n DIV {LISTED}"))
    out = rows.join(n, list(by)).groupBy(*by, part.alias("_part")).agg(F.collect_list(F.struct(F.col(value).alias("v"))).alias("_l"))
    return out.select(*by, F.transform("_l", lambda one: one["v"]).alias(name))


def in_rings(points: DataFrame, rings: DataFrame, point: str, x: str, y: str, ring: str, size: float) -> DataFrame:
    """(point, ring, winding, crossings): by nonzero winding a point is inside where winding isn't 0, by even-odd where
    crossings are odd; rows with neither don't come. rings: (ring, place, x, y), closed by themselves; a ring given k
    times counts k times, and so do rows of one point.

    Rings of equal corners are one shape, and points of equal places one place. Edges of shapes are listed in the bands
    of y that they reach, places in their band: a place meets the edges of its band. Lists of points meet lists of rings,
    and only the last stage takes them apart: there the points of a list take the same few rings one after another, so
    that columns in dictionaries or runs, as Parquet has them, need a small part of a byte for a row."""
    corners = F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    given = rings.select(F.col(ring).alias("_ring"), "place", "x", "y").repartition("_ring").groupBy("_ring", "place", "x", "y").agg(F.count("*").alias("_k"))
    own = kept(given.groupBy("_ring").agg(corners.alias("_v"), F.min("_k").alias("_times")))
    shapes = kept(own.select("_v").distinct().withColumn("_shape", F.monotonically_increasing_id()))
    edges = shapes.select("_shape", "_v", F.posexplode("_v").alias("_i", "_c"))
    after = F.try_element_at("_v", F.col("_i") + 2)
    edges = edges.select("_shape", F.col("_c.x").alias("_x0"), F.col("_c.y").alias("_y0"), F.coalesce(after["x"], F.col("_v")[0]["x"]).alias("_x1"), F.coalesce(after["y"], F.col("_v")[0]["y"]).alias("_y1")).where("_y0 <> _y1")
    low, high = F.least("_y0", "_y1"), F.greatest("_y0", "_y1")
    edges = edges.withColumn("_band", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    asked = points.select(F.col(point).alias("_p"), F.col(x).alias("_px"), F.col(y).alias("_py"))
    places = asked.select("_px", "_py").distinct().withColumn("_band", F.floor(F.col("_py") / size))
    up = (F.col("_y0") <= F.col("_py")) & (F.col("_y1") > F.col("_py"))
    down = (F.col("_y1") <= F.col("_py")) & (F.col("_y0") > F.col("_py"))
    cross = F.col("_x0") + (F.col("_py") - F.col("_y0")) / (F.col("_y1") - F.col("_y0")) * (F.col("_x1") - F.col("_x0"))
    hit = places.join(edges, "_band").where((up | down) & (cross > F.col("_px")))
    found = hit.groupBy("_px", "_py", "_shape").agg(F.sum(F.when(up, 1).otherwise(-1)).alias("winding"), F.count("*").alias("crossings"))
    inside = "winding <> 0 OR crossings % 2 = 1"
    of = asked.groupBy(F.col("_p").alias("_q")).count()
    m, most = of.agg(F.sum("count"), F.max("count")).first()
    again = of.where("count > 1").select("_q")
    same = F.col("_p").eqNullSafe(F.col("_q"))
    once = asked if (most or 0) < 2 else asked.join(again, same, "left_anti")
    sums = ["_shape", "winding", "crossings"]
    met = found.where(inside).join(_lists(once, ["_px", "_py"], "_p", "_points"), ["_px", "_py"]).select(*sums, "_points")
    if (most or 0) > 1:
        # rows of one point are summed as one
        mine = asked.join(again, same, "left_semi").join(found, ["_px", "_py"]).groupBy("_p", "_shape").agg(F.sum("winding").alias("winding"), F.sum("crossings").alias("crossings")).where(inside)
        met = met.union(_lists(mine, sums, "_p", "_points").select(*sums, "_points"))
    n = own.count()
    members = _lists(own.join(shapes, "_v").select("_shape", "_times", "_ring"), ["_shape", "_times"], "_ring", "_rings")
    met = met.join(F.broadcast(members) if n <= 10 * BROADCAST_ROWS else members.hint("merge"), "_shape")
    met = met.select((F.col("winding") * F.col("_times")).alias("winding"), (F.col("crossings") * F.col("_times")).alias("crossings"), "_points", "_rings")
    spark = points.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), ((m or 0) + n) // DEALT)
    turns = F.transform(F.sequence(F.lit(0), F.expr(f"CAST((size(_rings) - 1) DIV {TURN} AS INT)")), lambda i: F.slice("_rings", i * TURN + 1, TURN))
    # a stage of generated code holds all rows made of one of its rows; it doesn't take in transform(), so these two explode row by row
    taken = met.repartition(tasks).select("winding", "crossings", "_points", F.explode(turns).alias("_turn"))
    taken = taken.select("winding", "crossings", F.explode(F.transform("_points", lambda p: F.struct(p.alias("p"), F.col("_turn").alias("turn")))).alias("_t"))
    return taken.select(F.col("_t.p").alias(point), F.explode("_t.turn").alias(ring), "winding", "crossings").where(inside)


def raster(rings: DataFrame, shapes: DataFrame, ring: str, width: int, height: int, rule: str = "nonzero") -> DataFrame:
    """(x, y, label, painted, conflicts): pixels (their centres) of shapes painted in order, later ones over earlier
    ones; how many shapes painted a pixel, and how many of another label. shapes: (ring, rank, label); 0 is no label."""
    pixels = rings.sparkSession.range(width * height).select(F.col("id").alias("pixel"), (F.col("id") % width + 0.5).alias("x"), (F.floor(F.col("id") / width) + 0.5).alias("y"))
    inside = in_rings(pixels, rings, "pixel", "x", "y", ring, 1.0).where("winding <> 0" if rule == "nonzero" else "crossings % 2 = 1")
    painted = inside.join(shapes, ring)
    top = painted.groupBy("pixel").agg(F.max(F.struct("rank", "label")).alias("t"), F.count("*").alias("painted"))
    other = painted.join(top, "pixel").groupBy("pixel").agg(F.first("t").alias("t"), F.first("painted").alias("painted"), F.count(F.when(F.col("label") != F.col("t.label"), 1)).alias("conflicts"))
    return other.select((F.col("pixel") % width).alias("x"), F.floor(F.col("pixel") / width).alias("y"), F.col("t.label").alias("label"), "painted", "conflicts")


def identified_frame(points: DataFrame, rings: DataFrame, point: str, x: str, y: str, label: str, ring: str, size: float, least: float = 0.9) -> DataFrame:
    """(swap, sx, sy, agreement, rings): of the eight ways to swap and flip the axes, the one under which most labelled
    points lie in a ring whose most frequent label is theirs; rings must have different labels, and the agreement be at
    least `least`, else no row."""
    ways = points.sparkSession.createDataFrame([(s, i, j) for s in (False, True) for i in (1, -1) for j in (1, -1)], "swap boolean, sx int, sy int")
    turned = points.crossJoin(F.broadcast(ways))  # eight rows
    key = F.struct(point, "swap", "sx", "sy")
    turned = turned.select(key.alias("_k"), label, (F.col("sx") * F.when(F.col("swap"), F.col(y)).otherwise(F.col(x))).alias("_x"), (F.col("sy") * F.when(F.col("swap"), F.col(x)).otherwise(F.col(y))).alias("_y"))
    hit = in_rings(turned, rings, "_k", "_x", "_y", ring, size).where("winding <> 0").join(turned.select("_k", label), "_k")
    way = ["_k.swap", "_k.sx", "_k.sy"]
    votes = hit.groupBy(*(F.col(w) for w in way), ring, label).agg(F.count("*").alias("n"))
    won = votes.groupBy("swap", "sx", "sy", ring).agg(F.max(F.struct("n", F.col(label).alias("l"))).alias("b"))
    sums = won.groupBy("swap", "sx", "sy").agg(F.sum("b.n").alias("right"), F.count("*").alias("rings"), F.countDistinct("b.l").alias("labels"))
    n = points.agg(F.count(label).alias("_n"))
    scored = sums.crossJoin(n).withColumn("agreement", F.col("right") / F.col("_n")).where((F.col("labels") == F.col("rings")) & (F.col("agreement") >= least))
    best = scored.groupBy().agg(F.max(F.struct("agreement", "swap", "sx", "sy", "rings")).alias("b")).where("b IS NOT NULL")
    return best.select("b.swap", "b.sx", "b.sy", F.round("b.agreement", 6).alias("agreement"), "b.rings")


def reslice(voxels: DataFrame, axes: Sequence[str], label: str, origin: Sequence[float], u: Sequence[float], v: Sequence[float], half: float, step: float, spacing: float = 1.0) -> DataFrame:
    """(i, j, label): the labels of the nearest voxels on a plane's grid of nodes, 0 where there is none. Voxels are rows
    with whole indexes, spacing apart."""
    n = int(math.floor(2 * half / step + 1e-9)) + 1
    nodes = voxels.sparkSession.range(n * n).select(F.floor(F.col("id") / n).alias("j"), (F.col("id") % n).alias("i"))
    a, b = F.col("i") * step - half, F.col("j") * step - half
    # halves go to the even neighbour, as rint has it
    nearest = [F.rint((F.lit(float(o)) + a * float(p) + b * float(q)) / spacing).cast("long").alias(f"_v{k}") for k, (o, p, q) in enumerate(zip(origin, u, v, strict=True))]
    own = voxels.select(*(F.col(c).cast("long").alias(f"_v{k}") for k, c in enumerate(axes)), label)
    return nodes.select("i", "j", *nearest).join(own, [f"_v{k}" for k in range(len(axes))], "left").select("i", "j", F.coalesce(label, F.lit(0)).alias("label"))


def reflected(pixels: DataFrame, x: str, width: int) -> DataFrame:
    """pixels beside their mirror image: columns width..2 width - 1 in reverse order, nothing interpolated."""
    return pixels.withColumn("mirrored", F.lit(False)).union(pixels.withColumn(x, F.lit(2 * width - 1) - F.col(x)).withColumn("mirrored", F.lit(True)))


def landing(points: DataFrame, voxels: DataFrame, axes: Sequence[str], label: str, region: Sequence[int], spacing: float) -> DataFrame:
    """(class, n, share): where points land in a label volume: in a region, outside of it, or on no voxel at all."""
    own = voxels.select(*(F.col(a).cast("long").alias(f"_v{i}") for i, a in enumerate(axes)), F.col(label).alias("_l"))
    at = points.select(*(F.rint(F.col(a) / spacing).cast("long").alias(f"_v{i}") for i, a in enumerate(axes)))
    kind = F.when(F.col("_l").isNull() | (F.col("_l") == 0), "dropped").when(F.col("_l").isin(*region), "region").otherwise("outside")
    counted = at.join(own, [f"_v{i}" for i in range(len(axes))], "left").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_t"))
    return counted.crossJoin(total).select("class", "n", F.round(F.col("n") / F.col("_t"), 6).alias("share"))


def hard_histogram(rows: DataFrame, unit: str, value: str, bins: int) -> DataFrame:
    """How many of a unit's values in [0, 1] fall to each of the bin centres, halves to the even one."""
    at = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))) * (bins - 1)).cast("int")
    return rows.groupBy(unit, at.alias("bin")).agg(F.count("*").alias("n"))


def downsampled(pixels: DataFrame, section: str, axes: Sequence[str], factor: int, value: str, weight: str) -> DataFrame:
    """Weighted means of blocks of a section's pixels, whose origin stays: the centre of a block is where its pixels' is."""
    keys = [F.floor(F.col(a) / factor).alias(a) for a in axes]
    w = F.sum(weight)
    return pixels.groupBy(section, *keys).agg(F.round(F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / w).otherwise(0.0), 6).alias(value), F.round(w, 6).alias(weight)).withColumns({f"{a}_centre": F.col(a) * factor + (factor - 1) / 2 for a in axes})


def overlay(layers: DataFrame, order: str, place: Sequence[str], label: str) -> DataFrame:
    """The label of the last layer that has one (not 0) at each place."""
    return layers.where(F.col(label) != 0).groupBy(*place).agg(F.max_by(label, order).alias(label))


def clipped_information(rows: DataFrame, group: str, x: str, y: str, support: str, bins: int = 64, least: int = 64, floor: float = 0.05, clip: float = 0.005) -> DataFrame:
    """Normalised mutual information over rows with support above the floor and finite values, both clipped to their own
    outer quantiles; null below `least` rows or where a range is degenerate."""
    from lamella.operators.volumes import mutual_information

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    own = rows.where((F.col(support) > floor) & finite(x) & finite(y))
    q = lambda c: F.percentile(c, F.array(F.lit(clip), F.lit(1 - clip)))
    ends = own.groupBy(group).agg(q(x).alias("_x"), q(y).alias("_y"))
    held = lambda c, e: F.greatest(F.col(e)[0], F.least(F.col(e)[1], F.col(c)))
    return mutual_information(own.join(ends, group).select(group, held(x, "_x").alias(x), held(y, "_y").alias(y)), group, x, y, bins, least)


_P = {"id": "l_orderkey * 8 + l_linenumber", "x": "CAST(l_quantity AS DOUBLE)", "y": "l_discount * 100", "z": "l_tax * 100", "m": "l_tax + 0.01", "f": "l_returnflag"}
_Q = {"id": "p_partkey", "x": "p_size + 0.25", "y": "CAST(p_partkey % 11 AS DOUBLE)"}
_PLACES = {"id": "o_orderkey", "x": "(o_custkey % 60) / 2.0", "y": "(o_orderkey % 40) / 2.0", "m": "1.0 + o_orderkey % 3", "q": "(1.0 + o_orderkey % 3) * (o_custkey % 10)", "label": "1 + CAST(o_orderkey % 5 AS INT)"}
_MATRIX = ((0.5, -0.25, 3.0), (0.25, 0.5, -1.0))
#: A quadrangle for each customer, some of them self-crossing.
_CORNERS = ("(c_custkey * 7) % 40 + 0.2", "(c_custkey * 3) % 30 + 0.3", "(c_custkey * 7) % 40 + 6.2 + c_custkey % 3", "(c_custkey * 3) % 30 + 0.7", "(c_custkey * 7) % 40 + 1.1", "(c_custkey * 3) % 30 + 7.6", "(c_custkey * 7) % 40 + 5.7", "(c_custkey * 3) % 30 + 4.9")
_SHAPES = {"ring": "c_custkey", "rank": "c_custkey", "label": "1 + c_nationkey"}
_VOXELS = {"i": "l_linenumber - 4", "j": "CAST(l_quantity AS INT) - 25", "k": "CAST(round(l_discount * 100) AS INT)", "label": "1 + l_suppkey % 4"}


def _rings(s, d):
    out = None
    for i in range(4):
        part = made(s, d, "customer", {"ring": "c_custkey", "place": str(i), "x": f"CAST({_CORNERS[2 * i]} AS DOUBLE)", "y": f"CAST({_CORNERS[2 * i + 1]} AS DOUBLE)"})
        out = part if out is None else out.union(part)
    return out


def _voxels(s, d):
    return made(s, d, "lineitem", _VOXELS).groupBy("i", "j", "k").agg(F.min("label").alias("label"))


def _transform(s, d):
    m = Frames(drawing_transform("translate(3,-1) rotate(30 2 1) scale(2, .5)"), "a", "b").then(Frames(drawing_transform("matrix(1 0 .5 1 2 3)"), "b", "c"))
    back = m.then(m.inverse())
    there = transformed(made(s, d, "part", _Q), ["x", "y"], m.matrix[:2])
    again = transformed(made(s, d, "part", _Q).withColumnsRenamed({"x": "x0", "y": "y0"}), ["x0", "y0"], back.matrix[:2])
    return there.join(again, "id").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))


_U, _V, _N = plane_basis(20.0, 10.0)


def _rounded(rows, *columns, digits=6):
    return rows.withColumns({c: F.round(c, digits) for c in columns})


def _halves(s, d):
    return made(s, d, "orders", _PLACES).where("id % 2 = 0"), made(s, d, "orders", _PLACES).where("id % 2 = 1")


def _intensities(s, d):
    rows = made(s, d, "lineitem", {"id": "l_orderkey", "g": "l_returnflag", "price": "l_extendedprice", "byte": "l_quantity * 5.3"})
    modes = [("robust", "price"), ("minmax", "price"), ("bytes", "byte"), ("fixed", "byte")]
    parts = [transformed_intensity(rows, "g", v, mode, 20.0, 200.0).select("id", F.lit(mode).alias("mode"), F.round("scaled", 6).alias("scaled")) for mode, v in modes]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


QUERIES = {
    "affine_points": lambda s, d: _rounded(transformed(made(s, d, "lineitem", _P), ["x", "y"], _MATRIX).select("id", "x", "y"), "x", "y"),
    "drawing_transform": _transform,
    "centred_places": lambda s, d: _rounded(centred_places(made(s, d, "lineitem", {"id": "l_orderkey * 8 + l_linenumber", "x": "CASE l_linenumber WHEN 3 THEN NULL ELSE l_quantity END", "y": "l_discount"}), ["x", "y"], 0.5, "box")[0], "x", "y"),
    "plane_places": lambda s, d: _rounded(slab_sides(made(s, d, "lineitem", _P).withColumn("x", F.col("x") - 25), ["x", "y", "z"], [0.0, 5.0, 4.0], _U, _V, 3.0, "m", "right").select("id", "a", "b", "m"), "a", "b", "m"),
    "lattice_z": lambda s, d: made(s, d, "part", {"id": "p_partkey", "slot": "p_partkey % 50"}).select("id", lattice_z(F.col("slot"), 50.0, 50).alias("z")),
    "mask_modes": lambda s, d: masked(made(s, d, "events", {"id": "event_id", "v": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE value - 60 END", "inside": "event_id % 3 <> 0"}), "v", "threshold", 5.0, "inside").select("id"),
    "intensity_modes": _intensities,
    "channel_density": lambda s, d: _rounded(density_by_channel(made(s, d, "lineitem", {"id": "l_orderkey * 8 + l_linenumber", "g": "l_linestatus", "v": "l_extendedprice"}), "g", "v").select("id", "density"), "density"),
    "knn_radius": lambda s, d: _rounded(neighbours(made(s, d, "part", _Q), made(s, d, "orders", _PLACES).withColumnRenamed("id", "p"), "id", "p", ["x", "y"], 4, 1.5), "distance"),
    "knn_recon": lambda s, d: _rounded(reconstructed(made(s, d, "part", _Q), made(s, d, "orders", _PLACES).withColumnRenamed("id", "p"), "id", "p", ["x", "y"], "m", "q", 0.4, 8), "value", "weight"),
    "knn_labels": lambda s, d: reconstructed_labels(made(s, d, "part", _Q), made(s, d, "orders", _PLACES).withColumnRenamed("id", "p"), made(s, d, "orders", _PLACES).select(F.col("id").alias("p"), "label", "m"), "id", "p", ["x", "y"], "label", "m", 0.4, 8),
    "feature_groups": lambda s, d: grouped_features(made(s, d, "lineitem", {"id": "l_orderkey", "f": "l_returnflag", "m": "l_quantity"}), "f", "m", {"one": ["A", "N"]}, ["R"]).groupBy("id", "f").agg(F.sum("m").alias("m")),
    "area_masses": lambda s, d: area_masses(made(s, d, "lineitem", {"x": "l_orderkey % 50", "y": "CAST(l_quantity AS INT) - 1", "l": "l_suppkey % 6"}).distinct(), "x", "y", "l", {"grey": [1, 2], "white": [3]}, 0.05, 4, 50),
    "varifold": lambda s, d: _rounded(varifold_distance(*_halves(s, d), ["x", "y"], "label", "m"), "score"),
    "footprint_weight": lambda s, d: _rounded(footprint(made(s, d, "part", _Q), _halves(s, d)[0].where("x < 20"), "id", ["x", "y"], "m").select("id", "weight"), "weight", digits=5),
    "point_in_ring": lambda s, d: in_rings(made(s, d, "part", _Q), _rings(s, d), "id", "x", "y", "ring", 4.0),
    "ring_raster": lambda s, d: raster(_rings(s, d), made(s, d, "customer", _SHAPES), "ring", 48, 40),
    "frame_vote": lambda s, d: identified_frame(made(s, d, "orders", {"id": "o_orderkey", "x": "-((o_orderkey * 17) % 1000) / 10.0 - 0.03", "y": "((o_orderkey * 29) % 900) / 10.0 + 0.07", "label": "CASE WHEN o_orderkey % 23 = 0 THEN 9 WHEN ((o_orderkey * 17) % 1000) / 10.0 + 0.03 < 50 THEN 1 ELSE 2 END"}), made(s, d, "nation", {"ring": "n_nationkey % 2", "place": "n_nationkey", "x": "CASE n_nationkey % 8 WHEN 0 THEN 0.0 WHEN 2 THEN 0.0 WHEN 4 THEN 90.0 WHEN 6 THEN 90.0 WHEN 1 THEN 0.0 WHEN 3 THEN 0.0 WHEN 5 THEN 90.0 ELSE 90.0 END", "y": "CASE n_nationkey % 8 WHEN 0 THEN 0.0 WHEN 2 THEN 50.0 WHEN 4 THEN 50.0 WHEN 6 THEN 0.0 WHEN 1 THEN 50.0 WHEN 3 THEN 100.0 WHEN 5 THEN 100.0 ELSE 50.0 END"}).where("place < 8"), "id", "x", "y", "label", "ring", 10.0, 0.5),
    "reslice": lambda s, d: reslice(_voxels(s, d), ["i", "j", "k"], "label", [0.3, 0.2, 4.0], _U, _V, 10.0, 1.0),
    "reflection": lambda s, d: reflected(made(s, d, "part", {"x": "p_partkey % 50", "y": "p_size", "v": "p_retailprice"}), "x", 50),
    "hard_histogram": lambda s, d: hard_histogram(made(s, d, "lineitem", {"u": "l_suppkey", "v": "l_quantity / 50"}), "u", "v", 9),
    "section_downsample": lambda s, d: downsampled(made(s, d, "lineitem", {"s": "l_linenumber", "x": "l_orderkey % 64", "y": "CAST(l_quantity AS INT)", "v": "l_extendedprice", "w": "l_tax"}), "s", ["x", "y"], 8, "v", "w"),
    "label_overlay": lambda s, d: overlay(made(s, d, "lineitem", {"g": "l_linenumber", "x": "l_orderkey % 40", "y": "l_partkey % 30", "l": "l_suppkey % 5"}).groupBy("g", "x", "y").agg(F.max("l").alias("l")), "g", ["x", "y"], "l"),
    "clipped_information": lambda s, d: clipped_information(made(s, d, "lineitem", {"g": "l_returnflag", "x": "l_quantity", "y": "l_extendedprice", "s": "l_tax"}), "g", "x", "y", "s", 16),
}


def _landing(s, d):
    points = made(s, d, "orders", {"i": "CAST(o_orderkey % 9 AS DOUBLE) - 4.4", "j": "CAST(o_custkey % 60 AS DOUBLE) - 30.3", "k": "CAST(o_orderkey % 12 AS DOUBLE) + 0.2"})
    return landing(points, _voxels(s, d), ["i", "j", "k"], "label", [1, 3], 1.0)


QUERIES["landing"] = _landing
_C = lambda v: f"CAST({v!r} AS DOUBLE)"


def _matrix_sql(m: Matrix, x: str, y: str) -> list[str]:
    return [f"{_C(float(r[0]))} * {x} + {_C(float(r[1]))} * {y} + {_C(float(r[2]))}" for r in m[:2]]


_T = Frames(drawing_transform("translate(3,-1) rotate(30 2 1) scale(2, .5)"), "a", "b").then(Frames(drawing_transform("matrix(1 0 .5 1 2 3)"), "b", "c"))
_TX, _TY = _matrix_sql(_T.matrix, "x", "y")
_AX, _AY = _matrix_sql(_MATRIX, "x", "y")
_KNN = lambda r: f"""nb AS (SELECT q.id, o.id AS p, sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y)) AS d, o.m, o.q, o.label FROM {made_sql("part", _Q)} q JOIN {made_sql("orders", _PLACES)} o ON abs(q.x - o.x) <= 2 AND abs(q.y - o.y) <= 2),
  rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, p) AS k FROM nb WHERE d <= {r})"""  # noqa: E731
_EDGES = "e AS (" + " UNION ALL ".join(f"SELECT c_custkey AS ring, CAST({_CORNERS[2 * i]} AS DOUBLE) AS x0, CAST({_CORNERS[2 * i + 1]} AS DOUBLE) AS y0, CAST({_CORNERS[(2 * i + 2) % 8]} AS DOUBLE) AS x1, CAST({_CORNERS[(2 * i + 3) % 8]} AS DOUBLE) AS y1 FROM customer" for i in range(4)) + ")"
_INSIDE = """w AS (SELECT p.id, ring, CAST(sum(CASE WHEN y0 <= p.y AND y1 > p.y THEN 1 ELSE -1 END) AS BIGINT) AS winding, count(*) AS crossings FROM pts p JOIN e ON ((y0 <= p.y AND y1 > p.y) OR (y1 <= p.y AND y0 > p.y)) AND x0 + (p.y - y0) / (y1 - y0) * (x1 - x0) > p.x GROUP BY 1, 2)"""
_VOX = f"vx AS (SELECT i, j, k, min(label) AS label FROM {made_sql('lineitem', _VOXELS)} GROUP BY 1, 2, 3)"
_PL = made_sql("orders", _PLACES)
SQL = {
    "affine_points": f"SELECT id, round({_AX}, 6) AS x, round({_AY}, 6) AS y FROM {made_sql('lineitem', _P)}",
    "drawing_transform": f"SELECT id, round({_TX}, 6) AS x, round({_TY}, 6) AS y, round(x, 6) AS x0, round(y, 6) AS y0 FROM (SELECT id, CAST(x AS DOUBLE) AS x, y FROM {made_sql('part', _Q)})",
    "centred_places": "WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity * 0.5::DOUBLE AS x, l_discount * 0.5::DOUBLE AS y FROM lineitem WHERE l_linenumber <> 3) SELECT id, round(x - (SELECT (min(x) + max(x)) / 2 FROM k), 6) AS x, round(y - (SELECT (min(y) + max(y)) / 2 FROM k), 6) AS y FROM k",
    "plane_places": f"WITH p AS (SELECT id, x - 25 AS x, y - 5 AS y, z - 4 AS z, m FROM {made_sql('lineitem', _P)}) SELECT id, round(x * {_C(_U[0])} + y * {_C(_U[1])} + z * {_C(_U[2])}, 6) AS a, round(x * {_C(_V[0])} + y * {_C(_V[1])} + z * {_C(_V[2])}, 6) AS b, round(m / 3, 6) AS m FROM p WHERE abs(x * {_C(_N[0])} + y * {_C(_N[1])} + z * {_C(_N[2])}) <= 1.5 AND x > 0",
    "lattice_z": "SELECT p_partkey AS id, (p_partkey % 50 - 24.5::DOUBLE) * 50 AS z FROM part",
    "mask_modes": "SELECT event_id AS id FROM events WHERE event_id % 5 > 1 AND value - 60 > 5 AND event_id % 3 <> 0",
    "intensity_modes": "WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) SELECT l_orderkey AS id, unnest(['robust', 'minmax', 'bytes', 'fixed']) AS mode, unnest([round(greatest(0.0, least(1.0, (l_extendedprice - a) / (b - a))), 6), round((l_extendedprice - lo) / (hi - lo), 6), round(greatest(0.0, least(1.0, round_even(l_quantity * 5.3::DOUBLE, 0) / 255)), 6), round(greatest(0.0, least(1.0, (l_quantity * 5.3::DOUBLE - 20) / 180)), 6)]) AS scaled FROM lineitem JOIN q ON g = l_returnflag",
    "channel_density": "WITH w AS (SELECT l_linestatus AS g, quantile_cont(l_extendedprice, 0.995) AS w FROM lineitem GROUP BY 1) SELECT l_orderkey * 8 + l_linenumber AS id, round(0.0::DOUBLE - ln(greatest(0.001::DOUBLE, least(1.0::DOUBLE, l_extendedprice / w))), 6) AS density FROM lineitem JOIN w ON g = l_linestatus",
    "knn_radius": f"WITH {_KNN(1.5)} SELECT id, CAST(k AS INT) AS rank, p, round(d, 6) AS distance FROM rk WHERE k <= 4",
    "knn_recon": f"WITH {_KNN(1.6)}, s AS (SELECT id, sum(exp(-0.5 * (d / 0.4) ** 2) * m) AS m, sum(exp(-0.5 * (d / 0.4) ** 2) * q) AS q FROM rk WHERE k <= 8 GROUP BY 1) SELECT p_partkey AS id, round(CASE WHEN m > 1e-8 THEN q / m ELSE 0 END, 6) AS value, round(coalesce(m, 0), 6) AS weight, coalesce(m > 1e-8, false)::INT AS support FROM part LEFT JOIN s ON s.id = p_partkey",
    "knn_labels": f"WITH {_KNN(1.6)}, s AS (SELECT id, label, sum(exp(-0.5 * (d / 0.4) ** 2) * m) AS m FROM rk WHERE k <= 8 GROUP BY 1, 2), b AS (SELECT id, -max((round(m, 12), -label))[2] AS label, sum(m) AS t FROM s GROUP BY 1) SELECT p_partkey AS id, CASE WHEN t > 1e-8 THEN label ELSE 0 END AS label FROM part LEFT JOIN b ON b.id = p_partkey",
    "feature_groups": "SELECT l_orderkey AS id, 'one' AS f, sum(l_quantity) AS m FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1",
    "area_masses": "WITH p AS (SELECT DISTINCT l_orderkey % 50 AS x, CAST(l_quantity AS INT) - 1 AS y, l_suppkey % 6 AS l FROM lineitem), b AS (SELECT floor(x / 4) AS bx, floor(y / 4) AS b, round(count(*) FILTER (WHERE l IN (1, 2)) * 0.0025::DOUBLE, 9) AS grey, round(count(*) FILTER (WHERE l = 3) * 0.0025::DOUBLE, 9) AS white FROM p WHERE x < 48 AND y < 48 GROUP BY 1, 2) SELECT round((bx * 4 + 1.5) * 0.05::DOUBLE, 9) AS a, round((b * 4 + 1.5) * 0.05::DOUBLE, 9) AS b, grey, white FROM b WHERE grey + white > 0",
    "varifold": f"""WITH o AS (SELECT id % 2 AS h, label, x, y, sum(m) AS m FROM {_PL} GROUP BY 1, 2, 3, 4), s(sg) AS (VALUES (2.0::DOUBLE), (1.0::DOUBLE), (0.5::DOUBLE)), i AS (SELECT sg, sum(CASE WHEN a.h = 0 AND b.h = 0 THEN a.m * b.m * exp(-d2 / (2 * sg * sg)) ELSE 0 END) AS aa, sum(CASE WHEN a.h = 1 AND b.h = 1 THEN a.m * b.m * exp(-d2 / (2 * sg * sg)) ELSE 0 END) AS bb, sum(CASE WHEN a.h = 0 AND b.h = 1 THEN a.m * b.m * exp(-d2 / (2 * sg * sg)) ELSE 0 END) AS ab
      FROM (SELECT a, b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM o a JOIN o b ON a.label = b.label) JOIN s ON d2 <= 36 * sg * sg GROUP BY 1) SELECT round(avg(greatest(aa + bb - 2 * ab, 0) / bb), 6) AS score FROM i""",
    "footprint_weight": f"""WITH o AS (SELECT * FROM {_PL} WHERE id % 2 = 0 AND x < 20), g AS (SELECT x, y, count(*) AS k, sum(m) AS m FROM o GROUP BY 1, 2), dn AS (SELECT a.x, a.y, any_value(a.k) AS k, round(sum(b.m * exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 0.5)), 6) AS d FROM g a JOIN g b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 6.25 GROUP BY 1, 2),
      md AS (SELECT quantile_cont(d, 0.5) AS m FROM dn, range(0, k) r(i)), t AS (SELECT q.id, round(sum(g.m * exp(-((q.x - g.x) ** 2 + (q.y - g.y) ** 2) / 0.5)), 6) AS d FROM {made_sql("part", _Q)} q JOIN g ON (q.x - g.x) ** 2 + (q.y - g.y) ** 2 <= 6.25 GROUP BY 1) SELECT id, round(least(d / (0.25 * m), 1.0), 5) AS weight FROM t, md WHERE least(d / (0.25 * m), 1.0) > 0.001""",
    "point_in_ring": f"WITH {_EDGES}, pts AS (SELECT id, x, y FROM {made_sql('part', _Q)}), {_INSIDE} SELECT * FROM w WHERE winding <> 0 OR crossings % 2 = 1",
    "ring_raster": f"""WITH {_EDGES}, pts AS (SELECT i AS id, i % 48 + 0.5::DOUBLE AS x, i // 48 + 0.5::DOUBLE AS y FROM range(0, 1920) r(i)), {_INSIDE}, h AS (SELECT id, c_custkey AS rank, 1 + c_nationkey AS label FROM w JOIN customer ON c_custkey = ring WHERE winding <> 0), t AS (SELECT id, arg_max(label, rank) AS label, count(*) AS painted FROM h GROUP BY 1)
      SELECT t.id % 48 AS x, t.id // 48 AS y, t.label, painted, count(*) FILTER (WHERE h.label <> t.label) AS conflicts FROM t JOIN h ON h.id = t.id GROUP BY ALL""",
    "frame_vote": """WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 17) % 1000) / 10.0 + 0.03 AS u, ((o_orderkey * 29) % 900) / 10.0 + 0.07 AS v FROM orders), l AS (SELECT *, CASE WHEN id % 23 = 0 THEN 9 WHEN u < 50 THEN 1 ELSE 2 END AS label, CASE WHEN u < 50 THEN 0 WHEN u < 100 THEN 1 END AS ring FROM p WHERE v < 90),
      c AS (SELECT ring, label, count(*) AS n FROM l WHERE ring IS NOT NULL GROUP BY 1, 2), b AS (SELECT ring, max(n) AS n FROM c GROUP BY 1) SELECT true AS swap, 1 AS sx, -1 AS sy, round(sum(n) / (SELECT count(*) FROM p), 6) AS agreement, count(*) AS rings FROM b""",
    "reslice": f"""WITH {_VOX}, n AS (SELECT i % 21 AS i, i // 21 AS j FROM range(0, 441) r(i)), v AS (SELECT i AS ni, j AS nj, {", ".join(f"CAST(round_even({_C(o)} + (i - 10) * {_C(p)} + (j - 10) * {_C(q)}, 0) AS BIGINT) AS v{k}" for k, (o, p, q) in enumerate(zip((0.3, 0.2, 4.0), _U, _V, strict=True)))} FROM n)
      SELECT ni AS i, nj AS j, coalesce(label, 0) AS label FROM v LEFT JOIN vx ON vx.i = v0 AND vx.j = v1 AND vx.k = v2""",
    "reflection": "SELECT p_partkey % 50 AS x, p_size AS y, p_retailprice AS v, false AS mirrored FROM part UNION ALL SELECT 99 - p_partkey % 50, p_size, p_retailprice, true FROM part",
    "landing": f"""WITH {_VOX}, p AS (SELECT CAST(round_even(CAST(o_orderkey % 9 AS DOUBLE) - 4.4, 0) AS BIGINT) AS a, CAST(round_even(CAST(o_custkey % 60 AS DOUBLE) - 30.3, 0) AS BIGINT) AS b, CAST(round_even(CAST(o_orderkey % 12 AS DOUBLE) + 0.2, 0) AS BIGINT) AS c FROM orders)
      SELECT CASE WHEN label IS NULL THEN 'dropped' WHEN label IN (1, 3) THEN 'region' ELSE 'outside' END AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p LEFT JOIN vx ON vx.i = a AND vx.j = b AND vx.k = c GROUP BY 1""",
    "hard_histogram": "SELECT l_suppkey AS u, CAST(round_even(l_quantity / 50 * 8, 0) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "section_downsample": "SELECT l_linenumber AS s, CAST(floor((l_orderkey % 64) / 8) AS BIGINT) AS x, CAST(floor(CAST(l_quantity AS INT) / 8) AS BIGINT) AS y, round(CASE WHEN sum(l_tax) > 0 THEN sum(l_extendedprice * l_tax) / sum(l_tax) ELSE 0 END, 6) AS v, round(sum(l_tax), 6) AS w, CAST(floor((l_orderkey % 64) / 8) AS BIGINT) * 8 + 3.5::DOUBLE AS x_centre, CAST(floor(CAST(l_quantity AS INT) / 8) AS BIGINT) * 8 + 3.5::DOUBLE AS y_centre FROM lineitem GROUP BY 1, 2, 3",
    "label_overlay": "WITH l AS (SELECT l_linenumber AS g, l_orderkey % 40 AS x, l_partkey % 30 AS y, max(l_suppkey % 5) AS l FROM lineitem GROUP BY 1, 2, 3) SELECT x, y, arg_max(l, g) AS l FROM l WHERE l <> 0 GROUP BY 1, 2",
    "clipped_information": """WITH r AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_tax > 0.05), q AS (SELECT g, quantile_cont(x, 0.005) AS xa, quantile_cont(x, 0.995) AS xb, quantile_cont(y, 0.005) AS ya, quantile_cont(y, 0.995) AS yb, count(*) AS n FROM r GROUP BY 1),
      c AS (SELECT g, n, least(15, floor((greatest(xa, least(xb, x)) - xa) * 16 / (xb - xa))) AS i, least(15, floor((greatest(ya, least(yb, y)) - ya) * 16 / (yb - ya))) AS j FROM r JOIN q USING (g)), k AS (SELECT g, n, i, j, count(*) / n AS p FROM c GROUP BY g, n, i, j), m AS (SELECT *, sum(p) OVER (PARTITION BY g, i) AS px, sum(p) OVER (PARTITION BY g, j) AS py FROM k)
      SELECT q.g, q.n, CASE WHEN q.n >= 64 THEN v END AS nmi FROM q LEFT JOIN (SELECT g, round(2 * sum(p * ln(p / (px * py))) / (sum(-p * ln(px)) + sum(-p * ln(py))), 6) AS v FROM m GROUP BY g) x ON x.g = q.g""",
}
