"""Masks of images in long form: thresholds from histograms, parts that hang together, depths, and reflected halves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.geometry import neighbours
from lamella.plans import made, made_sql
from lamella.plans.prefix import kept


def otsu(rows: DataFrame, group: str, value: str, bins: int = 256) -> DataFrame:
    """(group, threshold): the middle of the bin after which the variance between both sides is largest (ties: the first),
    over equal bins between the group's extremes; null in a constant group."""
    ends = rows.where(F.col(value).isNotNull()).groupBy(group).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_a")) / width)).cast("int")
    counts = rows.join(ends.where("_b > _a"), group).groupBy(group, "_a", "_b", bin_.alias("_obin")).agg(F.count("*").alias("_on"))
    middle = F.col("_a") + (F.col("_obin") + 0.5) * width
    # at most `bins` rows a group are left
    m = _sides(counts.withColumn("_om", middle), group)
    best = m.where("_on0 < _on").withColumn("_ov", F.round(F.col("_on0") * (F.col("_on") - F.col("_on0")) * (F.col("_os0") / F.col("_on0") - (F.col("_os") - F.col("_os0")) / (F.col("_on") - F.col("_on0"))) ** 2, 6))
    found = best.groupBy(group).agg(F.max_by("_om", F.struct("_ov", -F.col("_obin"))).alias("threshold"))
    return ends.select(group).join(found, group, "left")


def _sides(m: DataFrame, group: str) -> DataFrame:
    upto = Window.partitionBy(group).orderBy("_obin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(group)
    weighted = F.col("_on") * F.col("_om")
    return m.select(group, "_obin", "_om", F.sum("_on").over(upto).alias("_on0"), F.sum(weighted).over(upto).alias("_os0"), F.sum("_on").over(whole).alias("_on"), F.sum(weighted).over(whole).alias("_os"))


def components(pixels: DataFrame, key: Sequence[str], y: str, x: str, diagonal: bool = True) -> DataFrame:
    """(key, y, x, part): pixels that hang together share a part, its least (y, x) as text. Rounds of taking the least
    label of the neighbours and of the label's own pixel, until none changes."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if diagonal or abs(a) + abs(b) <= 1]
    own = pixels.select(*key, F.col(y).cast("long").alias("_y"), F.col(x).cast("long").alias("_x")).distinct()
    labels = kept(own.withColumn("_l", F.struct("_y", "_x")))
    at = [*key, "_y", "_x"]
    while True:
        around = labels.withColumn("_s", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))))
        spread = around.select(*key, (F.col("_y") + F.col("_s.a")).alias("_y"), (F.col("_x") + F.col("_s.b")).alias("_x"), "_l")
        least = spread.groupBy(*at).agg(F.min("_l").alias("_n"))
        moved = labels.join(least, at).select(*at, "_l", "_n")
        # the label's own pixel may have found a smaller one: jump to it
        top = moved.select(*key, F.struct("_y", "_x").alias("_n"), F.col("_n").alias("_t"))
        jumped = kept(moved.join(top, [*key, "_n"]).select(*at, "_l", F.least("_n", "_t").alias("_n")))
        if jumped.where("_l <> _n").isEmpty():
            return jumped.select(*key, F.col("_y").alias(y), F.col("_x").alias(x), F.concat_ws(",", F.col("_n._y").cast("string"), F.col("_n._x").cast("string")).alias("part"))
        labels = jumped.select(*at, F.col("_n").alias("_l"))


def large_parts(parts: DataFrame, key: Sequence[str], least: int) -> DataFrame:
    """The pixels of parts of at least so many pixels."""
    sizes = parts.groupBy(*key, "part").agg(F.count("*").alias("_k")).where(F.col("_k") >= least).select(*key, "part")
    return parts.join(sizes, [*key, "part"], "left_semi")


def tissue_pixels(pixels: DataFrame, section: str, y: str, x: str, density: str, least: int) -> DataFrame:
    """(section, y, x, part): pixels whose log density lies above its threshold, in parts of at least so many pixels."""
    logs = pixels.withColumn("_v", F.ln(F.col(density) + 0.01))
    level = otsu(logs, section, "_v")
    return large_parts(components(logs.join(level, section).where("_v > threshold"), [section], y, x), [section], least)


def either_mask(pixels: DataFrame, section: str, y: str, x: str, texture: str, darkness: str) -> DataFrame:
    """Pixels of which the texture or the darkness lies above its own threshold."""
    t, d = (otsu(pixels, section, c).withColumnRenamed("threshold", f"_{n}") for c, n in ((texture, "t"), (darkness, "d")))
    return pixels.join(t, section).join(d, section).where((F.col(texture) > F.col("_t")) | (F.col(darkness) > F.col("_d"))).select(section, y, x)


def ribbon_depth(pixels: DataFrame, key: str, y: str, x: str, layer: str, spacing: float, reach: float) -> DataFrame:
    """(key, y, x, layer, depth): the distance of each ribbon pixel (layer > 0) to the outer edge: pixels of the first
    layer beside one that is no ribbon. Depths beyond reach are null, as no edge is looked for there."""
    ribbon = pixels.where(F.col(layer) > 0).select(key, F.col(y).alias("_y"), F.col(x).alias("_x"), layer)
    beside = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    asked = ribbon.where(F.col(layer) == 1).withColumn("_s", beside).select(key, "_y", "_x", (F.col("_y") + F.col("_s.a")).alias("_by"), (F.col("_x") + F.col("_s.b")).alias("_bx"))
    other = ribbon.select(key, F.col("_y").alias("_by"), F.col("_x").alias("_bx"))
    # beside means inside the image
    image = pixels.select(key, F.col(y).alias("_by"), F.col(x).alias("_bx"))
    edge = asked.join(image, [key, "_by", "_bx"], "left_semi").join(other, [key, "_by", "_bx"], "left_anti").select(key, "_y", "_x").distinct()
    place = lambda rows, n: rows.select(key, F.struct(key, "_y", "_x").alias(n), (F.col("_y") * spacing).alias("_a"), (F.col("_x") * spacing).alias("_b"))
    near = neighbours(place(ribbon, "_p"), place(edge, "_e"), "_p", "_e", ["_a", "_b"], 1, reach, [key])
    found = near.select(F.col(f"_p.{key}").alias(key), F.col("_p._y").alias("_y"), F.col("_p._x").alias("_x"), F.round("distance", 6).alias("depth"))
    return ribbon.join(found, [key, "_y", "_x"], "left").select(key, F.col("_y").alias(y), F.col("_x").alias(x), layer, "depth")


_IMAGE = {"s": "l_linenumber", "y": "l_partkey % 30", "x": "l_orderkey % 40", "d": "l_extendedprice / 100000", "e": "l_discount"}
_DOTS = {"k": "c_custkey % 2", "y": "(c_custkey * 7) % 31", "x": "(c_custkey * 3) % 17"}
_LAYER = {"s": "p_size % 3", "y": "p_partkey % 20", "x": "CAST(floor(p_partkey / 20) AS BIGINT) % 30", "l": "CASE WHEN (p_partkey % 20 + p_size) % 7 < 2 THEN 0 WHEN p_partkey % 20 < 8 THEN 1 ELSE 2 END"}


def _image(s, d):
    return made(s, d, "lineitem", _IMAGE).groupBy("s", "y", "x").agg(F.max("d").alias("d"), F.max("e").alias("e"))


def _ribbon(s, d):
    rows = made(s, d, "part", _LAYER).groupBy("s", "y", "x").agg(F.max("l").alias("l"))
    return ribbon_depth(rows, "s", "y", "x", "l", 10.0, 45.0)


QUERIES = {
    "otsu_threshold": lambda s, d: otsu(made(s, d, "lineitem", {"g": "l_returnflag", "v": "l_extendedprice / 1000 + CASE l_linenumber % 2 WHEN 0 THEN 60.0 ELSE 0.0 END"}), "g", "v", 64).withColumn("threshold", F.round("threshold", 6)),
    "pixel_parts": lambda s, d: components(made(s, d, "customer", _DOTS), ["k"], "y", "x", False),
    "either_mask": lambda s, d: either_mask(_image(s, d), "s", "y", "x", "d", "e"),
    "ribbon_depth": _ribbon,
}


def _otsu_sql(source: str, group: str, value: str, bins: int, name: str) -> str:
    return f"""{name} AS (WITH e AS (SELECT {group} AS g, min({value}) AS a, max({value}) AS b FROM {source} GROUP BY 1), c AS (SELECT e.g, a, b, least({bins - 1}, CAST(floor(({value} - a) / ((b - a) / {bins})) AS INT)) AS k, count(*) AS n FROM {source} t JOIN e ON e.g = t.{group} WHERE b > a GROUP BY ALL),
      m AS (SELECT g, k, a + (k + 0.5::DOUBLE) * ((b - a) / {bins}) AS m, n FROM c), w AS (SELECT g, k, m, sum(n) OVER o AS n0, sum(n * m) OVER o AS s0, sum(n) OVER (PARTITION BY g) AS n, sum(n * m) OVER (PARTITION BY g) AS s FROM m WINDOW o AS (PARTITION BY g ORDER BY k)),
      v AS (SELECT g, k, m, round(n0 * (n - n0) * (s0 / n0 - (s - s0) / (n - n0)) ** 2, 6) AS v FROM w WHERE n0 < n) SELECT e.g, (SELECT arg_max(m, (v, -k)) FROM v WHERE v.g = e.g) AS threshold FROM e)"""


SQL = {
    "otsu_threshold": f"WITH t AS (SELECT l_returnflag AS g, l_extendedprice / 1000 + CASE l_linenumber % 2 WHEN 0 THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM lineitem), {_otsu_sql('t', 'g', 'v', 64, 'o')} SELECT g, round(threshold, 6) AS threshold FROM o",
    "pixel_parts": f"""WITH RECURSIVE p AS (SELECT DISTINCT k, y, x FROM {made_sql('customer', _DOTS)}), r(k, y, x, ry, rx) AS (SELECT k, y, x, y, x FROM p UNION SELECT p.k, p.y, p.x, r.ry, r.rx FROM r JOIN p ON p.k = r.k AND abs(p.y - r.y) + abs(p.x - r.x) = 1), m AS (SELECT k, y, x, min((ry, rx)) AS m FROM r GROUP BY 1, 2, 3)
      SELECT k, y, x, m[1] || ',' || m[2] AS part FROM m""",
    "either_mask": f"WITH t AS (SELECT s, y, x, max(d) AS d, max(e) AS e FROM {made_sql('lineitem', _IMAGE)} GROUP BY 1, 2, 3), {_otsu_sql('t', 's', 'd', 256, 'o')}, {_otsu_sql('t', 's', 'e', 256, 'q')} SELECT s, y, x FROM t JOIN o ON o.g = s JOIN q ON q.g = s WHERE d > o.threshold OR e > q.threshold",
    "ribbon_depth": f"""WITH i AS (SELECT s, y, x, max(l) AS l FROM {made_sql('part', _LAYER)} GROUP BY 1, 2, 3), e AS (SELECT DISTINCT a.s, a.y, a.x FROM i a JOIN i b ON a.s = b.s AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.l = 0 WHERE a.l = 1)
      SELECT i.s, i.y, i.x, i.l, round(min(sqrt((i.y - e.y) * (i.y - e.y) * 100.0::DOUBLE + (i.x - e.x) * (i.x - e.x) * 100.0::DOUBLE)) FILTER (WHERE sqrt((i.y - e.y) * (i.y - e.y) * 100.0::DOUBLE + (i.x - e.x) * (i.x - e.x) * 100.0::DOUBLE) <= 45), 6) AS depth FROM i LEFT JOIN e ON e.s = i.s WHERE i.l > 0 GROUP BY 1, 2, 3, 4""",
}
