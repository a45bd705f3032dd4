"""Which rows are taken: orders, firsts with and without ties, lists taken apart, states of planes, and plans of work."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.plans import made

#: States of a plane's labels.
LABELED, VALID_EMPTY, UNAVAILABLE, INFERRED = "LABELED", "VALID_EMPTY", "UNAVAILABLE", "INFERRED"
#: Bytes of fixed workspace, and of the least reserve.
WORKSPACE, LEAST_RESERVE = 64 * 1024**2, 1024**3


def ranked(rows: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """rows with their place in an order of several keys (name, descending), as a sort with a fresh index gives it. The
    places come from range-sorted rows, so no task holds them all."""
    from lamella.plans.prefix import running

    keys = [-F.col(c) if descending else F.col(c) for c, descending in order]
    return running(rows, [], keys, {"_before": F.lit(1)}).withColumn("place", (F.col("_before") + 1).cast("long")).drop("_before")


def most_common(rows: DataFrame, groups: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group (ties: the smaller), with their counts and places."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("n").desc(), value))).where(F.col("place") <= n)


def slice_ties(rows: DataFrame, groups: list[str], value: str, n: int, largest: bool = False) -> DataFrame:
    """The rows of the n least (or largest) values of each group, and all that tie with the last of them."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    return rows.where(F.col(value).isNotNull()).withColumn("_r", F.rank().over(Window.partitionBy(*groups).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def nearest_candidate(rows: DataFrame, key: str, value: str, quantile: float, score: str, below: float, done: DataFrame) -> DataFrame:
    """One row: of those not done and with a score below a limit, the one whose value is nearest to a quantile of all
    (ties: the smaller key)."""
    target = rows.agg(F.percentile(value, F.lit(quantile)).alias("_t"))
    open_ = rows.where(F.col(score) < below).join(done.select(key), key, "left_anti").crossJoin(target)
    best = open_.agg(F.min(F.struct(F.round(F.abs(F.col(value) - F.col("_t")), 9).alias("d"), F.col(key).alias("k"), F.col(value).alias("v"))).alias("b"))
    return best.where("b IS NOT NULL").select(F.col("b.k").alias(key), F.col("b.v").alias(value))


def first_names(rows: DataFrame, order: str, name: str, n: int = 5000) -> DataFrame:
    """The distinct names of the first n rows (by order), in the order in which they first come."""
    head = rows.orderBy(order).limit(n)
    firsts = head.groupBy(name).agg(F.min(order).alias("_f"))
    return firsts.withColumn("place", F.row_number().over(Window.orderBy("_f", name))).drop("_f")  # n rows at most


def separated(rows: DataFrame, column: str, sign: str, names: Sequence[str]) -> DataFrame:
    """rows with a column's parts in columns of their own; missing parts are null, further ones stay in the last."""
    parts = F.split(F.col(column), sign, len(names))
    return rows.select(*(c for c in rows.columns if c != column), *(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))


def unnested(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each element of a list, with its place; rows with an empty or no list stay, with nulls."""
    return rows.select(*(c for c in rows.columns if c != column), F.posexplode_outer(column).alias("place", name))


def endpoint_pairs(anchors: DataFrame, group: str, place: str, state: str) -> DataFrame:
    """(left, right, groups): consecutive places of a group that are labelled or validly empty; the groups that share a
    pair, in order."""
    usable = anchors.where(F.col(state).isin(LABELED, VALID_EMPTY)).select(group, place).distinct()
    pairs = usable.withColumn("right", F.lead(place).over(Window.partitionBy(group).orderBy(place))).where("right IS NOT NULL")
    return pairs.groupBy(F.col(place).alias("left"), "right").agg(F.array_join(F.sort_array(F.collect_set(group)), ",").alias("groups"))


def plane_states(planes: DataFrame, observed: DataFrame, inferred: DataFrame, key: list[str], labels: str, known: DataFrame) -> DataFrame:
    """(key, state) of each plane: what was observed, validly empty or labelled, wins over what was inferred; others are
    unavailable. observed, inferred: (key, labels), a list of label ids. An observed or inferred plane that isn't one of
    planes fails, and so does a label that isn't known (id)."""
    ids = observed.select(*key, F.explode(labels).alias("id")).union(inferred.select(*key, F.explode(labels).alias("id")))
    unknown = ids.join(known.select("id"), "id", "left_anti").select(F.raise_error(F.concat(F.lit("unknown label "), F.col("id").cast("string"))).cast("string").alias("e"))
    strange = observed.select(*key).union(inferred.select(*key)).join(planes, key, "left_anti").select(F.raise_error(F.concat(F.lit("no such plane "), F.concat_ws("/", *key))).cast("string").alias("e"))
    # both checks yield no rows, or fail
    checks = unknown.union(strange).agg(F.count("e").alias("_c"))
    o = observed.select(*key, F.when(F.size(labels) > 0, LABELED).otherwise(VALID_EMPTY).alias("_o"))
    i = inferred.select(*key, F.lit(INFERRED).alias("_i")).distinct()
    return planes.join(o, key, "left").join(i, key, "left").crossJoin(checks).where("_c >= 0").select(*key, F.coalesce("_o", "_i", F.lit(UNAVAILABLE)).alias("state"))


def decoded_channels(active: DataFrame, group: str, pixel: list[str], label: str) -> DataFrame:
    """(group, pixel, label) of the active channels; a pixel with two active channels of one group fails, naming it."""
    per = active.groupBy(group, *pixel).agg(F.count("*").alias("_n"), F.min(label).alias(label))
    named = F.concat_ws("/", group, *pixel)
    return per.select(group, *pixel, F.when(F.col("_n") == 1, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("several labels at "), named)).cast("bigint")).alias(label))


def canvas_audit(sections: DataFrame, section: str, height: str, width: str, spacing: float) -> DataFrame:
    """(section, margin_y, margin_x, fits): each present section against the common canvas: the 95 % quantile of all
    slots' sizes, absent ones counting as 0, times 1.01 and cut to whole pixels."""
    size = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    canvas = sections.agg(*(F.floor(F.percentile(size(c), F.lit(0.95)) * 1.01).alias(n) for c, n in ((height, "_h"), (width, "_w"))))
    present = sections.where(F.col(height).isNotNull()).crossJoin(canvas)
    margin = lambda c, n: (F.col(n) - F.col(c)) * F.lit(spacing)
    out = present.select(section, margin(height, "_h").alias("margin_y"), margin(width, "_w").alias("margin_x"))
    return out.withColumn("fits", (F.col("margin_y") >= -1e-8) & (F.col("margin_x") >= -1e-8))


def memory_score(channels: Column, height: Column, width: Column, grid: Column, nt: int, itemsize: int = 4, depth: int = 5) -> Column:
    """A closed form for the bytes that a pair's solve takes: endpoint images, their slabs, the inner solve, trajectories,
    transforms, velocities and fixed workspace."""
    pixels = height * width
    image = channels * pixels * itemsize
    slab = image * depth
    velocity = grid * (3 * nt * itemsize)
    return 2 * image + 2 * slab + 12 * slab + 2 * (nt + 1) * image + 8 * (nt + 1) * pixels * itemsize + 6 * velocity + WORKSPACE


def device_triage(pairs: DataFrame, gpu: DataFrame, cpu: DataFrame, key: str, score: str, channels: str, capacity: float, slope: float, start: float, above: float, margin: float = 1.15) -> DataFrame:
    """(key, device, reason): by a matching pilot's outcome first, then by the fitted bound against the capacity less its
    reserve (15 % or a gibibyte); pairs without channels need no device of their own. gpu, cpu: (key, outcome)."""
    budget = capacity - max(0.15 * capacity, float(LEAST_RESERVE))
    bound = (F.col(score) * slope + start + above) * margin
    own = pairs.join(gpu.select(key, F.col("outcome").alias("_g")), key, "left").join(cpu.select(key, F.col("outcome").alias("_c")), key, "left")
    cases = [
        ((F.col("_g") == "other-failure") & (F.col("_c") == "success"), "cpu", "gpu failed, cpu succeeded"), (F.col("_g") == "other-failure", "unresolved", "gpu failed, no cpu success"),
        (F.col("_g") == "oom", "cpu", "pilot out of memory"), (bound > budget, "cpu", "bound exceeds budget"), (F.col(channels) == 0, "cpu", "no channels"), (F.col("_g") == "success", "gpu", "pilot succeeded"),
    ]
    device, reason = F.lit("gpu"), F.lit("bound within budget")
    for when, d, r in reversed(cases):
        device, reason = F.when(when, d).otherwise(device), F.when(when, r).otherwise(reason)
    return own.select(key, device.alias("device"), reason.alias("reason"))


def plane_grid(spark: SparkSession, pitches: Sequence[float], yaws: Sequence[float], places: Sequence[float], done: DataFrame | None = None) -> DataFrame:
    """(pitch, yaw, y): the grid of planes to score, less those that are done."""
    grid = spark.createDataFrame(list(itertools.product(map(float, pitches), map(float, yaws), map(float, places))), "pitch double, yaw double, y double")
    return grid if done is None else grid.join(done.select("pitch", "yaw", "y"), ["pitch", "yaw", "y"], "left_anti")


def scan_noise(scores: DataFrame, plane: list[str], kind: str, score: str) -> DataFrame:
    """One row: the median over planes of the deviation between kinds, and the planes that lie within it of the best."""
    per = scores.groupBy(*plane).agg(F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s"))
    level = per.agg(F.percentile("_s", F.lit(0.5)).alias("noise"), F.min("_m").alias("best"))
    return per.crossJoin(level).groupBy(F.round("noise", 6).alias("noise"), F.round("best", 6).alias("best")).agg(F.count(F.when(F.col("_m") <= F.col("best") + F.col("noise"), 1)).alias("within"))


def transform_graph(edges: DataFrame, source: str, target: str, residual: str, good: float, fair: float) -> DataFrame:
    """(node, edges, status): each frame of a graph of transforms with its number of transforms and the best status among
    them by their residual: good, fair or poor."""
    both = edges.select(F.col(source).alias("node"), residual).union(edges.select(F.col(target), residual))
    low = F.min(residual)
    return both.groupBy("node").agg(F.count("*").alias("edges"), F.when(low <= good, "good").when(low <= fair, "fair").otherwise("poor").alias("status"))


def merged_config(base: dict, profile: dict, required: Sequence[str] = ()) -> dict:
    """base with a profile's values over it, level by level; lists of one element stand for the element wherever they are
    nested, and missing required keys fail."""

    def plain(value):
        while isinstance(value, list) and len(value) == 1:
            value = value[0]
        return {k: plain(v) for k, v in value.items()} if isinstance(value, dict) else [plain(v) for v in value] if isinstance(value, list) else value

    def over(a, b):
        return {k: over(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in a | b} if isinstance(a, dict) and isinstance(b, dict) else b

    out = plain(over(base, profile))
    if missing := [k for k in required if k not in out]:
        raise ValueError(f"missing: {missing}")
    return out


def without(value, names: frozenset[str]):
    if isinstance(value, dict):
        return {k: without(v, names) for k, v in value.items() if k not in names}
    return [without(v, names) for v in value] if isinstance(value, list) else value


def drifted(listed: dict, kept: dict, accepted: str | None = None, times: Sequence[str] = ("retrieved_at", "timestamp")) -> bool:
    """Whether two inventories differ but for their timestamps, unless the listed one has the accepted digest."""
    canonical = lambda v: json.dumps(without(v, frozenset(times)), sort_keys=True, separators=(",", ":"))
    return canonical(listed) != canonical(kept) and hashlib.sha256(canonical(listed).encode()).hexdigest() != accepted




def _anchors(s, d):
    rows = made(s, d, "lineitem", {"g": "l_returnflag", "place": "l_partkey % 60", "k": "l_orderkey"}).groupBy("g", "place").agg(F.min("k").alias("k"))
    return rows.selectExpr("g", "place", "CASE k % 3 WHEN 0 THEN 'LABELED' WHEN 1 THEN 'VALID_EMPTY' ELSE 'UNAVAILABLE' END AS state")


def _states(s, d):
    planes = made(s, d, "part", {"g": "p_size % 4", "z": "p_partkey"})
    observed = made(s, d, "part", {"g": "p_size % 4", "z": "p_partkey", "k": "p_partkey % 5"}).where("k < 2").select("g", "z", F.when(F.col("k") == 0, F.array(F.col("g").cast("int"), F.lit(7))).otherwise(F.array().cast("array<int>")).alias("labels"))
    inferred = made(s, d, "part", {"g": "p_size % 4", "z": "p_partkey", "k": "p_partkey % 3"}).where("k = 0").select("g", "z", F.array(F.lit(3)).alias("labels"))
    known = s.range(8).select(F.col("id").cast("int").alias("id"))
    return plane_states(planes, observed, inferred, ["g", "z"], "labels", known)


def _triage(s, d):
    pairs = made(s, d, "part", {"k": "p_partkey", "score": "p_retailprice * 20000000", "channels": "p_size % 6"})
    pilots = made(s, d, "part", {"k": "p_partkey", "outcome": "CASE p_partkey % 40 WHEN 0 THEN 'oom' WHEN 1 THEN 'success' WHEN 2 THEN 'other-failure' WHEN 3 THEN 'other-failure' ELSE 'none' END"}).where("outcome <> 'none'")
    return device_triage(pairs, pilots, made(s, d, "part", {"k": "p_partkey", "outcome": "'success'", "m": "p_partkey % 40"}).where("m = 2").drop("m"), "k", "score", "channels", 32e9, 1.0, 1e9, 2e8)


QUERIES = {
    "multi_key_order": lambda s, d: ranked(made(s, d, "part", {"k": "p_partkey", "a": "p_size", "b": "p_retailprice"}), [("a", True), ("b", True), ("k", False)]).select("k", "place"),
    "most_common": lambda s, d: most_common(made(s, d, "orders", {"g": "o_orderpriority", "v": "o_custkey % 23"}), ["g"], "v", 5),
    "slice_ties": lambda s, d: slice_ties(made(s, d, "lineitem", {"g": "l_returnflag", "id": "l_orderkey", "v": "l_quantity"}), ["g"], "v", 3, True),
    "nearest_candidate": lambda s, d: nearest_candidate(made(s, d, "part", {"k": "p_partkey", "v": "p_size", "sc": "p_retailprice"}), "k", "v", 0.75, "sc", 950.0, made(s, d, "part", {"k": "p_partkey * 3"})),
    "first_names": lambda s, d: first_names(made(s, d, "orders", {"o": "o_orderkey", "n": "o_custkey % 40"}), "o", "n", 300),
    "separated": lambda s, d: separated(made(s, d, "part", {"k": "p_partkey", "t": "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ':' || p_type ELSE p_brand || ':' || p_type || ':' || p_name END"}), "t", ":", ["a", "b"]),
    "unnested": lambda s, d: unnested(made(s, d, "part", {"k": "p_partkey", "t": "p_name"}).withColumn("t", F.when(F.col("k") % 4 > 0, F.split("t", " "))), "t", "word"),
    "endpoint_pairs": lambda s, d: endpoint_pairs(_anchors(s, d), "g", "place", "state"),
    "plane_states": _states,
    "decoded_channels": lambda s, d: decoded_channels(made(s, d, "lineitem", {"g": "l_returnflag", "y": "l_orderkey % 40", "x": "l_linenumber", "l": "l_orderkey % 40 + l_linenumber * 100"}).distinct(), "g", ["y", "x"], "l"),
    "canvas_audit": lambda s, d: canvas_audit(made(s, d, "part", {"k": "p_partkey", "h": "CASE p_partkey % 7 WHEN 0 THEN NULL ELSE 100 + p_size END", "w": "CASE p_partkey % 7 WHEN 0 THEN NULL ELSE 80 + p_size * 2 END"}), "k", "h", "w", 25.0),
    "memory_score": lambda s, d: made(s, d, "part", {"k": "p_partkey", "c": "p_size % 9", "h": "100 + p_size", "w": "200 + p_size", "g": "CAST(5 * (60 + p_size) * (90 + p_size) AS BIGINT)"}).select("k", memory_score(F.col("c").cast("long"), F.col("h").cast("long"), F.col("w").cast("long"), F.col("g"), 10).alias("bytes")),
    "device_triage": _triage,
    "plane_grid": lambda s, d: plane_grid(s, [-10, 0, 10], [-5, 5], range(4), made(s, d, "nation", {"pitch": "CAST(n_nationkey % 3 * 10 AS DOUBLE)", "yaw": "5.0", "y": "CAST(n_regionkey AS DOUBLE)"})),
    "scan_noise": lambda s, d: scan_noise(made(s, d, "lineitem", {"p": "l_suppkey", "k": "l_linenumber", "v": "l_discount"}).groupBy("p", "k").agg(F.avg("v").alias("v")), ["p"], "k", "v"),
    "transform_graph": lambda s, d: transform_graph(made(s, d, "orders", {"a": "o_custkey % 20", "b": "o_orderkey % 20", "r": "o_totalprice / 1000"}), "a", "b", "r", 2.0, 5.0),
}
SQL = {
    "multi_key_order": "SELECT p_partkey AS k, row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS place FROM part",
    "most_common": "SELECT g, v, n, CAST(place AS INT) AS place FROM (SELECT o_orderpriority AS g, o_custkey % 23 AS v, count(*) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey % 23) AS place FROM orders GROUP BY 1, 2) WHERE place <= 5",
    "slice_ties": "SELECT l_returnflag AS g, l_orderkey AS id, l_quantity AS v FROM lineitem QUALIFY rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) <= 3",
    "nearest_candidate": "SELECT p_partkey AS k, p_size AS v FROM part WHERE p_retailprice < 950 AND p_partkey NOT IN (SELECT p_partkey * 3 FROM part) ORDER BY round(abs(p_size - (SELECT quantile_cont(p_size, 0.75) FROM part)), 9), p_partkey LIMIT 1",
    "first_names": "SELECT n, CAST(row_number() OVER (ORDER BY f, n) AS INT) AS place FROM (SELECT o_custkey % 40 AS n, min(o_orderkey) AS f FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 300) GROUP BY 1)",
    "separated": "SELECT p_partkey AS k, p_brand AS a, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_type ELSE p_type || ':' || p_name END AS b FROM part",
    "unnested": "SELECT k, CASE WHEN word IS NOT NULL THEN CAST(i - 1 AS INT) END AS place, word FROM (SELECT p_partkey AS k, unnest(generate_series(1, greatest(1, len(w)))) AS i, unnest(w) AS word FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN string_split(p_name, ' ') ELSE [NULL] END AS w FROM part))",
    "endpoint_pairs": "WITH a AS (SELECT l_returnflag AS g, l_partkey % 60 AS place FROM lineitem GROUP BY 1, 2 HAVING min(l_orderkey) % 3 < 2), p AS (SELECT g, place, lead(place) OVER (PARTITION BY g ORDER BY place) AS r FROM a) SELECT place AS \"left\", r AS \"right\", string_agg(DISTINCT g, ',' ORDER BY g) AS groups FROM p WHERE r IS NOT NULL GROUP BY 1, 2",
    "plane_states": "SELECT p_size % 4 AS g, p_partkey AS z, CASE WHEN p_partkey % 5 = 0 THEN 'LABELED' WHEN p_partkey % 5 = 1 THEN 'VALID_EMPTY' WHEN p_partkey % 3 = 0 THEN 'INFERRED' ELSE 'UNAVAILABLE' END AS state FROM part",
    "decoded_channels": "SELECT DISTINCT l_returnflag AS g, l_orderkey % 40 AS y, l_linenumber AS x, l_orderkey % 40 + l_linenumber * 100 AS l FROM lineitem",
    "canvas_audit": "WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 > 0 THEN 100 + p_size END AS h, CASE WHEN p_partkey % 7 > 0 THEN 80 + p_size * 2 END AS w FROM part), c AS (SELECT floor(quantile_cont(coalesce(h, 0), 0.95) * 1.01::DOUBLE) AS ch, floor(quantile_cont(coalesce(w, 0), 0.95) * 1.01::DOUBLE) AS cw FROM s) SELECT k, (ch - h) * 25.0::DOUBLE AS margin_y, (cw - w) * 25.0::DOUBLE AS margin_x, ch >= h AND cw >= w AS fits FROM s, c WHERE h IS NOT NULL",
    "memory_score": "WITH p AS (SELECT p_partkey AS k, (p_size % 9)::BIGINT * (100 + p_size) * (200 + p_size) * 4 AS im, (100 + p_size)::BIGINT * (200 + p_size) AS px, 5::BIGINT * (60 + p_size) * (90 + p_size) AS g FROM part) SELECT k, 2 * im + 10 * im + 60 * im + 22 * im + 88 * px * 4 + 6 * g * 120 + 67108864 AS bytes FROM p",
    "device_triage": """WITH p AS (SELECT p_partkey AS k, p_partkey % 40 AS m, (p_retailprice * 20000000 + 1e9 + 2e8) * 1.15 > 32e9 - 4.8e9 AS big, p_size % 6 AS c FROM part) SELECT k, CASE WHEN m = 2 OR m = 0 THEN 'cpu' WHEN m = 3 THEN 'unresolved' WHEN big OR c = 0 THEN 'cpu' ELSE 'gpu' END AS device,
      CASE WHEN m = 2 THEN 'gpu failed, cpu succeeded' WHEN m = 3 THEN 'gpu failed, no cpu success' WHEN m = 0 THEN 'pilot out of memory' WHEN big THEN 'bound exceeds budget' WHEN c = 0 THEN 'no channels' WHEN m = 1 THEN 'pilot succeeded' ELSE 'bound within budget' END AS reason FROM p""",
    "plane_grid": "SELECT * FROM (VALUES (-10.0::DOUBLE), (0.0::DOUBLE), (10.0::DOUBLE)) a(pitch), (VALUES (-5.0::DOUBLE), (5.0::DOUBLE)) b(yaw), (SELECT CAST(i AS DOUBLE) AS y FROM range(0, 4) r(i)) EXCEPT SELECT CAST(n_nationkey % 3 * 10 AS DOUBLE), 5.0::DOUBLE, CAST(n_regionkey AS DOUBLE) FROM nation",
    "scan_noise": "WITH k AS (SELECT l_suppkey AS p, l_linenumber, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT p, avg(v) AS m, stddev_samp(v) AS s FROM k GROUP BY 1), l AS (SELECT quantile_cont(s, 0.5) AS noise, min(m) AS best FROM m) SELECT round(noise, 6) AS noise, round(best, 6) AS best, count(*) FILTER (WHERE m <= best + noise) AS within FROM m, l GROUP BY noise, best",
    "transform_graph": "WITH e AS (SELECT o_custkey % 20 AS node, o_totalprice / 1000 AS r FROM orders UNION ALL SELECT o_orderkey % 20, o_totalprice / 1000 FROM orders) SELECT node, count(*) AS edges, CASE WHEN min(r) <= 2 THEN 'good' WHEN min(r) <= 5 THEN 'fair' ELSE 'poor' END AS status FROM e GROUP BY 1",
}
