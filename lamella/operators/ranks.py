"""Ranks, shares and step-up rules, always inside a group, with stated rules for ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions.text import right_closed_bin, support_band
from lamella.plans import table
from lamella.plans.prefix import average_ranks, kept, running


def average_rank(value: str, groups: list[str]) -> Column:
    """Ties share the mean of their places; for groups that are small by kind (``average_ranks`` is for any)."""
    least = F.rank().over(Window.partitionBy(*groups).orderBy(value))
    return least + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / F.lit(2.0)


def spearman(rows: DataFrame, groups: list[str], x: str, y: str, least: int = 0) -> DataFrame:
    """Pearson's correlation of average ranks, and how many rows it rests on; null below least rows."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, x, y)
    # pairs of values are counted first, so that equal ones rank once
    pairs = kept(known.groupBy(*groups, x, y).agg(F.count("*").alias("w")))
    ranked = pairs.join(value_ranks(pairs, groups, x, "w", "rx"), [*groups, x]).join(value_ranks(pairs, groups, y, "w", "ry"), [*groups, y])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    s = ranked.groupBy(*groups).agg(F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * rx).alias("xx"), F.sum(w * ry * ry).alias("yy"), F.sum(w * rx * ry).alias("xy"))
    n = F.col("n")
    spread = (F.col("xx") - F.col("sx") ** 2 / n) * (F.col("yy") - F.col("sy") ** 2 / n)
    return s.select(*groups, "n", F.when((spread > 0) & (n >= least), F.round((F.col("xy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread), 6)).alias("rho"))


def value_ranks(counted: DataFrame, groups: list[str], value: str, count: str, name: str) -> DataFrame:
    """(groups, value, name): the average rank of each value inside its group, from rows that stand for count rows each."""
    values = counted.groupBy(*groups, value).agg(F.sum(count).alias("_k"))
    return running(values, groups, [value], {"_before": "_k"}).select(*groups, value, (F.col("_before") + (F.col("_k") + 1) / F.lit(2.0)).alias(name))


def within_between(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with the group's mean, the deviation from it, and the z-score by the sample deviation (null at 0)."""
    w = Window.partitionBy(group)
    mean, sd = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return rows.withColumn("between", F.round(mean, 6)).withColumn("within", F.round(F.col(value) - mean, 6)).withColumn("z", F.round(F.when(sd > 0, (F.col(value) - mean) / sd), 6))


def cumulative_share(rows: DataFrame, group: str, order: list[str], amount: str) -> DataFrame:
    """rows with their place and the share of the group's amount up to and with them; it ends at 1."""
    w = Window.partitionBy(group)
    upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(amount).over(w)
    return rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("share", F.round(F.when(total != 0, F.sum(amount).over(upto) / total), 6))


def adjacent_pairs(rows: DataFrame, group: str, anchor: str) -> DataFrame:
    """Consecutive distinct anchors of each group, and the gap between them."""
    w = Window.partitionBy(group).orderBy(anchor)
    return rows.select(group, anchor).distinct().withColumn("next", F.lead(anchor).over(w)).where("next IS NOT NULL").withColumn("gap", F.col("next") - F.col(anchor))


def benjamini_hochberg(rows: DataFrame, family: str, p: str, order: str) -> DataFrame:
    """q of the step-up rule inside each family: running minimum of p * n / rank from the largest p down. Places count
    from the end, so that ranks and minima run the same way, over range-sorted rows."""
    n = rows.groupBy(family).agg(F.count("*").alias("_n"))
    placed = running(rows.join(n, family), [family], [-F.col(p), -F.col(order)], {"_after": F.lit(1)})
    rank = F.col("_n") - F.col("_after")
    low = running(placed.withColumn("_m", F.col(p) * F.col("_n") / rank), [family], ["_after"], {}, {"_q": "_m"})
    return low.withColumn("q", F.round(F.least(F.lit(1.0), F.col("_q")), 6)).drop("_n", "_after", "_m", "_q")


def collision_rank(rows: DataFrame, key: list[str], distance: str, section: str, label: str) -> DataFrame:
    """One row a key: the label with the least (distance, section), how many agree and how many don't."""
    best = F.min(F.struct(distance, section, label))
    won = rows.groupBy(*key).agg(best.alias("b"), F.count("*").alias("candidates"))
    same = rows.join(won.select(*key, F.col(f"b.{label}").alias("label")), key).groupBy(*key, "label").agg(F.sum(F.when(F.col(label) == F.col("label"), 1).otherwise(0)).alias("same"))
    return same.join(won.select(*key, "candidates"), key).withColumn("conflicting", F.col("candidates") - F.col("same"))


def boundaries(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Midway between each group's largest value and the next group's smallest, in the order of groups. The table of
    groups is small by kind."""
    ends = rows.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return ends.withColumn("boundary", F.round((F.col("hi") + F.lead("lo").over(Window.orderBy(group))) / 2, 6)).select(group, "boundary")


def tertiles(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Two rules that differ: equal counts, and cuts at the quantiles (linear between the two nearest places)."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    placed = running(rows.join(n, group), [group], [value, order], {"_place": F.lit(1)})
    third, rest = F.floor(F.col("_n") / 3), F.col("_n") % 3
    # the first `rest` parts have one row more
    wide = rest * (third + 1)
    by_count = F.when(F.col("_place") < wide, F.floor(F.col("_place") / (third + 1))).otherwise(rest + F.floor((F.col("_place") - wide) / F.greatest(third, F.lit(1)))) + 1
    ends = placed.groupBy(group).agg(*(F.max(F.when(F.col("_place") == f((F.col("_n") - 1) * F.lit(q)), F.col(value))).alias(f"_{side}{i}") for i, q in enumerate((1 / 3, 2 / 3)) for side, f in (("lo", F.floor), ("hi", F.ceil))), F.max("_n").alias("_m"))
    at = lambda i, q: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * ((F.col("_m") - 1) * F.lit(q) - F.floor((F.col("_m") - 1) * F.lit(q)))
    cuts = ends.select(group, at(0, 1 / 3).alias("_c0"), at(1, 2 / 3).alias("_c1"))
    by_cut = F.lit(1) + sum((F.when(F.col(value) >= F.col(c), 1).otherwise(0) for c in ("_c0", "_c1")), F.lit(0))
    return placed.join(cuts, group).withColumn("by_count", by_count.cast("int")).withColumn("by_cut", by_cut).drop("_n", "_place", "_c0", "_c1")


def _orders(s, d):
    return table(s, d, "orders")


def _few(s, d):
    return _orders(s, d).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def _bands(s, d):
    counted = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n"))
    edges = [0, 2, 5, 10, 20, 50, 100, 200, 500, 1e18]
    return counted.select("l_suppkey", "n", support_band(F.col("n")).alias("band"), right_closed_bin(F.col("n"), edges).alias("bin"))


def _tests(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("test"), ((F.col("l_tax") + 0.001) * (F.col("l_discount") + 0.01) * F.col("l_quantity") / 50).alias("p"))


def _voxels(s, d):
    return table(s, d, "events").select((F.col("user_id") % 97).alias("voxel"), F.round(F.abs("value"), 1).alias("distance"), F.col("event_id").alias("section"), F.col("event_type").alias("state"))


QUERIES = {
    "avg_rank": lambda s, d: average_ranks(_few(s, d), ["o_orderpriority"], "o_totalprice", "rank").select("o_orderkey", "rank"),
    "spearman_by_group": lambda s, d: spearman(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice"),
    "within_between": lambda s, d: within_between(_few(s, d), "o_custkey", "o_totalprice"),
    "cumulative_share": lambda s, d: cumulative_share(_few(s, d), "o_custkey", ["o_totalprice", "o_orderkey"], "o_totalprice").select("o_orderkey", "place", "share"),
    "adjacent_pairs": lambda s, d: adjacent_pairs(_few(s, d), "o_custkey", "o_orderkey"),
    "bh_fdr": lambda s, d: benjamini_hochberg(_tests(s, d), "l_returnflag", "p", "test").select("test", "q"),
    "collision_resolve": lambda s, d: collision_rank(_voxels(s, d), ["voxel"], "distance", "section", "state"),
    "support_bands": _bands,
    "group_boundaries": lambda s, d: boundaries(_few(s, d), "o_orderpriority", "o_totalprice"),
    "tertile_rules": lambda s, d: tertiles(_few(s, d), "o_orderpriority", "o_totalprice", "o_orderkey").select("o_orderkey", "by_count", "by_cut"),
    "dense_rank_score": lambda s, d: table(s, d, "part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.round("p_retailprice", 2).desc())).alias("place")),
}
SQL = {
    "avg_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rank FROM orders",
    "spearman_by_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_linestatus, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem) GROUP BY 1, 2",
    "within_between": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, round(avg(o_totalprice) OVER w, 6) AS \"between\", round(o_totalprice - avg(o_totalprice) OVER w, 6) AS within, round(CASE WHEN stddev_samp(o_totalprice) OVER w > 0 THEN (o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w END, 6) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "cumulative_share": "SELECT o_orderkey, row_number() OVER w AS place, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    "adjacent_pairs": "SELECT o_custkey, o_orderkey, next, next - o_orderkey AS gap FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)) WHERE next IS NOT NULL",
    "bh_fdr": "WITH t AS (SELECT l_returnflag, l_orderkey * 8 + l_linenumber AS test, (l_tax + 0.001::DOUBLE) * (l_discount + 0.01::DOUBLE) * l_quantity / 50 AS p FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY p, test) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM t) SELECT test, round(least(1.0, min(p * n / r) OVER (PARTITION BY l_returnflag ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r",
    "collision_resolve": "WITH v AS (SELECT user_id % 97 AS voxel, round(abs(value), 1) AS distance, event_id AS section, event_type AS state FROM events), w AS (SELECT *, first_value(state) OVER (PARTITION BY voxel ORDER BY distance, section, state) AS label FROM v) SELECT voxel, label, CAST(count(*) FILTER (WHERE state = label) AS BIGINT) AS same, count(*) AS candidates, count(*) - count(*) FILTER (WHERE state = label) AS conflicting FROM w GROUP BY voxel, label",
    "support_bands": "SELECT l_suppkey, n, CASE WHEN n >= 20 THEN 'well' WHEN n >= 10 THEN 'marginal' ELSE 'low' END AS band, 1 + (n > 2)::INT + (n > 5)::INT + (n > 10)::INT + (n > 20)::INT + (n > 50)::INT + (n > 100)::INT + (n > 200)::INT + (n > 500)::INT AS bin FROM (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)",
    "group_boundaries": "SELECT o_orderpriority, round((hi + lead(lo) OVER (ORDER BY o_orderpriority)) / 2, 6) AS boundary FROM (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)",
    "tertile_rules": "WITH c AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 1.0::DOUBLE / 3) AS a, quantile_cont(o_totalprice, 2.0::DOUBLE / 3) AS b FROM orders GROUP BY 1) SELECT o_orderkey, ntile(3) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS by_count, 1 + (o_totalprice >= a)::INT + (o_totalprice >= b)::INT AS by_cut FROM orders JOIN c USING (o_orderpriority)",
    "dense_rank_score": "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 2) DESC) AS place FROM part",
}
