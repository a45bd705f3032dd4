"""Library-size factors, offsets between methods, candidate scores and linear models from moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.counts import upper_quartile
from lamella.operators.ranks import average_rank
from lamella.plans import table

#: Fixed values of the trimmed mean of log ratios.
RATIO_TRIM, SUM_TRIM = 0.3, 0.05
#: Digits that ratios are rounded to before they are ranked, so that equal ratios tie whatever the order of the sums.
RANK_DIGITS = 9


def trimmed_factors(counts: DataFrame, row: str, gene: str, count: str, ratio_trim: float = RATIO_TRIM, sum_trim: float = SUM_TRIM) -> DataFrame:
    """(row, factor): the trimmed mean of log ratios against the row whose upper quartile is nearest the mean of all
    (ties: the smallest row; a quartile of 0 counts as the mean share), scaled to a geometric mean of 1. Rows without
    counts have no factor; a row of which the trimming leaves nothing has the factor 1 before scaling.

    The reference row is one row of the matrix, so it joins by gene; ranks are taken inside each row."""
    sums = counts.groupBy(row).agg(F.sum(count).cast("double").alias("size")).where("size > 0")
    genes = counts.agg(F.countDistinct(gene).alias("genes"))
    uq = F.when(F.col("upper_quartile") > 0, F.col("upper_quartile")).otherwise(F.round(1 / F.col("genes"), RANK_DIGITS))
    quartile = upper_quartile(counts, row, gene, count).where("size > 0").crossJoin(F.broadcast(genes)).select(row, uq.alias("uq"))
    mean = quartile.agg(F.avg("uq").alias("mean"))
    chosen = quartile.crossJoin(F.broadcast(mean)).agg(F.min(F.struct(F.round(F.abs(F.col("uq") - F.col("mean")), 12), F.col(row).alias("row"))).alias("b")).select(F.col("b.row").alias(row))
    positive = counts.where(F.col(count) > 0).join(sums, row)
    other = positive.join(F.broadcast(chosen), row, "left_semi").select(gene, F.col(count).alias("rc"), F.col("size").alias("rsize"))
    both = positive.join(other, gene)
    own, ref = F.col(count) / F.col("size"), F.col("rc") / F.col("rsize")
    variance = (F.col("size") - F.col(count)) / F.col("size") / F.col(count) + (F.col("rsize") - F.col("rc")) / F.col("rsize") / F.col("rc")
    ratios = both.select(row, F.log2(own / ref).alias("m"), variance.alias("v"), F.round(F.log2(own / ref), RANK_DIGITS).alias("mk"), F.round((F.log2(own) + F.log2(ref)) / 2, RANK_DIGITS).alias("ak"))
    # genes whose ratio has no variance don't count; a row with fewer than two, or no ratio off 0, has the factor 1
    own_row = Window.partitionBy(row)
    ratios = ratios.where("v > 0").withColumn("far", F.max(F.abs("m")).over(own_row))
    n = F.count("*").over(own_row)
    ranked = ratios.withColumn("n", n).withColumn("rm", average_rank("mk", [row])).withColumn("ra", average_rank("ak", [row]))

    def inside(rank: str, trim: float) -> Column:
        low = F.floor(F.col("n") * trim) + 1
        return F.col(rank).between(low, F.col("n") + 1 - low)

    kept = ranked.where(inside("rm", ratio_trim) & inside("ra", sum_trim) & (F.col("n") >= 2) & (F.col("far") >= 1e-6))
    means = kept.groupBy(row).agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("f"))
    raw = sums.select(row).join(means, row, "left").select(row, F.coalesce("f", F.lit(0.0)).alias("f"))
    centre = raw.agg(F.avg("f").alias("centre"))
    return raw.crossJoin(F.broadcast(centre)).select(row, F.round(F.pow(F.lit(2.0), F.col("f") - F.col("centre")), 6).alias("factor"))


def chained_offsets(edges: DataFrame, first: str, second: str, shift: str, start: str, rounds: int) -> DataFrame:
    """(node, offset, steps) of every node: the sum of shifts along a shortest path from start, second minus first;
    of several the one through the smallest (node, offset) before. Unreachable nodes have nulls.

    The graph is one of methods: rounds bounds the path's length, and each round is one join with the edges."""
    there = edges.select(F.col(first).alias("a"), F.col(second).alias("b"), F.col(shift).alias("d"))
    both = there.union(edges.select(F.col(second), F.col(first), -F.col(shift)))
    nodes = both.select(F.col("a").alias("node")).distinct()
    known = nodes.select("node", F.when(F.col("node") == start, 0.0).alias("offset"), F.when(F.col("node") == start, 0).alias("steps"))
    for step in range(1, rounds + 1):
        reached = known.where(F.col("steps") == step - 1).select(F.col("node").alias("a"), "offset").join(both, "a")
        best = reached.groupBy("b").agg(F.min(F.struct("a", (F.col("offset") + F.col("d")).alias("o"))).alias("p"))
        merged = known.join(best.select(F.col("b").alias("node"), F.col("p.o").alias("o")), "node", "left")
        known = merged.select("node", F.coalesce("offset", "o").alias("offset"), F.coalesce("steps", F.when(F.col("o").isNotNull(), step)).alias("steps"))
    return known.select("node", F.round("offset", 6).alias("offset"), "steps")


def capped_score(caps: dict[str, float], weights: dict[str, float]) -> Column:
    """The weighted sum of each column over its cap, held to 0..1; weights sum to 1 and caps are 1 or more."""
    if abs(sum(weights.values()) - 1) > 1e-9 or any(c < 1 for c in caps.values()):
        raise ValueError("weights must sum to 1 and caps be 1 or more")
    return sum((F.lit(w) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(caps[c]))) for c, w in weights.items()), F.lit(0.0))


def clustered_slope(rows: DataFrame, group: str, cluster: str, x: str, y: str) -> DataFrame:
    """The slope of y on x (with an intercept) in each group, its error robust to correlation inside clusters, with the
    small-sample factor G/(G-1) * (N-1)/(N-2); null with under 2 clusters or without variation of x.

    Sums only: the moments give the slope, and one more aggregation by cluster its scores."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, cluster, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fit = known.groupBy(group).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"))
    at = known.join(fit, group).withColumn("dx", F.col("x") - F.col("mx"))
    score = F.sum(F.col("dx") * (F.col("y") - F.col("my") - F.col("sxy") / F.col("sxx") * F.col("dx")))
    per = at.groupBy(group, cluster, "n", "sxx", "sxy").agg(score.alias("u"))
    out = per.groupBy(group, "n", "sxx", "sxy").agg(F.count("*").alias("g"), F.sum(F.col("u") * F.col("u")).alias("meat"))
    g, n = F.col("g"), F.col("n")
    usable = (g > 1) & (n > 2) & (F.col("sxx") > 0)
    error = F.sqrt(F.col("meat") * (g / (g - 1)) * ((n - 1) / (n - 2))) / F.col("sxx")
    return out.select(group, "n", F.col("g").alias("clusters"), F.round(F.when(usable, F.col("sxy") / F.col("sxx")), 6).alias("slope"), F.round(F.when(usable, error), 6).alias("error"))


def within_and_between(rows: DataFrame, group: str, unit: str, x: str, y: str) -> DataFrame:
    """In each group the slope of y on x inside units (deviations from the unit's means) and between units (of the
    means, each weighted by its rows). The two parts of x are orthogonal, so each slope stands for itself."""
    w = Window.partitionBy(group, unit)
    split = rows.select(group, F.avg(x).over(w).alias("bx"), F.avg(y).over(w).alias("by"), F.col(x).alias("x"), F.col(y).alias("y"))
    split = split.withColumn("wx", F.col("x") - F.col("bx")).withColumn("wy", F.col("y") - F.col("by"))
    sxx = F.sum(F.col("wx") * F.col("wx"))
    inside = F.when(sxx > 0, F.sum(F.col("wx") * F.col("wy")) / sxx)
    between = F.when(F.regr_sxx("by", "bx") > 0, F.regr_slope("by", "bx"))
    return split.groupBy(group).agg(F.count("*").alias("n"), F.round(inside, 6).alias("inside"), F.round(between, 6).alias("between"))


def quadratic_gain(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """F of the square of x on top of x (1 and n - 3 degrees of freedom); null below 5 rows or with a perfect fit.

    The square's part that x doesn't explain is a residual of sums, so moments of deviations are enough."""
    w = Window.partitionBy(group)
    d = rows.select(group, F.col(y).cast("double").alias("y"), (F.col(x) - F.avg(x).over(w)).alias("x")).withColumn("q", F.col("x") * F.col("x"))
    s = d.groupBy(group).agg(F.count("*").alias("n"), F.regr_sxx("y", "x").alias("xx"), F.regr_sxx("y", "q").alias("qq"), F.regr_sxy("q", "x").alias("xq"), F.regr_sxy("y", "x").alias("xy"), F.regr_sxy("y", "q").alias("qy"), F.regr_syy("y", "x").alias("yy"))
    own = F.col("qq") - F.col("xq") * F.col("xq") / F.col("xx")
    shared = F.col("qy") - F.col("xq") * F.col("xy") / F.col("xx")
    gain, line = shared * shared / own, F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")
    usable = (F.col("n") >= 5) & (F.col("xx") > 0)
    return s.select(group, "n", F.round(F.when(usable & (own > 0) & (line - gain > 0), gain / ((line - gain) / (F.col("n") - 3))), 6).alias("f"))


def _matrix(s, d):
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", "p_brand").alias("gene"))
    return table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(parts, "l_partkey").groupBy("l_suppkey", "gene").agg(F.sum("l_quantity").alias("count"))


def _offsets(s, d):
    means = table(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("m")).agg(F.avg("l_extendedprice").alias("v"))
    order = Window.orderBy("m")  # six methods
    edges = means.select("m", F.lead("m").over(order).alias("next"), (F.lead("v").over(order) - F.col("v")).alias("d")).where("next IS NOT NULL AND m <> 'NF'")
    return chained_offsets(edges, "m", "next", "d", "AF", 5)


def _candidates(s, d):
    sums = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.countDistinct("o_orderpriority").alias("priorities"), (F.sum("o_totalprice") / 1e6).alias("spent"))
    score = capped_score({"orders": 15.0, "priorities": 5.0, "spent": 3.0}, {"orders": 0.5, "priorities": 0.2, "spent": 0.3})
    scored = sums.select("o_custkey", F.round(score, 6).alias("score"), "priorities")
    return scored.select("o_custkey", "score", F.when((F.col("score") >= 0.7) & (F.col("priorities") == 5), "high").when(F.col("score") >= 0.4, "medium").otherwise("low").alias("class"))


QUERIES = {
    "tmm_factor": lambda s, d: trimmed_factors(_matrix(s, d), "l_suppkey", "gene", "count"),
    "method_offsets": _offsets,
    "candidate_score": _candidates,
    "clustered_slope": lambda s, d: clustered_slope(table(s, d, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice"),
    "within_between_slopes": lambda s, d: within_and_between(table(s, d, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice"),
    "quadratic_gain": lambda s, d: quadratic_gain(table(s, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice"),
}
SQL = {
    "tmm_factor": """
WITH c AS (SELECT l_suppkey AS r, p_type || '/' || p_brand AS g, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
s AS (SELECT r, sum(y) AS size FROM c GROUP BY r HAVING sum(y) > 0),
z AS (SELECT s.r, coalesce(y, 0) / size AS p FROM s CROSS JOIN (SELECT DISTINCT g FROM c) a LEFT JOIN c ON c.r = s.r AND c.g = a.g),
u AS (SELECT r, round(CASE WHEN quantile_cont(p, 0.75) = 0 THEN avg(p) ELSE quantile_cont(p, 0.75) END, 9) AS uq FROM z GROUP BY r),
ref AS (SELECT r FROM u ORDER BY round(abs(uq - (SELECT avg(uq) FROM u)), 12), r LIMIT 1),
o AS (SELECT g, y AS ry, size AS rs FROM c JOIN s ON c.r = s.r WHERE c.r = (SELECT r FROM ref) AND y > 0),
m AS (SELECT c.r, log2((y / size) / (ry / rs)) AS m, (size - y) / size / y + (rs - ry) / rs / ry AS v, round(log2((y / size) / (ry / rs)), 9) AS mk, round((log2(y / size) + log2(ry / rs)) / 2, 9) AS ak
  FROM c JOIN s ON c.r = s.r JOIN o ON o.g = c.g WHERE y > 0),
k AS (SELECT r, m, v, count(*) OVER (PARTITION BY r) AS n, rank() OVER (PARTITION BY r ORDER BY mk) + (count(*) OVER (PARTITION BY r, mk) - 1) / 2.0 AS rm,
  rank() OVER (PARTITION BY r ORDER BY ak) + (count(*) OVER (PARTITION BY r, ak) - 1) / 2.0 AS ra FROM m),
f AS (SELECT r, sum(m / v) / sum(1 / v) AS f FROM k WHERE rm BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND ra BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) AND v > 0 GROUP BY r),
w AS (SELECT s.r, coalesce(f, 0) AS f FROM s LEFT JOIN f ON s.r = f.r)
SELECT r AS l_suppkey, round(pow(2.0, f - (SELECT avg(f) FROM w)), 6) AS factor FROM w
""",
    "method_offsets": """
WITH RECURSIVE v AS (SELECT l_returnflag || l_linestatus AS m, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1),
e AS (SELECT * FROM (SELECT m AS a, lead(m) OVER (ORDER BY m) AS b, lead(v) OVER (ORDER BY m) - v AS d FROM v) WHERE b IS NOT NULL AND a <> 'NF'),
b AS (SELECT a, b, d FROM e UNION ALL SELECT b, a, -d FROM e),
r(node, o, steps) AS (SELECT 'AF', 0.0::DOUBLE, 0 UNION ALL SELECT b.b, r.o + b.d, r.steps + 1 FROM r JOIN b ON b.a = r.node WHERE r.steps < 5),
k AS (SELECT node, arg_min(o, steps) AS o, min(steps) AS steps FROM r GROUP BY node)
SELECT n.node, round(k.o, 6) AS "offset", k.steps FROM (SELECT DISTINCT a AS node FROM b) n LEFT JOIN k ON n.node = k.node
""",
    "candidate_score": """
SELECT o_custkey, score, CASE WHEN score >= 0.7 AND p = 5 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS class FROM (
  SELECT o_custkey, count(DISTINCT o_orderpriority) AS p,
    round(0.5 * least(1.0, count(*) / 15.0) + 0.2 * least(1.0, count(DISTINCT o_orderpriority) / 5.0) + 0.3 * least(1.0, sum(o_totalprice) / 1e6 / 3.0), 6) AS score
  FROM orders GROUP BY o_custkey)
""",
    "clustered_slope": """
WITH f AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem GROUP BY 1),
u AS (SELECT g, l_suppkey, any_value(n) AS n, any_value(sxx) AS sxx, any_value(sxy) AS sxy, sum((l_quantity - mx) * (l_extendedprice - my - sxy / sxx * (l_quantity - mx))) AS u FROM lineitem JOIN f ON g = l_returnflag GROUP BY g, l_suppkey),
t AS (SELECT g, any_value(n) AS n, any_value(sxx) AS sxx, any_value(sxy) AS sxy, count(*) AS k, sum(u * u) AS meat FROM u GROUP BY g)
SELECT g AS l_returnflag, n, k AS clusters, CASE WHEN k > 1 AND n > 2 AND sxx > 0 THEN round(sxy / sxx, 6) END AS slope,
  CASE WHEN k > 1 AND n > 2 AND sxx > 0 THEN round(sqrt(meat * (k / (k - 1)) * ((n - 1) / (n - 2))) / sxx, 6) END AS error FROM t
""",
    "within_between_slopes": """
WITH s AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, avg(l_quantity) OVER w AS bx, avg(l_extendedprice) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_suppkey))
SELECT g AS l_returnflag, count(*) AS n, round(sum((x - bx) * (y - b)) / nullif(sum((x - bx) * (x - bx)), 0), 6) AS inside, round(regr_slope(b, bx), 6) AS between FROM s GROUP BY g
""",
    "quadratic_gain": """
WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS x FROM lineitem),
s AS (SELECT g, count(*) AS n, regr_sxx(y, x) AS xx, regr_sxx(y, x * x) AS qq, regr_sxy(x * x, x) AS xq, regr_sxy(y, x) AS xy, regr_sxy(y, x * x) AS qy, regr_syy(y, x) AS yy FROM d GROUP BY g),
t AS (SELECT g, n, pow(qy - xq * xy / xx, 2) / (qq - xq * xq / xx) AS gain, yy - xy * xy / xx AS line FROM s)
SELECT g AS l_returnflag, n, round(gain / ((line - gain) / (n - 3)), 6) AS f FROM t
""",
}
