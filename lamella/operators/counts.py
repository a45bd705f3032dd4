"""Count matrices in long form (row, gene, count): library sizes, detection, normalisation, scores, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans import table


def row_totals(counts: DataFrame, row: str, gene: str, count: str) -> DataFrame:
    return counts.groupBy(row).agg(F.sum(count).alias("total"), F.count(F.when(F.col(count) > 0, 1)).alias("detected"))


def upper_quartile(counts: DataFrame, row: str, gene: str, count: str) -> DataFrame:
    """Library size and the linear 75 % quantile of count / size over all genes, zeros included: the sparse rows are
    padded by their known number of missing genes, not by rows."""
    genes = counts.select(F.countDistinct(gene).alias("genes"))
    sizes = counts.groupBy(row).agg(F.sum(count).alias("size"), F.sort_array(F.collect_list(F.col(count).cast("double"))).alias("v")).join(F.broadcast(genes))
    missing = F.col("genes") - F.size("v")
    at = (F.col("genes") - 1) * F.lit(0.75)
    value = lambda i: F.when(i < missing, 0.0).otherwise(F.element_at("v", (i - missing + 1).cast("int")))
    low, high = F.floor(at), F.ceil(at)
    quantile = value(low) + (value(high) - value(low)) * (at - low)
    return sizes.select(row, "size", F.round(F.when(F.col("size") > 0, quantile / F.col("size")).otherwise(0.0), 9).alias("upper_quartile"))


def detectability(counts: DataFrame, domain: str, row: str, gene: str, count: str, least: float = 0.1) -> DataFrame:
    """Genes seen in at least this share of a domain's rows."""
    rows = counts.groupBy(domain).agg(F.countDistinct(row).alias("rows"))
    seen = counts.where(F.col(count) > 0).groupBy(domain, gene).agg(F.countDistinct(row).alias("seen"))
    return seen.join(rows, domain).withColumn("fraction", F.round(F.col("seen") / F.col("rows"), 6)).where(F.col("seen") / F.col("rows") >= least).select(domain, gene, "fraction")


def log_cpm(counts: DataFrame, domain: str, row: str, gene: str, count: str, prior: float = 2.0) -> DataFrame:
    """log2 of counts per million with a prior in proportion to the row's size."""
    sizes = counts.groupBy(domain, row).agg(F.sum(count).cast("double").alias("e"))
    sizes = sizes.withColumn("prior", F.lit(prior) * F.col("e") / F.avg("e").over(Window.partitionBy(domain)))
    value = F.log2(F.lit(1e6) * (F.col(count) + F.col("prior")) / (F.col("e") + 2 * F.col("prior")))
    return counts.join(sizes, [domain, row]).select(domain, row, gene, value.alias("value"))


def module_score(values: DataFrame, domain: str, row: str, gene: str, value: str = "value") -> DataFrame:
    """Mean z over genes, each standardised inside its domain by the sample deviation; genes without spread drop."""
    stats = values.groupBy(domain, gene).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where("sd > 1e-9")
    z = (F.col(value) - F.col("mean")) / F.col("sd")
    return values.join(stats, [domain, gene]).groupBy(domain, row).agg(F.round(F.avg(z), 6).alias("score"), F.count("*").alias("genes"))


def policies(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Equal and weighted means; spread only for several rows; no weight gives null."""
    mass = F.sum(weight)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("equal_mean"), F.round(F.when(mass != 0, F.sum(F.col(value) * F.col(weight)) / mass), 6).alias("weighted_mean"),
        F.round(F.when(F.count("*") > 1, F.stddev_samp(value)), 6).alias("sd"), F.round(F.when(mass != 0, F.max(weight) / mass), 6).alias("dominant"),
    )


def icc_oneway(rows: DataFrame, family: str, group: str, value: str) -> DataFrame:
    """ICC(1,1) with unequal groups; null unless two groups have several rows."""
    own = rows.groupBy(family, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    total = own.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(family)) / F.sum("n").over(Window.partitionBy(family)))
    agg = total.groupBy(family).agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("several"),
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("between"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
    )
    k0 = (F.col("total") - F.col("squares") / F.col("total")) / (F.col("k") - 1)
    msb, msw = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("total") - F.col("k"))
    return agg.select(family, "k", F.round(F.when((F.col("k") >= 2) & (F.col("several") >= 2), (msb - msw) / (msb + (k0 - 1) * msw)), 6).alias("icc"))


def agreement(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Bland-Altman: median absolute difference, limits of agreement, repeatability."""
    diff = F.col(b) - F.col(a)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.percentile(F.abs(diff), F.lit(0.5)), 6).alias("median_abs"), F.round(F.avg(diff) - 1.96 * F.stddev_samp(diff), 6).alias("low"),
        F.round(F.avg(diff) + 1.96 * F.stddev_samp(diff), 6).alias("high"), F.round(F.stddev_samp(diff) / F.sqrt(F.lit(2.0)), 6).alias("repeatability"),
    )


def visit_summary(rows: DataFrame, unit: str, time: str, value: str) -> DataFrame:
    """First and last value by time, mean, and the slope over time where there are two times or more."""
    slope = F.when(F.countDistinct(time) >= 2, F.regr_slope(F.col(value), F.col(time)))
    return rows.groupBy(unit).agg(F.count("*").alias("visits"), F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.round(F.avg(value), 6).alias("mean"), F.round(slope, 6).alias("rate"))


def _counts(s, d):
    """A synthetic matrix: suppliers are rows, part types genes, line status the domain."""
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("gene"))
    lines = table(s, d, "lineitem").select("l_partkey", "l_linestatus", "l_suppkey", "l_quantity").join(parts, "l_partkey")
    return lines.groupBy(F.col("l_linestatus").alias("domain"), F.col("l_suppkey").alias("row"), "gene").agg(F.sum("l_quantity").cast("long").alias("count"))


_M = "m AS (SELECT l_linestatus AS domain, l_suppkey AS \"row\", p_type AS gene, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"
_L = ", e AS (SELECT domain, \"row\", CAST(sum(count) AS DOUBLE) AS e FROM m GROUP BY 1, 2), pr AS (SELECT *, 2.0 * e / avg(e) OVER (PARTITION BY domain) AS prior FROM e), v AS (SELECT m.domain, m.\"row\", gene, log2(1e6 * (count + prior) / (e + 2 * prior)) AS value FROM m JOIN pr ON m.domain = pr.domain AND m.\"row\" = pr.\"row\")"


def _pairs(s, d):
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return lines.where("l_linenumber = 1").select("l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("a")).join(lines.where("l_linenumber = 2").select("l_orderkey", F.col("l_extendedprice").alias("b")), "l_orderkey")


QUERIES = {
    "row_totals": lambda s, d: row_totals(_counts(s, d), "row", "gene", "count"),
    "library_size_uq": lambda s, d: upper_quartile(_counts(s, d).groupBy("row", "gene").agg(F.sum("count").alias("count")), "row", "gene", "count"),
    "detectability": lambda s, d: detectability(_counts(s, d), "domain", "row", "gene", "count"),
    "cpm_log": lambda s, d: log_cpm(_counts(s, d), "domain", "row", "gene", "count").withColumn("value", F.round("value", 6)),
    "module_z": lambda s, d: module_score(log_cpm(_counts(s, d), "domain", "row", "gene", "count"), "domain", "row", "gene"),
    "aggregation_policies": lambda s, d: policies(table(s, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice", "l_quantity"),
    "icc_oneway": lambda s, d: icc_oneway(table(s, d, "lineitem"), "l_returnflag", "l_suppkey", "l_extendedprice"),
    "agreement": lambda s, d: agreement(_pairs(s, d), ["l_returnflag"], "a", "b"),
    "visit_summary": lambda s, d: visit_summary(table(s, d, "events").select("user_id", F.col("event_id").cast("double").alias("at"), "value"), "user_id", "at", "value"),
    "pooled_sum": lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ";").alias("flags")),
}
SQL = {
    "row_totals": f"WITH {_M} SELECT \"row\", CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (WHERE count > 0) AS detected FROM m GROUP BY 1",
    "library_size_uq": f"WITH {_M}, f AS (SELECT \"row\", gene, sum(count) AS count FROM m GROUP BY 1, 2), g AS (SELECT a.\"row\", b.gene, coalesce(f.count, 0) AS c FROM (SELECT DISTINCT \"row\" FROM f) a CROSS JOIN (SELECT DISTINCT gene FROM f) b LEFT JOIN f ON f.\"row\" = a.\"row\" AND f.gene = b.gene) SELECT \"row\", CAST(sum(c) AS BIGINT) AS size, round(CASE WHEN sum(c) > 0 THEN quantile_cont(CAST(c AS DOUBLE), 0.75) / sum(c) ELSE 0 END, 9) AS upper_quartile FROM g GROUP BY 1",
    "detectability": f"WITH {_M}, r AS (SELECT domain, count(DISTINCT \"row\") AS n FROM m GROUP BY 1) SELECT m.domain, gene, round(count(DISTINCT \"row\") / any_value(n), 6) AS fraction FROM m JOIN r ON m.domain = r.domain WHERE count > 0 GROUP BY 1, 2 HAVING count(DISTINCT \"row\") / any_value(n) >= 0.1",
    "cpm_log": f"WITH {_M}{_L} SELECT domain, \"row\", gene, round(value, 6) AS value FROM v",
    "module_z": f"WITH {_M}{_L}, st AS (SELECT domain, gene, avg(value) AS mean, stddev_samp(value) AS sd FROM v GROUP BY 1, 2 HAVING stddev_samp(value) > 1e-9) SELECT v.domain, \"row\", round(avg((value - mean) / sd), 6) AS score, count(*) AS genes FROM v JOIN st ON v.domain = st.domain AND v.gene = st.gene GROUP BY 1, 2",
    "aggregation_policies": "SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_extendedprice), 6) AS equal_mean, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted_mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(l_extendedprice) END, 6) AS sd, round(max(l_quantity) / sum(l_quantity), 6) AS dominant FROM lineitem GROUP BY 1, 2",
    "icc_oneway": "WITH o AS (SELECT l_returnflag, l_suppkey, count(*) AS n, avg(l_extendedprice) AS m, coalesce(var_samp(l_extendedprice), 0) AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n * m) OVER (PARTITION BY l_returnflag) / sum(n) OVER (PARTITION BY l_returnflag) AS g FROM o), a AS (SELECT l_returnflag, count(*) AS k, sum(n) AS total, sum(n * n) AS sq, count(*) FILTER (WHERE n > 1) AS several, sum(n * (m - g) * (m - g)) AS b, sum((n - 1) * v) AS w FROM t GROUP BY 1), x AS (SELECT *, (total - sq / total) / (k - 1) AS k0, b / (k - 1) AS msb, w / (total - k) AS msw FROM a) SELECT l_returnflag, k, round(CASE WHEN k >= 2 AND several >= 2 THEN (msb - msw) / (msb + (k0 - 1) * msw) END, 6) AS icc FROM x",
    "agreement": "WITH p AS (SELECT a.l_returnflag, b.l_extendedprice - a.l_extendedprice AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2) SELECT l_returnflag, count(*) AS n, round(quantile_cont(abs(d), 0.5), 6) AS median_abs, round(avg(d) - 1.96 * stddev_samp(d), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d), 6) AS high, round(stddev_samp(d) / sqrt(2.0), 6) AS repeatability FROM p GROUP BY 1",
    "visit_summary": "SELECT user_id, count(*) AS visits, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, round(avg(value), 6) AS mean, round(CASE WHEN count(DISTINCT event_id) >= 2 THEN regr_slope(value, CAST(event_id AS DOUBLE)) END, 6) AS rate FROM events GROUP BY 1",
    "pooled_sum": "SELECT l_suppkey, l_partkey, sum(l_quantity) AS quantity, count(*) AS n, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1, 2",
}
