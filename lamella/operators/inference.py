"""Estimators and tests in closed form, on sums that combine before the shuffle; draws are keyed by ids, not by state."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.counts import _L, _M, _counts, log_cpm
from lamella.plans import table
from lamella.plans.prefix import average_ranks

#: Rational approximation of the normal quantile (relative error below 1.2e-9).
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
DRAW_RANGE = 1 << 32


def probit_sql(p: str) -> str:
    """The normal quantile as SQL text that both engines read."""

    def polynomial(terms, x):
        out = f"CAST({terms[0]!r} AS DOUBLE)"
        for t in terms[1:]:
            out = f"({out} * {x} + CAST({t!r} AS DOUBLE))"
        return out

    mid, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    square = f"({mid} * {mid})"
    tail = lambda q: f"({polynomial(PROBIT_C, q)} / {polynomial(PROBIT_D, q)})"
    centre = f"({polynomial(PROBIT_A, square)} * {mid} / {polynomial(PROBIT_B, square)})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -{tail(high)} ELSE {centre} END"


def normal_score(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """rows with the normal quantile of (average rank - 3/8) / (n + 1/4) inside the group; nulls stay null."""
    known = rows.where(F.col(value).isNotNull())
    n = known.groupBy(*groups).agg(F.count("*").alias("_n"))
    ranked = average_ranks(known, groups, value, "_r").join(n, groups).withColumn("_p", (F.col("_r") - 0.375) / (F.col("_n") + 0.25))
    scored = ranked.withColumn("score", F.round(F.expr(probit_sql("_p")), 6)).drop("_r", "_r_ties", "_n", "_p")
    return scored.unionByName(rows.where(F.col(value).isNull()).withColumn("score", F.lit(None).cast("double")))


def method_contrasts(rows: DataFrame, unit: str, method: str, value: str) -> DataFrame:
    """Second less first method (by name) over units that have both: n, median, mean, deviation, normal interval."""
    means = rows.groupBy(unit, method).agg(F.avg(value).alias("v"))
    a = means.select(unit, F.col(method).alias("first"), F.col("v").alias("va"))
    b = means.select(unit, F.col(method).alias("second"), F.col("v").alias("vb"))
    d = a.join(b, unit).where("first < second").withColumn("d", F.col("vb") - F.col("va"))
    half = F.stddev_samp("d") * 1.96 / F.sqrt(F.count("*"))
    return d.groupBy("first", "second").agg(
        F.count("*").alias("n"), F.round(F.percentile("d", F.lit(0.5)), 6).alias("median"), F.round(F.avg("d"), 6).alias("mean"),
        F.round(F.stddev_samp("d"), 6).alias("sd"), F.round(F.avg("d") - half, 6).alias("low"), F.round(F.avg("d") + half, 6).alias("high"),
    )


def variance_components(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Two-way layout of cell means without repeats, components cut at 0; null unless every cell is there."""
    cells = rows.groupBy(a, b).agg(F.avg(value).alias("y"))
    parts = cells.withColumn("ma", F.avg("y").over(Window.partitionBy(a))).withColumn("mb", F.avg("y").over(Window.partitionBy(b)))
    total = cells.agg(F.avg("y").alias("m"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.count("*").alias("n"))
    sums = parts.join(F.broadcast(total)).agg(
        F.sum((F.col("ma") - F.col("m")) ** 2).alias("sa"), F.sum((F.col("mb") - F.col("m")) ** 2).alias("sb"),
        F.sum((F.col("y") - F.col("ma") - F.col("mb") + F.col("m")) ** 2).alias("se"),
        F.max("ka").alias("ka"), F.max("kb").alias("kb"), F.max("n").alias("n"),
    )
    e = F.col("se") / ((F.col("ka") - 1) * (F.col("kb") - 1))
    full = F.col("n") == F.col("ka") * F.col("kb")
    component = lambda s, k, other: F.when(full, F.round(F.greatest(F.lit(0.0), (F.col(s) / (F.col(k) - 1) - e) / F.col(other)), 6))
    return sums.select(component("sa", "ka", "kb").alias("var_a"), component("sb", "kb", "ka").alias("var_b"), F.when(full, F.round(e, 6)).alias("var_e"))


def log_profile(rows: DataFrame, unit: str, part: str, amount: str, parts: int, offset: float = 1.0) -> DataFrame:
    """Centred log2 profile and shares of units that have all parts."""
    y = rows.groupBy(unit, part).agg(F.log2(F.sum(amount) + offset).alias("y"))
    w = Window.partitionBy(unit)
    kept = y.withColumn("k", F.count("*").over(w)).where(F.col("k") == parts)
    power = F.pow(F.lit(2.0), F.col("y"))
    return kept.select(unit, part, F.round(F.col("y") - F.avg("y").over(w), 6).alias("clr"), F.round(power / F.sum(power).over(w), 6).alias("share"))


def two_term_fit(rows: DataFrame, group: str, y: str, a: str, b: str, least: int = 20) -> DataFrame:
    """R2 of y on a and b, what each adds to the other, and the F of adding b; null below least rows."""
    known = rows.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    r = known.groupBy(group).agg(F.count("*").alias("n"), F.corr(y, a).alias("ra"), F.corr(y, b).alias("rb"), F.corr(a, b).alias("rab"))
    full = (F.col("ra") ** 2 + F.col("rb") ** 2 - 2 * F.col("ra") * F.col("rb") * F.col("rab")) / (1 - F.col("rab") ** 2)
    r = r.withColumn("full", F.when(F.col("n") >= least, full))
    return r.select(
        group, "n", F.round("full", 6).alias("r2"), F.round(F.col("full") - F.col("rb") ** 2, 6).alias("unique_a"), F.round(F.col("full") - F.col("ra") ** 2, 6).alias("unique_b"),
        F.round((F.col("full") - F.col("ra") ** 2) * (F.col("n") - 3) / (1 - F.col("full")), 4).alias("f_b"),
    )


def welch(rows: DataFrame, group: str, side: Column, value: str) -> DataFrame:
    """Welch's t of the rows where side is true against the others, and its degrees of freedom."""
    v = lambda f, keep: f(F.when(side if keep else ~side, F.col(value)))
    s = rows.groupBy(group).agg(
        v(F.count, True).alias("na"), v(F.count, False).alias("nb"), v(F.avg, True).alias("ma"), v(F.avg, False).alias("mb"), v(F.var_samp, True).alias("va"), v(F.var_samp, False).alias("vb")
    )
    a, b = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return s.select(
        group, F.round((F.col("ma") - F.col("mb")) / F.sqrt(a + b), 6).alias("t"), F.round((a + b) ** 2 / (a * a / (F.col("na") - 1) + b * b / (F.col("nb") - 1)), 4).alias("df")
    )


def rank_sum(rows: DataFrame, group: str, side: Column, value: str) -> DataFrame:
    """Rank-sum statistic of the rows where side is true and its normal approximation, with ties and continuity."""
    ranked = average_ranks(rows.withColumn("_a", side), [group], value, "_r").withColumn("_t", F.col("_r_ties") * F.col("_r_ties") - 1)
    s = ranked.groupBy(group).agg(F.count(F.when(F.col("_a"), 1)).alias("na"), F.count(F.when(~F.col("_a"), 1)).alias("nb"), F.sum(F.when(F.col("_a"), F.col("_r"))).alias("r"), F.sum("_t").alias("ties"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    s = s.withColumn("w", F.col("r") - na * (na + 1) / 2)
    off = F.col("w") - na * nb / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select(group, "w", F.round((off - F.signum(off) * 0.5) / sd, 6).alias("z"))


def draw(key: Column, step: Column) -> Column:
    """A number in [0, 1) that depends on the key and the step only, each independent of all others: eight digits of
    the md5 of the key and a quarter of the step, whose remainder says which."""
    digits = F.substring(F.md5(F.concat_ws(":", key, F.floor(step / 4))), 1, 32)
    return F.conv(F.substr(digits, (step % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long") / F.lit(float(DRAW_RANGE))


def draw_sql(key: str, step: str) -> str:
    return f"(('0x' || substr(md5({key} || ':' || {step} // 4), {step} % 4 * 8 + 1, 8))::BIGINT / {DRAW_RANGE}.0::DOUBLE)"


#: Poisson(1) below 0, 1, 2 and so on; the last draw, one of 2 ** 32, has 12.
POISSON = tuple(sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(12))


def poisson(u: Column) -> Column:
    """Poisson(1) by its quantiles, as far as the draws reach: how often a unit is drawn."""
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def spread(units: DataFrame) -> DataFrame:
    """A row becomes one for each repeat, so that few rows are work for many tasks."""
    return units.repartition(max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.sparkSession.sparkContext.defaultParallelism))


def bootstrap_mean(rows: DataFrame, unit: str, value: str, repeats: int = 2000) -> DataFrame:
    """Interval of the mean when whole units are drawn again: units are summed first, then repeated."""
    units = rows.groupBy(unit).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = spread(units).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("u", draw(F.col(unit), F.col("rep"))).withColumn("w", poisson(F.col("u")))
    means = drawn.groupBy("rep").agg((F.sum(F.col("s") * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("m"))
    return means.agg(F.count("m").alias("repeats"), F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"))


def sign_flips(rows: DataFrame, unit: str, value: str, repeats: int = 5000) -> DataFrame:
    """p of the units' mean when signs are flipped: (1 + as large) / (1 + repeats)."""
    flipped = spread(rows.select(unit, value)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    sign = F.when((F.col("rep") == 0) | (draw(F.col(unit), F.col("rep")) < 0.5), 1).otherwise(-1)
    means = flipped.groupBy("rep").agg(F.round(F.abs(F.avg(F.col(value) * sign)), 9).alias("m"))
    seen = means.agg(F.max(F.when(F.col("rep") == 0, F.col("m"))).alias("seen"))
    return means.join(F.broadcast(seen)).agg(F.round(F.max("seen"), 6).alias("seen"), (F.count(F.when(F.col("m") >= F.col("seen"), 1)) / F.lit(float(repeats + 1))).alias("p"))


def fold_error(rows: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """Each fold's squared error under the line and under the mean, both fitted on the other folds: all rows' sums less
    the fold's own. With a fold for each row this leaves one out."""
    names = list(_moments(x, y))
    s = rows.groupBy(fold).agg(*[F.sum(e).alias(n) for n, e in _moments(x, y).items()])
    total = rows.agg(*[F.sum(e).alias(f"t_{n}") for n, e in _moments(x, y).items()])
    others = s.crossJoin(total).select(fold, *((F.col(f"t_{n}") - F.col(n)).alias(n) for n in names))  # total is one row
    slope = (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("xx") - F.col("sx") ** 2)
    fitted = others.select(fold, slope.alias("slope"), (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"))
    error = rows.join(fitted, fold)
    return error.groupBy(fold).agg(
        F.round(F.avg((F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx"))) ** 2), 4).alias("line"), F.round(F.avg((F.col(y) - F.col("my")) ** 2), 4).alias("mean")
    )


def _moments(x: str, y: str) -> dict[str, Column]:
    return {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}


def contributions(values: DataFrame, domain: str, row: str, gene: str) -> DataFrame:
    """Each gene's correlation with its module's score, and with the score of the other genes; null below 3 rows."""
    st = values.groupBy(domain, gene).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")).where("sd > 1e-9")
    z = values.join(st, [domain, gene]).withColumn("z", (F.col("value") - F.col("m")) / F.col("sd"))
    w = Window.partitionBy(domain, row)
    z = z.withColumn("s", F.sum("z").over(w)).withColumn("k", F.count("*").over(w))
    enough = F.count("*") >= 3
    return z.groupBy(domain, gene).agg(
        F.when(enough, F.round(F.corr("z", F.col("s") / F.col("k")), 6)).alias("with_all"),
        F.when(enough, F.round(F.corr("z", (F.col("s") - F.col("z")) / F.nullif(F.col("k") - 1, F.lit(0))), 6)).alias("with_others"),
    )


def _lines(s, d, *columns):
    return table(s, d, "lineitem").select(*columns)


def _few(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


def _unit_difference(s, d):
    lines = _lines(s, d, "l_suppkey", "l_linestatus", "l_extendedprice")
    mean = lambda v: F.avg(F.when(F.col("l_linestatus") == v, F.col("l_extendedprice")))
    return lines.groupBy("l_suppkey").agg((mean("F") - mean("O")).alias("d")).where("d IS NOT NULL")


def _odd() -> Column:
    return F.col("o_custkey") % 2 == 1


QUERIES = {
    "normal_score": lambda s, d: normal_score(_few(s, d), ["o_orderpriority"], "o_totalprice").select("o_orderkey", "score"),
    "method_contrasts": lambda s, d: method_contrasts(_lines(s, d, "l_suppkey", "l_returnflag", "l_extendedprice"), "l_suppkey", "l_returnflag", "l_extendedprice"),
    "variance_components": lambda s, d: variance_components(_lines(s, d, "l_returnflag", "l_linenumber", "l_extendedprice"), "l_returnflag", "l_linenumber", "l_extendedprice"),
    "log_profile": lambda s, d: log_profile(_few(s, d), "o_custkey", "o_orderpriority", "o_totalprice", 5),
    "two_term_fit": lambda s, d: two_term_fit(_lines(s, d, "l_returnflag", "l_extendedprice", "l_quantity", "l_discount"), "l_returnflag", "l_extendedprice", "l_quantity", "l_discount"),
    "welch_t": lambda s, d: welch(_few(s, d), "o_orderpriority", _odd(), "o_totalprice"),
    "rank_sum": lambda s, d: rank_sum(_few(s, d), "o_orderpriority", _odd(), "o_totalprice"),
    "cluster_bootstrap": lambda s, d: bootstrap_mean(_few(s, d), "o_custkey", "o_totalprice"),
    "sign_flip_test": lambda s, d: sign_flips(_unit_difference(s, d), "l_suppkey", "d"),
    "fold_error": lambda s, d: fold_error(_lines(s, d, (F.col("l_orderkey") % 5).alias("fold"), "l_quantity", "l_extendedprice"), "fold", "l_quantity", "l_extendedprice"),
    "loo_corr": lambda s, d: contributions(log_cpm(_counts(s, d), "domain", "row", "gene", "count"), "domain", "row", "gene"),
}
_POISSON = f"({' + '.join(f'(u >= {p!r}::DOUBLE)::INT' for p in POISSON)})"
SQL = {
    "normal_score": f"SELECT o_orderkey, round({probit_sql('p')}, 6) AS score FROM (SELECT o_orderkey, (rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY o_orderpriority) + 0.25::DOUBLE) AS p FROM orders)",
    "method_contrasts": "WITH m AS (SELECT l_suppkey, l_returnflag AS f, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT a.f AS first, b.f AS second, b.v - a.v AS d FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.f < b.f) SELECT first, second, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS high FROM p GROUP BY 1, 2",
    "variance_components": "WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2), p AS (SELECT *, avg(y) OVER (PARTITION BY a) AS ma, avg(y) OVER (PARTITION BY b) AS mb, avg(y) OVER () AS m FROM c), s AS (SELECT sum((ma - m) ** 2) AS sa, sum((mb - m) ** 2) AS sb, sum((y - ma - mb + m) ** 2) AS se, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, count(*) AS n FROM p), e AS (SELECT *, se / ((ka - 1) * (kb - 1)) AS e FROM s) SELECT CASE WHEN n = ka * kb THEN round(greatest(0, (sa / (ka - 1) - e) / kb), 6) END AS var_a, CASE WHEN n = ka * kb THEN round(greatest(0, (sb / (kb - 1) - e) / ka), 6) END AS var_b, CASE WHEN n = ka * kb THEN round(e, 6) END AS var_e FROM e",
    "log_profile": "WITH y AS (SELECT o_custkey, o_orderpriority, log2(sum(o_totalprice) + 1) AS y FROM orders GROUP BY 1, 2), k AS (SELECT * FROM y QUALIFY count(*) OVER (PARTITION BY o_custkey) = 5) SELECT o_custkey, o_orderpriority, round(y - avg(y) OVER (PARTITION BY o_custkey), 6) AS clr, round(2 ** y / sum(2 ** y) OVER (PARTITION BY o_custkey), 6) AS share FROM k",
    "two_term_fit": "WITH r AS (SELECT l_returnflag, count(*) AS n, corr(l_extendedprice, l_quantity) AS ra, corr(l_extendedprice, l_discount) AS rb, corr(l_quantity, l_discount) AS rab FROM lineitem GROUP BY 1), f AS (SELECT *, CASE WHEN n >= 20 THEN (ra * ra + rb * rb - 2 * ra * rb * rab) / (1 - rab * rab) END AS r2 FROM r) SELECT l_returnflag, n, round(r2, 6) AS r2, round(r2 - rb * rb, 6) AS unique_a, round(r2 - ra * ra, 6) AS unique_b, round((r2 - ra * ra) * (n - 3) / (1 - r2), 4) AS f_b FROM f",
    "welch_t": "WITH s AS (SELECT o_orderpriority, o_custkey % 2 AS odd, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) / count(*) AS v FROM orders GROUP BY 1, 2) SELECT a.o_orderpriority, round((a.m - b.m) / sqrt(a.v + b.v), 6) AS t, round((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 / (b.n - 1)), 4) AS df FROM s a JOIN s b ON a.o_orderpriority = b.o_orderpriority AND a.odd = 1 AND b.odd = 0",
    "rank_sum": "WITH r AS (SELECT o_orderpriority, o_custkey % 2 AS odd, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER t - 1) / 2.0 AS r, count(*) OVER t AS t FROM orders WINDOW t AS (PARTITION BY o_orderpriority, o_totalprice)), s AS (SELECT o_orderpriority, sum(odd)::DOUBLE AS na, sum(1 - odd)::DOUBLE AS nb, sum(r) FILTER (WHERE odd = 1) AS r, sum(t * t - 1) AS ties FROM r GROUP BY 1), w AS (SELECT *, r - na * (na + 1) / 2 AS w, na + nb AS n FROM s) SELECT o_orderpriority, w, round((w - na * nb / 2 - sign(w - na * nb / 2) * 0.5) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM w",
    "cluster_bootstrap": f"WITH u AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT rep, s, n, {draw_sql('o_custkey', 'rep')} AS u FROM u, range(1, 2001) r(rep)), m AS (SELECT rep, sum(s * {_POISSON}) / sum(n * {_POISSON}) AS m FROM d GROUP BY rep) SELECT count(*) AS repeats, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m",
    "sign_flip_test": f"WITH u AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F') - avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS d FROM lineitem GROUP BY 1), m AS (SELECT rep, round(abs(avg(d * CASE WHEN rep = 0 OR {draw_sql('l_suppkey', 'rep')} < 0.5 THEN 1 ELSE -1 END)), 9) AS m FROM u, range(0, 5001) r(rep) WHERE d IS NOT NULL GROUP BY rep), s AS (SELECT *, max(m) FILTER (WHERE rep = 0) OVER () AS seen FROM m) SELECT round(max(seen), 6) AS seen, count(*) FILTER (WHERE m >= seen) / 5001.0::DOUBLE AS p FROM s",
    "fold_error": "WITH l AS (SELECT l_orderkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem), f AS (SELECT k.fold, regr_slope(y, x) AS slope, avg(x) AS mx, avg(y) AS my FROM (SELECT DISTINCT fold FROM l) k JOIN l ON l.fold <> k.fold GROUP BY 1) SELECT l.fold, round(avg((y - my - slope * (x - mx)) ** 2), 4) AS line, round(avg((y - my) ** 2), 4) AS mean FROM l JOIN f ON l.fold = f.fold GROUP BY 1",
    "loo_corr": f"WITH {_M}{_L}, st AS (SELECT domain, gene, avg(value) AS m, stddev_samp(value) AS sd FROM v GROUP BY 1, 2 HAVING stddev_samp(value) > 1e-9), z AS (SELECT v.domain, v.\"row\", v.gene, (value - m) / sd AS z FROM v JOIN st ON v.domain = st.domain AND v.gene = st.gene), s AS (SELECT *, sum(z) OVER w AS s, count(*) OVER w AS k FROM z WINDOW w AS (PARTITION BY domain, \"row\")) SELECT domain, gene, CASE WHEN count(*) >= 3 THEN round(corr(z, s / k), 6) END AS with_all, CASE WHEN count(*) >= 3 THEN round(corr(z, (s - z) / nullif(k - 1, 0)), 6) END AS with_others FROM s GROUP BY 1, 2",
}
