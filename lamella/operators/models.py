"""Linear models from cross products, and tests by permutation, folds and resampling. Rows are read to form sums (and
once more where residuals are needed); systems of a group's size in columns, not rows, are solved in tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.inference import draw, draw_sql, probit_sql, spread
from lamella.plans import made, made_sql
from lamella.plans.prefix import average_ranks, running


def centred(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with all columns known, less the group's means: sums of products of these lose no digits."""
    ok = F.lit(True)
    for c in columns:
        ok &= F.col(c).isNotNull()
    known = rows.where(ok).select(*rows.columns)
    means = known.groupBy(*groups).agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), F.count("*").alias("_n"))
    joined = known.join(means, list(groups)) if groups else known.crossJoin(means)
    return joined.withColumns({c: F.col(c) - F.col(f"_m{i}") for i, c in enumerate(columns)}).drop(*(f"_m{i}" for i in range(len(columns))))


def cross_products(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(groups, n, p): the products of all pairs of columns summed, row by row of the matrix."""
    k = len(columns)
    sums = {f"_{i}_{j}": F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(k) for j in range(i, k)}
    out = rows.groupBy(*groups).agg(F.count("*").alias("n"), *(e.alias(c) for c, e in sums.items()))
    return out.select(*groups, "n", F.array(*(F.col(f"_{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k))).alias("p"))


def unexplained(p: np.ndarray, columns: Sequence[int], y: int) -> float:
    """What is left of y's sum of squares after a fit on the columns, by pivoting out one column at a time; columns that
    the ones before explain add nothing."""
    m = p.copy()
    for c in columns:
        if m[c, c] > 1e-9 * max(p[c, c], 1e-300):
            m = m - np.outer(m[:, c], m[c, :]) / m[c, c]
    return float(max(m[y, y], 0.0))


def solved(sums: DataFrame, work, schema: str) -> DataFrame:
    """work(matrix, n) for each row of sums (groups, n, p); a row of numbers each."""
    groups = [c for c in sums.columns if c not in ("n", "p")]

    def each(frames):
        for frame in frames:
            made_ = [work(np.array(p, float).reshape(math.isqrt(len(p)), -1), int(n)) for p, n in zip(frame["p"], frame["n"], strict=True)]
            out = pd.DataFrame(made_, columns=[f.split()[0] for f in schema.split(", ")], index=frame.index)
            yield pd.concat([frame[groups], frame[["n"]], out], axis=1) if len(frame) else pd.concat([frame[groups], frame[["n"]], out.astype(float)], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in groups)
    return sums.mapInPandas(each, ", ".join(x for x in (kinds, "n long", schema) if x))


def redundancy(rows: DataFrame, groups: list[str], y: str, blocks: dict[str, list[str]], least: int = 20) -> DataFrame:
    """(groups, n, sd, sd_residual, r2, one column for each block): R2 of y on all blocks and what each block adds to
    the others; null below `least` rows."""
    columns = [c for own in blocks.values() for c in own]
    place = {c: i for i, c in enumerate(columns)}
    sums = cross_products(centred(rows, groups, [*columns, y]), groups, [*columns, y])

    def work(p: np.ndarray, n: int) -> list[float | None]:
        yy, last = p[-1, -1], len(columns)
        if n < least or yy <= 0:
            return [None] * (3 + len(blocks))
        full = unexplained(p, range(last), last)
        drops = [(unexplained(p, [place[c] for b, own in blocks.items() if b != block for c in own], last) - full) / yy for block in blocks]
        return [round(math.sqrt(yy / (n - 1)), 6), round(math.sqrt(full / (n - 1)), 6), round(1 - full / yy, 6), *(round(d, 6) for d in drops)]

    return solved(sums, work, ", ".join(f"{c} double" for c in ("sd", "sd_residual", "r2", *(f"unique_{b}" for b in blocks))))


def nested_f(rows: DataFrame, groups: list[str], y: str, base: list[str], more: list[str]) -> DataFrame:
    """(groups, n, df1, df2, f, partial): the F of the columns that `more` adds to `base`, both fitted on the same rows,
    and the share of the base's residuals that it explains."""
    columns = [*base, *more]
    sums = cross_products(centred(rows, groups, [*columns, y]), groups, [*columns, y])

    def work(p: np.ndarray, n: int) -> list[float | None]:
        last, df2 = len(columns), n - 1 - len(columns)
        small, full = unexplained(p, range(len(base)), last), unexplained(p, range(last), last)
        if df2 < 1 or full <= 1e-12 * p[-1, -1]:
            return [len(more), df2, None, None]
        return [len(more), df2, round((small - full) / len(more) / (full / df2), 5), round((small - full) / small, 6)]

    return solved(sums, work, "df1 long, df2 long, f double, partial double")


def interaction_terms(rows: DataFrame, tau: str, tissue: str) -> DataFrame:
    """rows with t (tau standardised), t2, z (the tissue's residual on tau over its deviation), tz and t2z."""
    s = rows.agg(F.avg(tau).alias("_mt"), F.stddev_samp(tau).alias("_st"), F.regr_slope(tissue, tau).alias("_b"), F.regr_intercept(tissue, tau).alias("_a"))
    own = rows.crossJoin(s).withColumn("_r", F.col(tissue) - F.col("_a") - F.col("_b") * F.col(tau))
    sd = own.agg(F.stddev_samp("_r").alias("_sr"))
    own = own.crossJoin(sd).withColumn("t", (F.col(tau) - F.col("_mt")) / F.col("_st")).withColumn("z", F.col("_r") / F.col("_sr"))
    t = F.col("t")
    return own.withColumns({"t2": t * t, "tz": t * F.col("z"), "t2z": t * t * F.col("z")}).drop("_mt", "_st", "_b", "_a", "_r", "_sr")


def pillai(rows: DataFrame, groups: list[str], responses: list[str], x: str) -> DataFrame:
    """(groups, n, pillai, f): Pillai's trace of several responses on one predictor, and its exact F."""
    columns = [*responses, x]
    sums = cross_products(centred(rows, groups, columns), groups, columns)
    k = len(responses)

    def work(p: np.ndarray, n: int) -> list[float | None]:
        if n - 1 - k < 1 or p[-1, -1] <= 0:
            return [None, None]
        v = 1 - unexplained(p, range(k), k) / p[-1, -1]
        return [round(v, 6), round(v / (1 - v) * (n - 1 - k) / k, 5)]

    return solved(sums, work, "pillai double, f double")


def robust_wald(rows: DataFrame, groups: list[str], cluster: str, columns: list[str], y: str) -> DataFrame:
    """(groups, n, clusters, f): the joint F of columns (with an intercept), its covariance robust inside clusters with
    the factor G/(G-1) * (N-1)/(N-k)."""
    own = centred(rows, groups, [*columns, y])
    k = len(columns)
    fits = solved(cross_products(own, groups, [*columns, y]), lambda p, n: [np.linalg.lstsq(p[:k, :k], p[:k, k], rcond=None)[0].tolist(), p[:k, :k].ravel().tolist()], "_b array<double>, _a array<double>")
    at = own.join(fits.drop("n"), groups)
    e = F.col(y) - sum((F.col("_b")[i] * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))
    scores = at.groupBy(*groups, cluster).agg(*(F.sum(F.col(c) * e).alias(f"_u{i}") for i, c in enumerate(columns)))
    meat = scores.groupBy(*groups).agg(F.count("*").alias("clusters"), *(F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")).alias(f"_{i}_{j}") for i in range(k) for j in range(k)))
    meat = meat.select(*groups, "clusters", F.array(*(F.col(f"_{i}_{j}") for i in range(k) for j in range(k))).alias("meat"))

    @F.pandas_udf("double")
    def wald(b: pd.Series, a: pd.Series, m: pd.Series, n: pd.Series, g: pd.Series) -> pd.Series:
        out = []
        for bb, aa, mm, rows_, count in zip(b, a, m, n, g, strict=True):
            if count < 2 or rows_ <= k + 1:
                out.append(None)
                continue
            inverse = np.linalg.pinv(np.array(aa).reshape(k, k))
            v = inverse @ np.array(mm).reshape(k, k) @ inverse * (count / (count - 1)) * ((rows_ - 1) / (rows_ - k - 1))
            out.append(round(float(np.array(bb) @ np.linalg.pinv(v) @ np.array(bb)) / k, 5))
        return pd.Series(out, dtype="float64")

    return fits.join(meat, groups).select(*groups, "n", "clusters", wald("_b", "_a", "meat", "n", "clusters").alias("f"))


def balances(rows: DataFrame, unit: str, parts: Sequence[str], part: str, amount: str) -> DataFrame:
    """(unit, j, ilr): pivot coordinates of log shares of units that have all parts: part j against the mean of all that
    come after it, scaled to an orthonormal basis."""
    k = len(parts)
    order = F.array_position(F.array(*(F.lit(p) for p in parts)), F.col(part))
    logs = rows.where(F.col(amount) > 0).groupBy(unit, order.alias("j")).agg(F.ln(F.sum(amount)).alias("y")).where("j > 0")
    after = Window.partitionBy(unit).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = logs.withColumn("_k", F.count("*").over(Window.partitionBy(unit))).where(F.col("_k") == k)
    r = F.lit(k) - F.col("j")
    return whole.withColumn("_m", F.avg("y").over(after)).where(F.col("j") < k).select(unit, F.col("j").cast("int").alias("j"), F.round(F.sqrt(r / (r + 1)) * (F.col("y") - F.col("_m")), 6).alias("ilr"))


def dealt_products(base: DataFrame, k: int, repeats: int) -> DataFrame:
    """(rep, n, p): for each repeat the products of columns _c0.._ck-1 of base summed, as cross_products has them, where
    _c0 stays in the order of _key and each other column comes in the order of its own draws (by its text _t1.._tk-1, as
    `draw` has it; ties: the key).

    A task takes a share of the repeats over all rows, which it gets from the shuffle, once for each task: it holds the
    rows of base, never those of a repeat beside them."""
    blocks = max(1, min(-(-(repeats + 1) // 4), 2 * base.sparkSession.sparkContext.defaultParallelism))

    def products(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_key", "ascending")]) if not rows["_key"].null_count else pa.concat_tables([rows.filter(pc.is_null(rows["_key"])), rows.filter(pc.is_valid(rows["_key"])).sort_by([("_key", "ascending")])])
        columns = np.stack([rows[f"_c{i}"].to_numpy() for i in range(k)])
        texts = [[None if t is None else t.encode() for t in rows[f"_t{i}"].to_pylist()] for i in range(1, k)]
        del rows
        out = []
        # a quarter's four repeats share their digests
        for quarter in range(key[0].as_py(), repeats // 4 + 1, blocks):
            end = str(quarter).encode()
            digits = [np.frombuffer(b"".join([md5(end if t is None else t + b":" + end).digest() for t in own]), ">u4").reshape(-1, 4) for own in texts]
            for rep in range(max(1, 4 * quarter), min(repeats, 4 * quarter + 3) + 1):
                dealt = np.stack([columns[0], *(c[np.argsort(d[:, rep % 4], kind="stable")] for c, d in zip(columns[1:], digits, strict=True))])
                out.append((rep, dealt.shape[1], (dealt @ dealt.T).ravel().tolist()))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["rep", "n", "p"])

    each = base.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.groupBy("_block").applyInArrow(products, "rep int, n long, p array<double>")


def principal(rows: DataFrame, key: str, columns: list[str], repeats: int = 100, level: float = 0.95) -> DataFrame:
    """(component, value, share, null, kept, loadings): eigenvalues of the correlations and the quantile of those of
    repeats in which each column is dealt anew over the rows; components are kept as long as they exceed it. A
    loading's sign makes the largest one positive."""
    k = len(columns)
    own = centred(rows, [], columns)
    whole = cross_products(own, [], columns).first()  # one matrix of k x k
    p = np.array(whole["p"]).reshape(k, k)
    scale = np.sqrt(np.diag(p))
    values, vectors = np.linalg.eigh(p / np.outer(scale, scale))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(k)])
    # each column's rows in an order of their own for each repeat; the first keeps its place
    base = own.select(F.col(key).alias("_key"), *(F.concat_ws("/", F.lit(str(i)), F.col(key)).alias(f"_t{i}") for i in range(1, k)), *((F.col(c) / float(s)).alias(f"_c{i}") for i, (c, s) in enumerate(zip(columns, scale, strict=True))))
    null = dealt_products(base, k, repeats)
    eigen = solved(null, lambda m, n: [np.linalg.eigvalsh(m)[::-1].tolist()], "v array<double>")
    limits = eigen.agg(*(F.percentile(F.col("v")[i], F.lit(level)).alias(f"l{i}") for i in range(k))).first()
    kept, out = True, []
    for i in range(k):
        kept = kept and bool(values[i] > limits[i])
        out.append((i + 1, round(float(values[i]), 6), round(float(values[i] / k), 6), round(float(limits[i]), 6), kept, ",".join(f"{x:.4f}" for x in vectors[:, i])))
    return rows.sparkSession.createDataFrame(out, "component int, value double, share double, null_value double, kept boolean, loadings string")


def out_of_fold_scores(rows: DataFrame, fold: str, value: str, key: str) -> DataFrame:
    """rows with the normal score of each value against the other folds' values only, by its middle place as if put
    among them: those below, half of the equal ones. Both counts are all rows' less the fold's own."""
    known = rows.where(F.col(value).isNotNull())
    whole = average_ranks(known.withColumn("_all", F.lit(0)), ["_all"], value, "_r")
    whole = average_ranks(whole, [fold], value, "_f")
    n = known.groupBy(fold).agg(F.count("*").alias("_n"))
    total = known.agg(F.count("*").alias("_t"))
    # a rank is the number below + (ties + 1) / 2
    middle = lambda c: F.col(c) - 0.5
    scored = whole.join(n, fold).crossJoin(total).withColumn("_p", (middle("_r") - middle("_f") + 0.5 - 0.375) / (F.col("_t") - F.col("_n") + 1.25))
    return scored.withColumn("score", F.round(F.expr(probit_sql("_p")), 6)).select(*rows.columns, "score")


def label_permutation(rows: DataFrame, key: str, label: Column, value: str, repeats: int = 5000) -> DataFrame:
    """(seen, p): the difference of two labels' means, and how often one as large comes when labels are dealt anew:
    (1 + as large) / (1 + repeats). The labels' number stays; who has one is who comes first by random keys."""
    own = rows.select(F.col(key).alias("_key"), label.cast("int").alias("_a"), F.col(value).alias("_v"))
    n = own.agg(F.sum("_a").alias("_na"), F.count("*").alias("_n"), F.sum("_v").alias("_sum"), F.sum(F.col("_a") * F.col("_v")).alias("_seen"))
    each = spread(own).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    ranked = each.withColumn("_k", F.row_number().over(Window.partitionBy("rep").orderBy(draw(F.col("_key"), F.col("rep")), "_key"))).crossJoin(n)
    sums = ranked.where("_k <= _na").groupBy("rep").agg(F.sum("_v").alias("_s"))
    difference = lambda s: s / F.col("_na") - (F.col("_sum") - s) / (F.col("_n") - F.col("_na"))
    tested = sums.crossJoin(n).withColumn("_d", F.round(F.abs(difference(F.col("_s"))), 9)).withColumn("_o", F.round(F.abs(difference(F.col("_seen"))), 9))
    seen = F.first(difference(F.col("_seen")))
    return tested.agg(F.round(seen, 6).alias("seen"), ((1 + F.count(F.when(F.col("_d") >= F.col("_o"), 1))) / F.lit(float(repeats + 1))).alias("p"))


def residual_permutation(rows: DataFrame, key: str, x: str, covariate: str, y: str, repeats: int = 5000) -> DataFrame:
    """(slope, p): the slope of y on x given a covariate, tested by dealing anew the residuals of y on the covariate. The
    covariate's fit is orthogonal to x's residual, so a repeat's slope is a sum of products of two columns of residuals."""
    s = rows.agg(*(f(c, covariate).alias(f"_{n}{c}") for c in (x, y) for f, n in ((F.regr_slope, "b"), (F.regr_intercept, "a"))))
    residual = lambda c: F.col(c) - F.col(f"_a{c}") - F.col(f"_b{c}") * F.col(covariate)
    own = rows.crossJoin(s).select(F.col(key).alias("_key"), residual(x).alias("_x"), residual(y).alias("_e"))
    seen = own.agg(F.sum(F.col("_x") * F.col("_e")).alias("_xe"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"))
    base = own.select("_key", F.col("_key").cast("string").alias("_t1"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_c{i}") for i, c in enumerate(("_x", "_e"))))  # products with null count nothing
    sums = dealt_products(base, 2, repeats).select(F.col("p")[1].alias("_s")).crossJoin(seen)
    large = F.round(F.abs(F.col("_s") / F.col("_xx")), 9) >= F.round(F.abs(F.col("_xe") / F.col("_xx")), 9)
    return sums.agg(F.round(F.first(F.col("_xe") / F.col("_xx")), 6).alias("slope"), ((1 + F.count(F.when(large, 1))) / F.lit(float(repeats + 1))).alias("p"))


def fold_gain(rows: DataFrame, key: str, base: list[str], more: list[str], y: str, folds: int = 10, repeats: int = 20) -> DataFrame:
    """(repeat, gain): how much of y's out-of-fold sum of squares `more` explains beyond `base`, each fold fitted on the
    others. Folds come from random keys; a fold's errors are a quadratic form of its own sums, so rows are read once."""
    columns = [*base, *more, y]
    whole = centred(rows, [], columns).withColumn("_one", F.lit(1.0))
    fold = F.floor(draw(F.col(key), F.col("repeat")) * folds)
    each = spread(whole.select(key, *columns, "_one")).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("fold", fold)
    sums = cross_products(each, ["repeat", "fold"], ["_one", *columns]).select("repeat", "fold", "p")
    total = cross_products(whole, [], ["_one", *columns]).select(F.col("p").alias("t"))
    k, b = len(columns), len(base)

    @F.pandas_udf("base double, full double, total double")
    def errors(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = []
        for own, all_ in zip(p, t, strict=True):
            test = np.array(own).reshape(k + 1, k + 1)
            train = np.array(all_).reshape(k + 1, k + 1) - test
            line = []
            for own_columns in (range(1 + b), range(k), range(1)):
                i = list(own_columns)
                fit = np.linalg.lstsq(train[np.ix_(i, i)], train[i, k], rcond=None)[0]
                c = np.zeros(k + 1)
                c[i], c[k] = -fit, 1
                line.append(float(c @ test @ c))
            out.append(line)
        return pd.DataFrame(out, columns=["base", "full", "total"])

    e = sums.crossJoin(total).select("repeat", errors("p", "t").alias("e")).groupBy("repeat").agg(*(F.sum(f"e.{c}").alias(c) for c in ("base", "full", "total")))
    return e.select("repeat", F.round((F.col("base") - F.col("full")) / F.col("total"), 6).alias("gain"))


def resampled_slope(rows: DataFrame, unit: str, x: str, y: str, repeats: int = 2000) -> DataFrame:
    """(estimate, low, high, fitted): the slope of y on x with an interval from units drawn with replacement, a unit
    drawn twice counting as two; draws without a slope are left out and seen in `fitted`."""
    sums = rows.groupBy(unit).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"))
    numbered = running(sums, [], [unit], {"_at": F.lit(1)})
    size = numbered.agg(F.count("*").alias("_n"))
    each = spread(numbered.select("_at")).crossJoin(size).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    picks = each.withColumn("_pick", F.floor(draw(F.concat_ws("/", F.lit("pick"), "_at"), F.col("rep")) * F.col("_n"))).groupBy("rep", "_pick").agg(F.count("*").alias("w"))
    drawn = picks.join(numbered.withColumnRenamed("_at", "_pick"), "_pick").groupBy("rep").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in ("n", "sx", "sy", "xx", "xy")))
    bottom = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")
    slope = F.when(bottom > 1e-9, (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / bottom)
    estimate = rows.agg(F.round(F.regr_slope(y, x), 6).alias("estimate"))
    return estimate.crossJoin(drawn.withColumn("b", slope).agg(F.round(F.percentile("b", F.lit(0.025)), 5).alias("low"), F.round(F.percentile("b", F.lit(0.975)), 5).alias("high"), F.count("b").alias("fitted")))


def correlations(rows: DataFrame, response: str, covariates: list[str], least: int = 5) -> DataFrame:
    """(covariate, n, spearman, pearson) over complete pairs; null below `least`."""
    each = rows.select(F.col(response).alias("_y"), F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("_x")) for c in covariates))).alias("e")).select("_y", "e.*").where("_y IS NOT NULL AND _x IS NOT NULL")
    ranked = average_ranks(average_ranks(each, ["covariate"], "_x", "_rx"), ["covariate"], "_y", "_ry")
    enough = F.count("*") >= least
    return ranked.groupBy("covariate").agg(F.count("*").alias("n"), F.round(F.when(enough, F.corr("_rx", "_ry")), 6).alias("spearman"), F.round(F.when(enough, F.corr("_x", "_y")), 6).alias("pearson"))


def profile_spread(rows: DataFrame, region: str, part: str, stage: str, value: str) -> DataFrame:
    """(region, stage, sd, fold): the root mean square over parts of the values' deviations in each stage, and two to the
    median distance from 0."""
    per = rows.groupBy(region, stage, part).agg(F.stddev_samp(value).alias("_s"), F.percentile(F.abs(F.col(value)), F.lit(0.5)).alias("_m"))
    return per.groupBy(region, stage).agg(F.round(F.sqrt(F.avg(F.col("_s") * F.col("_s"))), 6).alias("sd"), F.round(F.pow(F.lit(2.0), F.avg("_m")), 6).alias("fold"))


def marker_stack(rows: DataFrame, family: str, unit: str, part: str, amount: str, x: str, parts: int) -> DataFrame:
    """(family, dropped, n, f): cumulative shares of each unit's profile by part, units whose profile sums to 0 dropped and
    counted; one F for each family, of the shares before the last on x."""
    sums = rows.groupBy(family, unit).agg(F.sum(amount).alias("_t"))
    dropped = sums.groupBy(family).agg(F.count(F.when(F.col("_t") == 0, 1)).alias("dropped"))
    kept = rows.join(sums.where("_t > 0"), [family, unit])
    upto = Window.partitionBy(family, unit).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    shares = kept.withColumn("_c", F.sum(F.col(amount) / F.col("_t")).over(upto))
    wide = shares.groupBy(family, unit).agg(F.first(x).alias("_x"), *(F.max(F.when(F.col(part) == k, F.col("_c"))).alias(f"_c{k}") for k in range(1, parts)))
    return dropped.join(pillai(wide, [family], [f"_c{k}" for k in range(1, parts)], "_x").drop("pillai"), family, "left")


_ROWS = {"g": "l_returnflag", "u": "l_suppkey", "y": "l_extendedprice / 1000", "a": "l_quantity", "b": "l_discount * 100", "c": "l_tax * 100 + l_linenumber", "k": "l_orderkey * 1000 + l_partkey"}
_UNITS = {"k": "s_suppkey", "v": "s_acctbal", "x": "s_nationkey + (s_suppkey % 7) * 0.5", "z": "s_suppkey % 11", "g": "s_suppkey % 3"}
_CUST = {"k": "c_custkey", "f": "c_custkey % 5", "v": "round(c_acctbal / 500)", "a": "c_acctbal / 1000", "b": "c_nationkey", "c": "c_custkey % 17"}
_STACK = {"family": "o_orderpriority", "unit": "o_custkey", "part": "1 + CAST(o_orderkey % 3 AS INT)", "amount": "CASE o_custkey % 9 WHEN 0 THEN 0.0 ELSE o_totalprice END", "x": "CAST(o_custkey % 13 AS DOUBLE)"}


def _stack(s, d):
    return made(s, d, "orders", _STACK).groupBy("family", "unit", "part", "x").agg(F.sum("amount").alias("amount"))


def _whole_stack(s, d):
    """Units with all three parts."""
    rows = _stack(s, d)
    return rows.join(rows.groupBy("family", "unit").count().where("count = 3").drop("count"), ["family", "unit"])


QUERIES = {
    "block_redundancy": lambda s, d: redundancy(made(s, d, "lineitem", _ROWS), ["g"], "y", {"size": ["a"], "rates": ["b", "c"]}),
    "nested_f": lambda s, d: nested_f(made(s, d, "lineitem", _ROWS), ["g"], "y", ["a"], ["b", "c"]),
    "interaction_f": lambda s, d: nested_f(interaction_terms(made(s, d, "lineitem", _ROWS), "a", "c"), [], "y", ["t", "t2", "z", "b"], ["tz", "t2z"]),
    "region_interaction": lambda s, d: nested_f(made(s, d, "lineitem", {"y": "l_extendedprice / 1000", "a": "l_quantity", "r": "CASE l_returnflag WHEN 'A' THEN 1.0 ELSE 0.0 END", "n": "CASE l_returnflag WHEN 'N' THEN 1.0 ELSE 0.0 END", "ar": "CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0.0 END", "an": "CASE l_returnflag WHEN 'N' THEN l_quantity ELSE 0.0 END"}), [], "y", ["a", "r", "n"], ["ar", "an"]),
    "pillai": lambda s, d: pillai(made(s, d, "lineitem", _ROWS), ["g"], ["y", "b", "c"], "a"),
    "robust_wald": lambda s, d: robust_wald(made(s, d, "lineitem", _ROWS), ["g"], "u", ["a", "b"], "y"),
    "pivot_balances": lambda s, d: balances(made(s, d, "orders", {"unit": "o_custkey", "part": "o_orderstatus", "amount": "o_totalprice"}), "unit", ["F", "O", "P"], "part", "amount"),
    "principal_components": lambda s, d: principal(made(s, d, "customer", _CUST), "k", ["a", "b"], 100).select("component", "value", "share", "null_value", "kept"),
    "out_of_fold_scores": lambda s, d: out_of_fold_scores(made(s, d, "customer", _CUST), "f", "v", "k").select("k", "score"),
    "label_permutation": lambda s, d: label_permutation(made(s, d, "supplier", _UNITS), "k", F.col("g") == 0, "v"),
    "residual_permutation": lambda s, d: residual_permutation(made(s, d, "supplier", _UNITS), "k", "x", "z", "v"),
    "fold_gain": lambda s, d: fold_gain(made(s, d, "customer", _CUST), "k", ["b"], ["c"], "a", 5, 20),
    "resampled_slope": lambda s, d: resampled_slope(made(s, d, "lineitem", _ROWS), "u", "a", "y"),
    "covariate_correlations": lambda s, d: correlations(made(s, d, "customer", _CUST), "a", ["b", "c", "v"]),
    "profile_spread": lambda s, d: profile_spread(made(s, d, "lineitem", {"r": "l_returnflag", "p": "l_linenumber", "st": "l_suppkey % 3", "v": "(l_quantity - 25) / 20"}), "r", "p", "st", "v"),
    "marker_stack": lambda s, d: marker_stack(_whole_stack(s, d), "family", "unit", "part", "amount", "x", 3),
}


def _swept(source: str, group: str | None, columns: Sequence[str]) -> str:
    """CTEs that take each column out of those after it, one by one: q{i} holds column i less all before it, and v the
    rest of the last column."""
    over = f"(PARTITION BY {group})" if group else "()"
    keep = f"{group}, " if group else ""
    names = [f"c{i}" for i in range(len(columns))]
    out = [f"s0 AS (SELECT {keep}" + ", ".join(f"{c} - avg({c}) OVER {over} AS {n}" for c, n in zip(columns, names, strict=True)) + f" FROM {source} t)"]
    for i in range(len(columns) - 1):
        rest = ", ".join(f"CASE WHEN sum({names[i]} * {names[i]}) OVER {over} > 0 THEN {n} - {names[i]} * sum({n} * {names[i]}) OVER {over} / sum({names[i]} * {names[i]}) OVER {over} ELSE {n} END AS {n}" for n in names[i + 1 :])
        out.append(f"s{i + 1} AS (SELECT {keep}{rest} FROM s{i})")
    return ", ".join(out)


def _rss(source: str, group: str | None, columns: Sequence[str], name: str) -> str:
    """A CTE `name` (g, n, rss, tss) of the last column on those before it."""
    body = _swept(source, group, columns)
    last, final = f"c{len(columns) - 1}", f"s{len(columns) - 1}"
    g = group or "1"
    return f"{name} AS (WITH {body}, t AS (SELECT {g} AS g, sum({last} * {last}) AS tss FROM s0 GROUP BY 1) SELECT {'f.' + group if group else '1'} AS g, count(*) AS n, sum({last} * {last}) AS rss, any_value(t.tss) AS tss FROM {final} f JOIN t ON t.g = {'f.' + group if group else '1'} GROUP BY 1)"


_R = made_sql("lineitem", _ROWS)
_INTER = f"(SELECT y, b, t, t * t AS t2, z, t * z AS tz, t * t * z AS t2z FROM (SELECT y, b, t, r / stddev_samp(r) OVER () AS z FROM (SELECT y, b, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS t, c - regr_intercept(c, a) OVER () - regr_slope(c, a) OVER () * a AS r FROM {_R} q)))"
_REGION = "(SELECT l_extendedprice / 1000 AS y, l_quantity AS a, (l_returnflag = 'A')::INT::DOUBLE AS r, (l_returnflag = 'N')::INT::DOUBLE AS n, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS ar, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS an FROM lineitem)"
_NESTED = lambda q, g, base, more: f"WITH {_rss(q, g, [*base, 'y'], 'sm')}, {_rss(q, g, [*base, *more, 'y'], 'fu')} SELECT {'sm.g, ' if g else ''}sm.n, {len(more)}::BIGINT AS df1, sm.n - {1 + len(base) + len(more)} AS df2, round((sm.rss - fu.rss) / {len(more)} / (fu.rss / (sm.n - {1 + len(base) + len(more)})), 5) AS f, round((sm.rss - fu.rss) / sm.rss, 6) AS partial FROM sm JOIN fu ON sm.g = fu.g"
_CU = made_sql("customer", _CUST)
_SU = made_sql("supplier", _UNITS)
SQL = {
    "block_redundancy": f"WITH {_rss(_R, 'g', ['a', 'b', 'c', 'y'], 'fu')}, {_rss(_R, 'g', ['b', 'c', 'y'], 'na')}, {_rss(_R, 'g', ['a', 'y'], 'nr')} SELECT fu.g, fu.n, round(sqrt(fu.tss / (fu.n - 1)), 6) AS sd, round(sqrt(fu.rss / (fu.n - 1)), 6) AS sd_residual, round(1 - fu.rss / fu.tss, 6) AS r2, round((na.rss - fu.rss) / fu.tss, 6) AS unique_size, round((nr.rss - fu.rss) / fu.tss, 6) AS unique_rates FROM fu JOIN na ON fu.g = na.g JOIN nr ON fu.g = nr.g",
    "nested_f": _NESTED(_R, "g", ["a"], ["b", "c"]),
    "interaction_f": _NESTED(_INTER, None, ["t", "t2", "z", "b"], ["tz", "t2z"]),
    "region_interaction": _NESTED(_REGION, None, ["a", "r", "n"], ["ar", "an"]),
    "pillai": f"WITH {_rss(_R, 'g', ['y', 'b', 'c', 'a'], 'f')} SELECT g, n, round(1 - rss / tss, 6) AS pillai, round((1 - rss / tss) / (rss / tss) * (n - 4) / 3, 5) AS f FROM f",
    "robust_wald": f"""WITH m AS (SELECT g, u, y - avg(y) OVER w AS y, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM {_R} q WINDOW w AS (PARTITION BY g)), p AS (SELECT g, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS bm FROM m GROUP BY 1), f AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * bm) / (aa * bb - ab * ab) AS ba, (aa * bm - ab * ay) / (aa * bb - ab * ab) AS b2 FROM p),
      e AS (SELECT m.g, u, sum(a * (y - ba * a - b2 * b)) AS ua, sum(b * (y - ba * a - b2 * b)) AS ub FROM m JOIN f ON f.g = m.g GROUP BY 1, 2), t AS (SELECT g, count(*) AS k, sum(ua * ua) AS maa, sum(ua * ub) AS mab, sum(ub * ub) AS mbb FROM e GROUP BY 1),
      v AS (SELECT f.g, n, k, ba, b2, (k / (k - 1)) * ((n - 1) / (n - 3)) / (det * det) AS s, bb * bb * maa - 2 * ab * bb * mab + ab * ab * mbb AS vaa, aa * aa * mbb - 2 * ab * aa * mab + ab * ab * maa AS vbb, -ab * bb * maa + (aa * bb + ab * ab) * mab - ab * aa * mbb AS vab FROM f JOIN t ON f.g = t.g)
      SELECT g, n, k AS clusters, round((vbb * ba * ba - 2 * vab * ba * b2 + vaa * b2 * b2) / (s * (vaa * vbb - vab * vab)) / 2, 5) AS f FROM v""",
    "pivot_balances": """WITH l AS (SELECT o_custkey AS unit, ln(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F')) AS f, ln(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O')) AS o, ln(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P')) AS p FROM orders GROUP BY 1)
      SELECT unit, 1 AS j, round(sqrt(2.0::DOUBLE / 3) * (f - (o + p) / 2), 6) AS ilr FROM l WHERE f + o + p IS NOT NULL UNION ALL SELECT unit, 2, round(sqrt(0.5::DOUBLE) * (o - p), 6) FROM l WHERE f + o + p IS NOT NULL""",
    "principal_components": f"""WITH o AS (SELECT k, a, b FROM {_CU} q), e AS (SELECT o.*, r.rep FROM o, range(1, 101) r(rep)), x AS (SELECT rep, a, row_number() OVER (PARTITION BY rep ORDER BY k) AS n FROM e), y AS (SELECT rep, b, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql("'1/' || k", "rep")}, k) AS n FROM e),
      c AS (SELECT abs(corr(a, b)) AS r FROM x JOIN y USING (rep, n) GROUP BY rep), l AS (SELECT quantile_cont(1 + r, 0.95) AS hi, quantile_cont(1 - r, 0.95) AS lo FROM c), w AS (SELECT abs(corr(a, b)) AS r FROM o)
      SELECT 1 AS component, round(1 + r, 6) AS value, round((1 + r) / 2, 6) AS share, round(hi, 6) AS null_value, 1 + r > hi AS kept FROM w, l UNION ALL SELECT 2, round(1 - r, 6), round((1 - r) / 2, 6), round(lo, 6), 1 + r > hi AND 1 - r > lo FROM w, l""",
    "out_of_fold_scores": f"""WITH v AS (SELECT k, f, v FROM {_CU} q), r AS (SELECT *, rank() OVER (ORDER BY v) - 1 + count(*) OVER (PARTITION BY v) / 2.0::DOUBLE - (rank() OVER (PARTITION BY f ORDER BY v) - 1 + count(*) OVER (PARTITION BY f, v) / 2.0::DOUBLE) AS below, count(*) OVER () - count(*) OVER (PARTITION BY f) AS n FROM v)
      SELECT k, round({probit_sql("p")}, 6) AS score FROM (SELECT k, (below + 0.125::DOUBLE) / (n + 1.25::DOUBLE) AS p FROM r)""",
    "label_permutation": f"""WITH o AS (SELECT k, (g = 0)::INT AS a, v FROM {_SU} q), n AS (SELECT sum(a) AS na, count(*) AS n, sum(v) AS s, sum(a * v) AS seen FROM o), e AS (SELECT o.*, rep, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql("k", "rep")}, k) AS nr FROM o, range(1, 5001) r(rep)), t AS (SELECT rep, sum(v) AS x FROM e, n WHERE nr <= na GROUP BY rep)
      SELECT round(any_value(seen / na - (s - seen) / (n - na)), 6) AS seen, (1 + count(*) FILTER (WHERE round(abs(x / na - (s - x) / (n - na)), 9) >= round(abs(seen / na - (s - seen) / (n - na)), 9))) / 5001.0::DOUBLE AS p FROM t, n""",
    "residual_permutation": f"""WITH o AS (SELECT k, x - regr_intercept(x, z) OVER () - regr_slope(x, z) OVER () * z AS x, v - regr_intercept(v, z) OVER () - regr_slope(v, z) OVER () * z AS e FROM {_SU} q), s AS (SELECT sum(x * e) AS xe, sum(x * x) AS xx FROM o), a AS (SELECT rep, x, row_number() OVER (PARTITION BY rep ORDER BY k) AS n FROM o, range(1, 5001) r(rep)), b AS (SELECT rep, e, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql("k", "rep")}, k) AS n FROM o, range(1, 5001) r(rep)),
      t AS (SELECT rep, sum(x * e) AS p FROM a JOIN b USING (rep, n) GROUP BY 1) SELECT round(any_value(xe / xx), 6) AS slope, (1 + count(*) FILTER (WHERE round(abs(p / xx), 9) >= round(abs(xe / xx), 9))) / 5001.0::DOUBLE AS p FROM t, s""",
    "fold_gain": f"""WITH o AS (SELECT k, a AS y, CAST(b AS DOUBLE) AS u, CAST(c AS DOUBLE) AS w FROM {_CU} q), e AS (SELECT o.*, rep, floor({draw_sql("k", "rep")} * 5) AS fold FROM o, range(1, 21) r(rep)), d AS (SELECT DISTINCT rep, fold FROM e),
      f AS (SELECT d.rep, d.fold, avg(y) AS my, avg(u) AS mu, avg(w) AS mw, regr_slope(y, u) AS b1, regr_sxx(y, u) AS uu, regr_sxx(y, w) AS ww, regr_sxy(w, u) AS uw, regr_sxy(y, u) AS uy, regr_sxy(y, w) AS wy FROM d JOIN e ON e.rep = d.rep AND e.fold <> d.fold GROUP BY 1, 2),
      c AS (SELECT *, (ww * uy - uw * wy) / (uu * ww - uw * uw) AS bu, (uu * wy - uw * uy) / (uu * ww - uw * uw) AS bw FROM f)
      SELECT CAST(e.rep AS INT) AS repeat, round((sum((y - my - b1 * (u - mu)) ** 2) - sum((y - my - bu * (u - mu) - bw * (w - mw)) ** 2)) / sum((y - my) ** 2), 6) AS gain FROM e JOIN c ON c.rep = e.rep AND c.fold = e.fold GROUP BY 1""",
    "resampled_slope": f"""WITH s AS (SELECT u, count(*) AS n, sum(a) AS sx, sum(y) AS sy, sum(a * a) AS xx, sum(a * y) AS xy, row_number() OVER (ORDER BY u) - 1 AS nr FROM {_R} q GROUP BY u), k AS (SELECT rep, floor({draw_sql("'pick/' || nr", "rep")} * (SELECT count(*) FROM s)) AS pick FROM s, range(1, 2001) r(rep)),
      t AS (SELECT rep, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy FROM k JOIN s ON s.nr = pick GROUP BY 1), b AS (SELECT CASE WHEN n * xx - sx * sx > 1e-9 THEN (n * xy - sx * sy) / (n * xx - sx * sx) END AS b FROM t)
      SELECT (SELECT round(regr_slope(y, a), 6) FROM {_R} q) AS estimate, round(quantile_cont(b, 0.025), 5) AS low, round(quantile_cont(b, 0.975), 5) AS high, count(b) AS fitted FROM b""",
    "covariate_correlations": f"""WITH e AS (SELECT a AS y, unnest(['b', 'c', 'v']) AS covariate, unnest([b, c, v]) AS x FROM {_CU} q), r AS (SELECT *, rank() OVER (PARTITION BY covariate ORDER BY x) + (count(*) OVER (PARTITION BY covariate, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY covariate ORDER BY y) + (count(*) OVER (PARTITION BY covariate, y) - 1) / 2.0 AS ry FROM e)
      SELECT covariate, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson FROM r GROUP BY 1""",
    "profile_spread": "WITH p AS (SELECT l_returnflag AS r, l_suppkey % 3 AS st, l_linenumber, stddev_samp((l_quantity - 25) / 20) AS s, quantile_cont(abs((l_quantity - 25) / 20), 0.5) AS m FROM lineitem GROUP BY 1, 2, 3) SELECT r, st, round(sqrt(avg(s * s)), 6) AS sd, round(2 ** avg(m), 6) AS fold FROM p GROUP BY 1, 2",
    "marker_stack": f"""WITH o AS (SELECT family, unit, part, x, sum(amount) AS amount FROM {made_sql("orders", _STACK)} GROUP BY ALL), w AS (SELECT family, unit, any_value(x) AS x, sum(amount) AS t, sum(amount) FILTER (WHERE part = 1) AS a1, sum(amount) FILTER (WHERE part <= 2) AS a2 FROM o GROUP BY 1, 2 HAVING count(*) = 3), k AS (SELECT family, x, a1 / t AS y1, a2 / t AS y2 FROM w WHERE t > 0),
      {_rss("k", "family", ["y1", "y2", "x"], "f")}, z AS (SELECT family, count(*) FILTER (WHERE t = 0) AS dropped FROM w GROUP BY 1) SELECT z.family, dropped, n, round((1 - rss / tss) / (rss / tss) * (n - 3) / 2, 5) AS f FROM z LEFT JOIN f ON f.g = z.family""",
}
