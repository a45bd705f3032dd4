"""Matched backgrounds, null controls, summaries of visits, and other choices of rows, all by keys and ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.counts import _M, _counts, log_cpm
from lamella.operators.inference import draw, draw_sql
from lamella.plans import made, table

#: Quantile bins of abundance and of detection, and the number of draws.
ABUNDANCE_BINS, DETECTION_BINS, DRAWS = 10, 5, 100


def quantile_edges(rows: DataFrame, groups: list[str], value: str, bins: int) -> DataFrame:
    """(groups, edges): the inner edges of equal-count bins, linear between places."""
    return rows.groupBy(*groups).agg(F.percentile(value, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges"))


def right_open_bin(value: Column, edges: Column) -> Column:
    """How many edges lie at or below the value: bins [a, b)."""
    return F.size(F.filter(edges, lambda e: e <= value))


def strata(genes: DataFrame, domain: str, gene: str, abundance: str, detection: str, n_abundance: int = ABUNDANCE_BINS, n_detection: int = DETECTION_BINS) -> DataFrame:
    """genes with their joint stratum in the domain and its place by mean abundance (ties: the lower number)."""
    a = quantile_edges(genes, [domain], abundance, n_abundance).withColumnRenamed("edges", "_a")
    d = quantile_edges(genes, [domain], detection, n_detection).withColumnRenamed("edges", "_d")
    binned = genes.join(a, domain).join(d, domain)
    binned = binned.withColumn("stratum", right_open_bin(F.col(abundance), F.col("_a")) * n_detection + right_open_bin(F.col(detection), F.col("_d"))).drop("_a", "_d")
    # at most n_abundance * n_detection strata a domain
    order = binned.groupBy(domain, "stratum").agg(F.avg(abundance).alias("_m")).withColumn("place", F.row_number().over(Window.partitionBy(domain).orderBy(F.round("_m", 9), "stratum"))).drop("_m")
    return binned.join(order, [domain, "stratum"])


def matched_draws(stratified: DataFrame, signature: DataFrame, domain: str, gene: str, draws: int = DRAWS) -> DataFrame:
    """(domain, draw, gene, own, borrowed): for each draw a background set of the signature's genes: as many genes of
    each of its strata, none of them its own, without replacement, in order of random keys. What a stratum lacks comes
    from the strata nearest in place (ties: the lower), a gene never twice in one draw, and is counted as borrowed.

    signature: (domain, gene). Strata are served in order of their places; a stratum's need and its own partners are
    numbers, so that whom it borrows from follows from running sums, not from a loop over draws."""
    marked = stratified.join(signature.select(domain, gene).withColumn("_sig", F.lit(1)), [domain, gene], "left").withColumn("_sig", F.coalesce("_sig", F.lit(0)))
    # need, supply of each stratum: a table of strata
    per = marked.groupBy(domain, "place").agg(F.sum("_sig").alias("need"), F.sum(1 - F.col("_sig")).alias("has")).withColumn("short", F.greatest(F.lit(0), F.col("need") - F.col("has"))).withColumn("spare", F.greatest(F.lit(0), F.col("has") - F.col("need")))
    return _borrowed(per, marked, domain, gene, draws)


def _borrowed(per: DataFrame, marked: DataFrame, domain: str, gene: str, draws: int) -> DataFrame:
    # the strata of one domain are 50 at most: their list travels with each, and a fold hands spares to the short ones
    row = F.struct("place", "need", "has", "short", "spare")
    listed = per.groupBy(domain).agg(F.sort_array(F.collect_list(row)).alias("strata"))
    spare0 = F.map_from_entries(F.transform("strata", lambda s: F.struct(s["place"], s["spare"].cast("long"))))

    def serve(state: Column, s: Column) -> Column:
        near = F.array_sort(F.filter(F.map_keys(state["spare"]), lambda p: p != s["place"]), lambda a, b: F.when(F.abs(a - s["place"]) != F.abs(b - s["place"]), F.abs(a - s["place"]) - F.abs(b - s["place"])).otherwise(a - b).cast("int"))
        start = F.named_struct(F.lit("left"), s["short"].cast("long"), F.lit("spare"), state["spare"])

        def take(x: Column, p: Column) -> Column:
            n = F.least(x["left"], F.element_at(x["spare"], p))
            return F.named_struct(F.lit("left"), x["left"] - n, F.lit("spare"), F.transform_values(x["spare"], lambda k, v: F.when(k == p, v - n).otherwise(v)))

        return F.named_struct(F.lit("spare"), F.when(s["short"] > 0, F.aggregate(near, start, take)["spare"]).otherwise(state["spare"]))

    after = F.aggregate("strata", F.named_struct(F.lit("spare"), spare0), serve)["spare"]
    # how many of a stratum's partners are drawn in all: its own need or all it has, and what others borrow
    quota = listed.select(domain, F.explode("strata").alias("s"), after.alias("_after")).select(domain, F.col("s.place").alias("place"), F.least("s.need", "s.has").alias("own"), (F.col("s.spare") - F.element_at("_after", F.col("s.place"))).alias("lent"))
    pool = marked.where("_sig = 0").join(quota.where("own + lent > 0"), [domain, "place"]).select(domain, gene, "place", "own", "lent")
    each = pool.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = draw(F.concat_ws("/", F.col(domain), F.col(gene)), F.col("draw"))
    ranked = each.withColumn("_k", F.row_number().over(Window.partitionBy(domain, "draw", "place").orderBy(key, gene)))
    return ranked.where(F.col("_k") <= F.col("own") + F.col("lent")).select(domain, "draw", gene, "place", (F.col("_k") > F.col("own")).alias("borrowed"))


def background_score(values: DataFrame, drawn: DataFrame, signature: DataFrame, domain: str, row: str, gene: str, value: str) -> DataFrame:
    """For each row: the signature's mean, the mean and sample deviation over draws of the draws' means, their
    difference, and the background mean's standard error."""
    per = values.join(drawn.select(domain, "draw", gene), [domain, gene]).groupBy(domain, row, "draw").agg(F.avg(value).alias("m"))
    back = per.groupBy(domain, row).agg(F.avg("m").alias("background"), F.stddev_samp("m").alias("sd"), F.count("*").alias("draws"))
    own = values.join(signature.select(domain, gene), [domain, gene]).groupBy(domain, row).agg(F.avg(value).alias("own"), F.count("*").alias("genes"))
    out = own.join(back, [domain, row])
    return out.select(domain, row, "genes", F.round("own", 6).alias("own"), F.round("background", 6).alias("background"), F.round("sd", 6).alias("sd"), F.round(F.col("own") - F.col("background"), 6).alias("difference"), F.round(F.col("sd") / F.sqrt("draws"), 6).alias("error"))


def background_errors(scores: DataFrame, domain: str) -> DataFrame:
    """Each domain's median deviation over rows, over the root of the number of draws."""
    return scores.groupBy(domain).agg(F.count("*").alias("rows"), F.round(F.percentile("error", F.lit(0.5)), 6).alias("error"))


def null_controls(detectable: DataFrame, signatures: DataFrame, domain: str, gene: str, name: str, seed: int = 0) -> DataFrame:
    """(domain, gene): for each domain as many of its detectable genes as the median signature has there, in order of
    random keys; all of them where there are no more."""
    sizes = signatures.select(name, gene).distinct().join(detectable.select(domain, gene), gene).groupBy(domain, name).agg(F.count("*").alias("n"))
    size = sizes.groupBy(domain).agg(F.floor(F.percentile("n", F.lit(0.5))).alias("size"))
    key = draw(F.col(gene), F.lit(seed))
    ranked = detectable.select(domain, gene).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(domain).orderBy(key, gene)))
    return ranked.join(size, domain, "left").where((F.coalesce("size", F.lit(0)) <= 0) | (F.col("_k") <= F.col("size"))).select(domain, gene)


def exact_sums(cells: DataFrame, mapping: DataFrame, cell: str, group: str, gene: str, count: str) -> DataFrame:
    """(group, gene, count) of the mapped cells as whole numbers. A count that is negative, no whole number or no number
    fails, and so does a sum that doesn't conserve the total of each gene."""
    c = F.col(count)
    broken = c.isNull() | F.isnan(c.cast("double")) | (c < 0) | (c.cast("double") != F.floor(c.cast("double")))
    checked = F.when(broken, F.raise_error(F.concat(F.lit("no count: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("long")).otherwise(c.cast("long"))
    mapped = cells.select(cell, gene, checked.alias(count)).join(mapping.select(cell, group), cell)
    sums = mapped.groupBy(group, gene).agg(F.sum(count).alias(count))
    before = mapped.groupBy(gene).agg(F.sum(count).alias("_before"))
    after = sums.groupBy(gene).agg(F.sum(count).alias("_after"))
    kept = before.join(after, gene).select(gene, F.when(F.col("_before") == F.col("_after"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("sum not conserved: "), F.col(gene))).cast("boolean")).alias("_same"))
    return sums.join(kept, gene).where("_same").select(group, gene, count)


def gene_totals(counts: DataFrame, row: str, gene: str, count: str) -> DataFrame:
    """Each gene's total, rows where it isn't 0, and their share of all rows."""
    n = counts.agg(F.countDistinct(row).alias("_n"))
    own = counts.groupBy(gene).agg(F.sum(count).alias("total"), F.count(F.when(F.col(count) > 0, 1)).alias("nonzero"))
    return own.crossJoin(n).select(gene, "total", "nonzero", F.round(F.col("nonzero") / F.col("_n"), 6).alias("fraction"))


def select_rows(rows: DataFrame, barcode: str, wanted: str, donor: str | None = None, of: str | None = None, present: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows kept, a row of counts): equal barcode as text, and where given an equal donor and a value that isn't missing."""
    hit = F.trim(F.col(barcode).cast("string")) == wanted
    ok = F.lit(True) if donor is None else F.trim(F.col(donor).cast("string")) == of
    there = F.lit(True) if present is None else F.col(present).isNotNull() & (F.trim(F.col(present).cast("string")) != "")
    counts = rows.agg(F.count("*").alias("rows"), F.count(F.when(hit, 1)).alias("matched"), F.count(F.when(hit & ok & there, 1)).alias("kept"))
    return rows.where(hit & ok & there), counts


def usable_features(rows: DataFrame, unit: str, feature: str, mass: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose mass is finite and above 0, a row of what went). A negative mass fails."""
    m = F.col(mass)
    checked = rows.withColumn(mass, F.when(m < 0, F.raise_error(F.concat(F.lit("negative mass of "), F.col(unit).cast("string"))).cast("double")).otherwise(m.cast("double")))
    finite = F.col(mass).isNotNull() & ~F.isnan(mass) & (F.col(mass) < float("inf"))
    counts = checked.agg(F.count("*").alias("rows"), F.count(F.when(~finite, 1)).alias("not_finite"), F.count(F.when(finite & (F.col(mass) == 0), 1)).alias("zero"))
    return checked.where(finite & (F.col(mass) > 0)), counts


def weighted_features(rows: DataFrame, weights: DataFrame, unit: str, mass: str, weight: str) -> DataFrame:
    """rows with their mass times the unit's weight; units without a finite weight above 0 go; a negative one fails."""
    w = F.col(weight).cast("double")
    checked = weights.select(unit, F.when(w < 0, F.raise_error(F.concat(F.lit("negative weight of "), F.col(unit).cast("string"))).cast("double")).otherwise(w).alias("_w"))
    ok = checked.where(F.col("_w").isNotNull() & ~F.isnan("_w") & (F.col("_w") > 0) & (F.col("_w") < float("inf")))
    return rows.join(ok, unit).withColumn(mass, F.col(mass) * F.col("_w")).drop("_w")


def pair_support(rows: DataFrame, region: str, donor: str, score: str, a: str, b: str, tol_a: float, tol_b: float, discordant: float, least: int = 10) -> DataFrame:
    """For each region: donors and median difference over all pairs, over pairs that lie within both tolerances, donors
    in such pairs that differ by `discordant`, and what that supports.

    No pair is written: pairs up to a difference are counted in sorted scores, and a median is found by halving. A task
    holds a region's rows (not its pairs); work on matched pairs grows with the distinct (a, b) of a region. Scores that
    are null or not finite have no difference."""
    own = rows.where(F.col(donor).isNotNull()).select(F.col(region).alias("_g"), F.col(donor).alias("_d"), *(F.col(c).cast("double").alias(n) for c, n in ((score, "_s"), (a, "_a"), (b, "_b")))).where("_g IS NOT NULL")
    kind = own.schema["_g"].dataType.simpleString()
    names = ["pairs", "median_all", "median_matched", "donors", "matched_donors", "far_donors"]

    def support_of(frame: pd.DataFrame) -> pd.DataFrame:
        found = _pair_support(pd.factorize(frame["_d"])[0], *(frame[c].to_numpy(float) for c in ("_s", "_a", "_b")), tol_a, tol_b, discordant)
        return pd.DataFrame([[frame["_g"].iloc[0], *found]] if found else [], columns=["_g", *names])

    sums = own.groupBy("_g").applyInPandas(support_of, f"_g {kind}, pairs long, median_all double, median_matched double, donors long, matched_donors long, far_donors long")
    support = F.when(F.col("matched_donors") < least, "insufficient support for a narrow contrast").when(F.col("far_donors") >= least, "discordance observed").otherwise("broad spread only")
    return sums.select(F.col("_g").alias(region), "pairs", *(F.round(c, 6).alias(c) for c in names[1:3]), *names[3:]).withColumn("support", support)


#: Scores of neighbouring classes that are kept from step to step; with more, they are put together again in each.
KEPT_SCORES = 20_000_000


class _Pairs:
    """Pairs of sorted scores whose (a, b) lie within tolerances; all pairs where there are none."""

    def __init__(self, s: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None, tol_a: float = 0.0, tol_b: float = 0.0):
        ab = np.zeros((len(s), 2)) if a is None else np.stack([a, b], axis=1)
        self.classes, of = np.unique(ab, axis=0, return_inverse=True)
        order = np.lexsort((s, of.ravel()))
        self.rows = np.split(order, np.cumsum(np.bincount(of.ravel(), minlength=len(self.classes)))[:-1])
        self.s, self.tol_a, self.tol_b, self.later = s, tol_a, tol_b, {}
        self.keep = sum(sum(len(self.rows[j]) for j in self.matches(i)) for i in range(len(self.classes))) <= KEPT_SCORES
        self.n = sum(len(r) * (len(r) - 1) // 2 + len(r) * len(self.after(i)) for i, r in enumerate(self.rows))

    def matches(self, i: int) -> np.ndarray:
        """Classes, itself included, that lie within the tolerances of class i."""
        own = self.classes[i]
        low = np.searchsorted(self.classes[:, 0], own[0] - self.tol_a * 1.000001)
        high = np.searchsorted(self.classes[:, 0], own[0] + self.tol_a * 1.000001, side="right")
        near = self.classes[low:high]
        return low + np.flatnonzero((np.abs(near[:, 0] - own[0]) <= self.tol_a) & (np.abs(near[:, 1] - own[1]) <= self.tol_b))

    def after(self, i: int) -> np.ndarray:
        """The sorted scores of matching classes that come after i."""
        if i in self.later:
            return self.later[i]
        found = np.sort(self.s[np.concatenate([np.zeros(0, int), *(self.rows[j] for j in self.matches(i) if j > i)])])
        if self.keep:
            self.later[i] = found
        return found

    def upto(self, t: float) -> int:
        total = 0
        for i, r in enumerate(self.rows):
            own, other = self.s[r], self.after(i)
            total += int((np.searchsorted(own, own + t, side="right") - np.arange(len(own)) - 1).sum())
            if len(other):
                total += int((np.searchsorted(other, own + t, side="right") - np.searchsorted(other, own - t)).sum())
        return total


def _median_difference(s: np.ndarray, donors: np.ndarray, *ab) -> float | None:
    """The median of |s - s'| over pairs of different donors: those of all rows less those inside a donor."""
    known = np.isfinite(s)
    for c in ab[:2]:
        known &= ~np.isnan(c)
    s, donors, ab = s[known], donors[known], (*(c[known] for c in ab[:2]), *ab[2:])
    of = np.argsort(donors, kind="stable")
    again = [g for g in np.split(of, np.flatnonzero(np.diff(donors[of])) + 1) if len(g) > 1]
    part = lambda g: _Pairs(s[g], *(c[g] for c in ab[:2]), *ab[2:])
    whole, inside = part(np.arange(len(s))), [part(g) for g in again]
    n = whole.n - sum(p.n for p in inside)
    if not n:
        return None
    ends = []
    for k in {(n - 1) // 2, n // 2}:
        low, high = 0.0, float(s.max() - s.min())
        if whole.upto(0.0) - sum(p.upto(0.0) for p in inside) > k:
            high = 0.0
        # halved until doubles have no number between, or far below the digits that are returned
        while high - low > 1e-13 * max(1.0, high) and low < (middle := (low + high) / 2) < high:
            enough = whole.upto(middle) - sum(p.upto(middle) for p in inside) > k
            low, high = (low, middle) if enough else (middle, high)
        ends.append(high)
    return sum(ends) / len(ends)


def _pair_support(donors: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, tol_a: float, tol_b: float, discordant: float) -> list | None:
    sizes = np.bincount(donors)
    n = len(donors)
    pairs = n * (n - 1) // 2 - int((sizes * (sizes - 1) // 2).sum())
    if not pairs:
        return None
    placed = np.flatnonzero(~np.isnan(a) & ~np.isnan(b))
    all_ = _Pairs(np.zeros(len(placed)), a[placed], b[placed], tol_a, tol_b) if len(placed) else None
    matched, far = np.zeros(len(sizes), bool), np.zeros(len(sizes), bool)
    for i, r in enumerate(all_.rows if all_ else []):
        own, other = placed[r], placed[np.concatenate([all_.rows[j] for j in all_.matches(i)])]
        d = donors[own]
        matched[d[(donors[other].min() != d) | (donors[other].max() != d)]] = True
        # the farthest score of another donor is the greatest or the least, or the next one where that is its own
        other = other[np.isfinite(s[other])]
        for end in (other[np.argsort(s[other], kind="stable")], other[np.argsort(-s[other], kind="stable")]):
            if len(end):
                next_ = end[donors[end] != donors[end[0]]][:1]
                at = np.where(d != donors[end[0]], s[end[0]], s[next_[0]] if len(next_) else np.nan)
                far[d[np.isfinite(s[own]) & (np.abs(at - s[own]) >= discordant)]] = True
    return [pairs, _median_difference(s, donors), _median_difference(s, donors, a, b, tol_a, tol_b), len(sizes), int(matched.sum()), int(far.sum())]


def visit_window(visits: DataFrame, unit: str, age: str, end: str, score: str, window: float = 10.0) -> DataFrame:
    """For each unit with a score: visits, the first and last distance to the end, the span of ages, the score at the
    highest age (the first of several: the largest score), the mean inside the window of two visits or more, and the
    slope over two ages or more."""
    v = visits.where(F.col(score).isNotNull()).withColumn("_y", F.col(end) - F.col(age))
    inside = F.col("_y") <= window
    n_in = F.count(F.when(inside, 1))
    return v.groupBy(unit).agg(
        F.count("*").alias("visits"), F.round(F.max("_y"), 6).alias("first_gap"), F.round(F.min("_y"), 6).alias("last_gap"), F.round(F.max(age) - F.min(age), 6).alias("span"), F.max(F.struct(age, score))[score].alias("last_score"), n_in.alias("in_window"),
        F.round(F.when(n_in >= 2, F.avg(F.when(inside, F.col(score)))), 6).alias("window_mean"), F.round(F.when(F.countDistinct(age) >= 2, F.regr_slope(F.col(score), F.col(age))), 6).alias("rate"),
    )


def reference_visit(visits: DataFrame, unit: str, age: str, score: str, back: float = 4.0, least_gap: float = 3.0) -> DataFrame:
    """For each unit the visit nearest to `back` before its last one (ties: the earlier), the gap, and the change since;
    units with a smaller gap go."""
    last = visits.groupBy(unit).agg(F.max(F.struct(age, score)).alias("_l"))
    near = visits.join(last, unit).groupBy(unit).agg(F.min(F.struct(F.round(F.abs(F.col(f"_l.{age}") - F.col(age) - back), 9).alias("far"), F.col(age).alias("at"), F.col(score).alias("y"))).alias("r"), F.first("_l").alias("l"))
    gap = F.col(f"l.{age}") - F.col("r.at")
    return near.select(unit, F.col("r.at").alias("reference"), F.round(gap, 6).alias("gap"), F.round(F.col(f"l.{score}") - F.col("r.y"), 6).alias("change")).where(F.col("gap") >= least_gap)


def first_passing(bins: DataFrame, group: str, order: str, value: str, limits: dict[str, float]) -> DataFrame:
    """For each group and limit the first bin whose value lies under it."""
    each = bins.withColumn("l", F.explode(F.array(*(F.struct(F.lit(k).alias("criterion"), F.lit(v).alias("limit")) for k, v in limits.items()))))
    passing = each.where(F.col(value) < F.col("l.limit"))
    return passing.groupBy(group, F.col("l.criterion").alias("criterion")).agg(F.min(order).alias("first_bin"), F.min_by(value, order).alias("value"))


def reference_row(rows: DataFrame, domain: str, row: str, value: str, size: str) -> DataFrame:
    """(domain, row): of rows with a size, the one whose value is nearest to their mean (ties: the first); null where
    fewer than two have one."""
    known = rows.where(F.col(size) > 0)
    mean = known.groupBy(domain).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    near = known.join(mean, domain).groupBy(domain).agg(F.min(F.struct(F.round(F.abs(F.col(value) - F.col("_m")), 12).alias("d"), F.col(row).alias("r"))).alias("b"), F.first("_n").alias("n"))
    return near.select(domain, F.when(F.col("n") >= 2, F.col("b.r")).alias(row))


def _profile(s, d):
    """(domain, gene, abundance, detection) of the synthetic matrix."""
    counts = _counts(s, d)
    rows = counts.groupBy("domain").agg(F.countDistinct("row").alias("rows"))
    sizes = counts.groupBy("domain", "row").agg(F.sum("count").alias("size"))
    per = counts.join(sizes, ["domain", "row"]).groupBy("domain", "gene").agg(F.sum(F.col("count") / F.col("size") * 1e6).alias("cpm"), F.count(F.when(F.col("count") > 0, 1)).alias("seen"))
    return per.join(rows, "domain").select("domain", "gene", F.round(F.log2(F.col("cpm") / F.col("rows") + 1), 9).alias("abundance"), F.round(F.col("seen") / F.col("rows"), 9).alias("detection"))


def _finer(s, d):
    """A matrix with more genes: each part is one."""
    return table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("domain"), F.col("l_suppkey").alias("row"), F.concat(F.lit("g"), F.col("l_partkey") % 400).alias("gene")).agg(F.sum("l_quantity").cast("long").alias("count"))


def _strata(s, d):
    counts = _finer(s, d)
    per = counts.groupBy("domain", "gene").agg(F.round(F.log2(F.sum("count") + 1.0), 9).alias("abundance"), F.count("*").cast("double").alias("detection"))
    return strata(per, "domain", "gene", "abundance", "detection", 6, 3)


def _signature(s, d):
    """Genes whose number ends in 7, and one stratum's worth of the most abundant ones, so that some must borrow."""
    found = _strata(s, d)
    top = found.groupBy("domain").agg(F.max("place").alias("_t"))
    return found.join(top, "domain").where(F.col("gene").rlike("7$") | ((F.col("place") == F.col("_t")) & F.col("gene").rlike("[0-6]$"))).select("domain", "gene")


def _values(s, d):
    return log_cpm(_finer(s, d), "domain", "row", "gene", "count")


QUERIES = {
    "matched_strata": lambda s, d: _strata(s, d).select("domain", "gene", "stratum", "place"),
    "matched_draws": lambda s, d: matched_draws(_strata(s, d), _signature(s, d), "domain", "gene", 20).groupBy("domain", "draw", "place").agg(F.count("*").alias("n"), F.count(F.when(F.col("borrowed"), 1)).alias("borrowed"), F.min("gene").alias("first"), F.max("gene").alias("last")),
    "matched_background": lambda s, d: background_score(_values(s, d), matched_draws(_strata(s, d), _signature(s, d), "domain", "gene", 20), _signature(s, d), "domain", "row", "gene", "value"),
    "null_control": lambda s, d: null_controls(_strata(s, d), made(s, d, "part", {"name": "p_brand", "gene": "'g' || CAST(p_partkey % 400 AS STRING)"}), "domain", "gene", "name"),
    "exact_sums": lambda s, d: exact_sums(made(s, d, "lineitem", {"cell": "l_orderkey", "gene": "l_returnflag", "count": "l_quantity"}), made(s, d, "orders", {"cell": "o_orderkey", "group": "o_orderpriority"}), "cell", "group", "gene", "count"),
    "gene_totals": lambda s, d: gene_totals(_counts(s, d).withColumn("row", F.concat_ws("/", "domain", "row")), "row", "gene", "count"),
    "section_rows": lambda s, d: select_rows(made(s, d, "orders", {"barcode": "' ' || CAST(o_orderkey % 9 AS STRING)", "donor": "o_custkey % 7", "field": "CASE o_orderkey % 4 WHEN 0 THEN ' ' ELSE o_orderstatus END"}), "barcode", "3", "donor", "2", "field")[1],
    "usable_features": lambda s, d: usable_features(made(s, d, "lineitem", {"id": "l_orderkey", "f": "l_returnflag", "m": "CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 0.0 ELSE l_tax END"}), "id", "f", "m")[1],
    "weighted_features": lambda s, d: weighted_features(made(s, d, "lineitem", {"id": "l_orderkey", "f": "l_linenumber", "m": "l_quantity"}), made(s, d, "orders", {"id": "o_orderkey", "w": "CASE o_orderkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE o_custkey % 5 + 0.5 END"}), "id", "m", "w"),
    "pair_support": lambda s, d: pair_support(made(s, d, "customer", {"region": "c_nationkey", "donor": "c_custkey", "v": "c_acctbal / 1000", "a": "c_custkey % 13", "b": "c_custkey % 5"}), "region", "donor", "v", "a", "b", 2.0, 1.0, 3.0, 4),
    "visit_window": lambda s, d: visit_window(made(s, d, "events", {"u": "user_id", "age": "60 + event_id % 31", "death": "92 + user_id % 3", "score": "CASE event_id % 7 WHEN 0 THEN NULL ELSE value END"}), "u", "age", "death", "score"),
    "reference_visit": lambda s, d: reference_visit(made(s, d, "events", {"u": "user_id", "age": "CAST(event_id % 997 AS DOUBLE) / 7", "score": "value"}), "u", "age", "score"),
    "first_passing": lambda s, d: first_passing(made(s, d, "lineitem", {"g": "l_returnflag", "bin": "l_linenumber", "v": "l_extendedprice"}).groupBy("g", "bin").agg(F.round(F.avg("v"), 4).alias("v")), "g", "bin", "v", {"lenient": 51000.0, "strict": 50000.0}),
    "reference_row": lambda s, d: reference_row(made(s, d, "orders", {"g": "o_orderpriority", "r": "o_orderkey", "v": "o_totalprice", "n": "o_custkey % 4"}), "g", "r", "v", "n"),
}
_F = "f AS (SELECT l_linestatus AS domain, l_suppkey AS \"row\", 'g' || CAST(l_partkey % 400 AS VARCHAR) AS gene, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2, 3)"
_EDGES = lambda c, n: f"quantile_cont({c}, [{', '.join(f'{i / n!r}::DOUBLE' for i in range(1, n))}])"
_STRATA = f""", g AS (SELECT domain, gene, round(log2(sum(count) + 1.0), 9) AS a, CAST(count(*) AS DOUBLE) AS d FROM f GROUP BY 1, 2), e AS (SELECT domain, {_EDGES("a", 6)} AS ea, {_EDGES("d", 3)} AS ed FROM g GROUP BY 1),
  b AS (SELECT g.domain, gene, a, CAST(len(list_filter(ea, lambda x: x <= a)) * 3 + len(list_filter(ed, lambda x: x <= d)) AS INT) AS stratum FROM g JOIN e USING (domain)), o AS (SELECT domain, stratum, CAST(row_number() OVER (PARTITION BY domain ORDER BY round(avg(a), 9), stratum) AS INT) AS place FROM b GROUP BY 1, 2),
  st AS (SELECT b.*, place FROM b JOIN o USING (domain, stratum)), sig AS (SELECT domain, gene, place FROM st WHERE gene LIKE '%7' OR (place = (SELECT max(place) FROM st x WHERE x.domain = st.domain) AND regexp_matches(gene, '[0-6]$'))),
  per AS (SELECT st.domain, st.place, count(sig.gene) AS need, count(*) - count(sig.gene) AS has FROM st LEFT JOIN sig USING (domain, gene) GROUP BY 1, 2)"""
#: Spares go to short strata one by one, in order of their places: a recursion over (short stratum, lender) by distance.
_LENT = """, tasks AS (SELECT s.domain, s.place AS taker, l.place AS lender, row_number() OVER (PARTITION BY s.domain ORDER BY s.place, abs(l.place - s.place), l.place) AS k, s.need - s.has AS short FROM per s JOIN per l ON l.domain = s.domain AND l.place <> s.place WHERE s.need > s.has),
  lend(domain, k, spare, taker, rest) AS (SELECT domain, 0::BIGINT, map_from_entries(list((place, greatest(has - need, 0)) ORDER BY place)), 0, 0::BIGINT FROM per GROUP BY domain
    UNION ALL SELECT domain, k, map_concat(spare, MAP {lender: spare[lender] - n}), taker, rest - n FROM (
      SELECT *, least(rest, spare[lender]) AS n FROM (SELECT t.domain, t.k, l.spare, t.taker, t.lender, CASE WHEN t.taker = l.taker THEN l.rest ELSE t.short END AS rest FROM lend l JOIN tasks t ON t.domain = l.domain AND t.k = l.k + 1))),
  fin AS (SELECT domain, arg_max(spare, k) AS spare FROM lend GROUP BY 1), q AS (SELECT per.domain, place, least(need, has) AS own, greatest(has - need, 0) - spare[place] AS lent FROM per JOIN fin USING (domain)),
  dr AS (SELECT p.domain, r.draw, p.gene, p.place, own, lent, row_number() OVER (PARTITION BY p.domain, r.draw, p.place ORDER BY %s, p.gene) AS k FROM (SELECT * FROM st WHERE (domain, gene) NOT IN (SELECT domain, gene FROM sig)) p JOIN q USING (domain, place), range(1, 21) r(draw) WHERE own + lent > 0),
  drawn AS (SELECT *, k > own AS borrowed FROM dr WHERE k <= own + lent)""" % draw_sql("p.domain || '/' || p.gene", "r.draw")
_VALUES = ", z AS (SELECT domain, \"row\", CAST(sum(count) AS DOUBLE) AS e FROM f GROUP BY 1, 2), pr AS (SELECT *, 2.0 * e / avg(e) OVER (PARTITION BY domain) AS prior FROM z), v AS (SELECT f.domain, f.\"row\", gene, log2(1e6 * (count + prior) / (e + 2 * prior)) AS value FROM f JOIN pr ON f.domain = pr.domain AND f.\"row\" = pr.\"row\")"
SQL = {
    "matched_strata": f"WITH {_F}{_STRATA} SELECT domain, gene, stratum, place FROM st",
    "matched_draws": f"WITH RECURSIVE {_F}{_STRATA}{_LENT} SELECT domain, CAST(draw AS INT) AS draw, place, count(*) AS n, count(*) FILTER (WHERE borrowed) AS borrowed, min(gene) AS first, max(gene) AS last FROM drawn GROUP BY 1, 2, 3",
    "matched_background": f"""WITH RECURSIVE {_F}{_STRATA}{_LENT}{_VALUES}, m AS (SELECT v.domain, v."row", draw, avg(value) AS m FROM v JOIN drawn USING (domain, gene) GROUP BY 1, 2, 3), bk AS (SELECT domain, "row", avg(m) AS background, stddev_samp(m) AS sd, count(*) AS n FROM m GROUP BY 1, 2),
      w AS (SELECT v.domain, v."row", avg(value) AS own, count(*) AS genes FROM v JOIN sig USING (domain, gene) GROUP BY 1, 2) SELECT domain, "row", genes, round(own, 6) AS own, round(background, 6) AS background, round(sd, 6) AS sd, round(own - background, 6) AS difference, round(sd / sqrt(n), 6) AS error FROM w JOIN bk USING (domain, "row")""",
    "null_control": f"""WITH {_F}, g AS (SELECT DISTINCT domain, gene FROM f), s AS (SELECT domain, name, count(*) AS n FROM (SELECT DISTINCT p_brand AS name, 'g' || CAST(p_partkey % 400 AS VARCHAR) AS gene FROM part) JOIN g USING (gene) GROUP BY 1, 2), m AS (SELECT domain, floor(quantile_cont(n, 0.5)) AS size FROM s GROUP BY 1)
      SELECT domain, gene FROM (SELECT g.*, size, row_number() OVER (PARTITION BY domain ORDER BY {draw_sql("gene", "0")}, gene) AS k FROM g LEFT JOIN m USING (domain)) WHERE coalesce(size, 0) <= 0 OR k <= size""",
    "exact_sums": "SELECT o_orderpriority AS \"group\", l_returnflag AS gene, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "gene_totals": f"WITH {_M} SELECT gene, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (WHERE count > 0) AS nonzero, round(count(*) FILTER (WHERE count > 0) / (SELECT count(DISTINCT (domain, \"row\")) FROM m), 6) AS fraction FROM m GROUP BY 1",
    "section_rows": "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 9 = 3) AS matched, count(*) FILTER (WHERE o_orderkey % 9 = 3 AND o_custkey % 7 = 2 AND o_orderkey % 4 <> 0) AS kept FROM orders",
    "usable_features": "SELECT count(*) AS rows, count(*) FILTER (WHERE l_linenumber = 1) AS not_finite, count(*) FILTER (WHERE l_linenumber = 2 OR (l_linenumber > 2 AND l_tax = 0)) AS zero FROM lineitem",
    "weighted_features": "SELECT l_orderkey AS id, l_linenumber AS f, l_quantity * (o_custkey % 5 + 0.5::DOUBLE) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 3 = 2",
    "pair_support": """WITH c AS (SELECT c_nationkey AS region, c_custkey AS donor, c_acctbal / 1000 AS v, c_custkey % 13 AS a, c_custkey % 5 AS b FROM customer), p AS (SELECT x.region, x.donor AS da, y.donor AS db, abs(x.v - y.v) AS d, abs(x.a - y.a) <= 2 AND abs(x.b - y.b) <= 1 AS m FROM c x JOIN c y ON x.region = y.region AND x.donor < y.donor),
      s AS (SELECT region, da AS donor, m, m AND d >= 3 AS f FROM p UNION ALL SELECT region, db, m, m AND d >= 3 FROM p), n AS (SELECT region, count(DISTINCT donor) AS donors, count(DISTINCT donor) FILTER (WHERE m) AS matched_donors, count(DISTINCT donor) FILTER (WHERE f) AS far_donors FROM s GROUP BY 1)
      SELECT region, count(*) AS pairs, round(quantile_cont(d, 0.5), 6) AS median_all, round(quantile_cont(d, 0.5) FILTER (WHERE m), 6) AS median_matched, any_value(donors) AS donors, any_value(matched_donors) AS matched_donors, any_value(far_donors) AS far_donors,
        CASE WHEN any_value(matched_donors) < 4 THEN 'insufficient support for a narrow contrast' WHEN any_value(far_donors) >= 4 THEN 'discordance observed' ELSE 'broad spread only' END AS support FROM p JOIN n USING (region) GROUP BY 1""",
    "visit_window": """WITH v AS (SELECT user_id AS u, 60 + event_id % 31 AS age, 92 + user_id % 3 - 60 - event_id % 31 AS y, value AS score FROM events WHERE event_id % 7 <> 0) SELECT u, count(*) AS visits, max(y) AS first_gap, min(y) AS last_gap, max(age) - min(age) AS span, max((age, score))[2] AS last_score, count(*) FILTER (WHERE y <= 10) AS in_window,
      round(CASE WHEN count(*) FILTER (WHERE y <= 10) >= 2 THEN avg(score) FILTER (WHERE y <= 10) END, 6) AS window_mean, round(CASE WHEN count(DISTINCT age) >= 2 THEN regr_slope(score, age) END, 6) AS rate FROM v GROUP BY 1""",
    "reference_visit": """WITH v AS (SELECT user_id AS u, CAST(event_id % 997 AS DOUBLE) / 7 AS age, value AS score FROM events), l AS (SELECT u, max((age, score)) AS l FROM v GROUP BY 1), r AS (SELECT u, min((round(abs(l[1] - age - 4), 9), age, score)) AS r, any_value(l) AS l FROM v JOIN l USING (u) GROUP BY 1)
      SELECT u, r[2] AS reference, round(l[1] - r[2], 6) AS gap, round(l[2] - r[3], 6) AS change FROM r WHERE round(l[1] - r[2], 6) >= 3""",
    "first_passing": "WITH b AS (SELECT l_returnflag AS g, l_linenumber AS bin, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1, 2) SELECT g, criterion, min(bin) AS first_bin, arg_min(v, bin) AS value FROM b, (VALUES ('lenient', 51000), ('strict', 50000)) c(criterion, lim) WHERE v < lim GROUP BY 1, 2",
    "reference_row": "WITH k AS (SELECT o_orderpriority AS g, o_orderkey AS r, o_totalprice AS v, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_custkey % 4 > 0) SELECT g, CASE WHEN any_value(n) >= 2 THEN min((round(abs(v - m), 12), r))[2] END AS r FROM k GROUP BY 1",
}
