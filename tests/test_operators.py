"""Operators on tables small enough to check by hand."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lamella.functions import text
from lamella import registry
from lamella.operators import counts, inference, linkage, particles, ranks


def test_names_and_missing_values(spark):
    rows = spark.createDataFrame([(" NaN ",), ("A b-C",), ("",), (None,), ("yes",)], "v string")
    got = [tuple(r) for r in rows.select(text.normalise(F.col("v")), text.simplify(F.col("v")), text.slug(F.col("v"), "field"), text.as_bool(F.col("v"))).collect()]
    assert got == [(None, "nan", "NaN", False), ("A b-C", "abc", "A_b_C", False), (None, "", "field", False), (None, None, "field", False), ("yes", "yes", "yes", True)]


def test_right_closed_bins(spark):
    rows = spark.createDataFrame([(float(x),) for x in (-1, 0, 2, 2.5, 5, 10, 11)], "v double")
    assert [r[0] for r in rows.select(text.right_closed_bin(F.col("v"), [0, 2, 5, 10])).collect()] == [None, 1, 1, 2, 2, 3, None]


def test_average_ranks_share_ties(spark):
    rows = spark.createDataFrame([(1, 10), (1, 20), (1, 20), (1, 5)], "g int, v int")
    assert [r[0] for r in rows.select(ranks.average_rank("v", ["g"]).alias("r")).orderBy("r").collect()] == [1.0, 2.0, 3.5, 3.5]


def test_collisions_go_to_the_nearest_then_the_lower_section(spark):
    rows = spark.createDataFrame([(1, 0.5, 2, "17"), (1, 0.5, 1, "99"), (2, 0.1, 9, "42")], "k int, d double, s int, l string")
    got = {r.k: (r.label, r.candidates, r.same, r.conflicting) for r in ranks.collision_rank(rows, ["k"], "d", "s", "l").collect()}
    assert got == {1: ("99", 2, 1, 1), 2: ("42", 1, 1, 0)}


def test_bins_conserve_mass_and_take_negative_places(spark):
    rows = spark.createDataFrame([(-0.1, 0.0, 1.0), (0.1, 0.1, 2.0), (0.3, 0.1, 2.0)], "x double, y double, m double")
    got = {(r.bx, r.by): (r.n, r.mass, r.cx) for r in particles.bin_2d(rows, "x", "y", "m", 0.5).collect()}
    assert got == {(-1, 0): (1, 1.0, -0.1), (0, 0): (2, 4.0, 0.2)}


def test_nearest_section_keeps_to_its_tolerance(spark):
    asked = spark.createDataFrame([(1, 0.0), (1, 2.5), (1, 30.0)], "g int, at double")
    known = spark.createDataFrame([(1, 0.0), (1, 5.0)], "g int, z double")
    got = {r.at: r.section for r in particles.nearest_support(asked, known, "g", "at", "z", 5.0).collect()}
    assert got == {0.0: 0.0, 2.5: 0.0, 30.0: None}


def test_unmatched_keys_of_both_sides(spark):
    a, b = (spark.createDataFrame([(x,) for x in own], "k string") for own in (["a", "a", "b"], ["b", "c"]))
    assert sorted(map(tuple, linkage.unmatched_audit(a, b, "k").collect())) == [("a", "left"), ("c", "right")]


def test_rows_stay_ambiguous(spark):
    rows = spark.createDataFrame([("d", 1), ("d", 2), ("e", 3)], "k string, u int")
    assert {r.k: r.status for r in linkage.grain_audit(rows, ["k"], "u").collect()} == {"d": "ambiguous", "e": "single_row"}


def test_icc_needs_two_groups_with_several_rows(spark):
    rows = spark.createDataFrame([("f", 1, 1.0), ("f", 1, 1.2), ("f", 2, 3.0), ("f", 2, 3.1), ("g", 1, 1.0), ("g", 2, 2.0)], "f string, g int, v double")
    got = {r.f: r.icc for r in counts.icc_oneway(rows, "f", "g", "v").collect()}
    assert got["g"] is None
    assert 0.98 < got["f"] < 1


def test_normal_scores(spark):
    from statistics import NormalDist

    from lamella.operators import inference

    rows = spark.createDataFrame([("g", float(v)) for v in (3, 1, 2, 2)] + [("g", None)], "g string, v double")
    got = sorted((r.v, r.score) for r in inference.normal_score(rows, ["g"], "v").collect() if r.v is not None)
    want = [NormalDist().inv_cdf((r - 0.375) / 4.25) for r in (1, 2.5, 2.5, 4)]
    assert all(abs(s - w) < 1e-5 for (_, s), w in zip(got, want, strict=True))
    assert [r.score for r in inference.normal_score(rows, ["g"], "v").where("v IS NULL").collect()] == [None]


def test_reshape_cases(spark):
    from lamella.operators import reshape

    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), (None, "x", 3.0)], "k string, n string, v double")
    wide = {r["k"]: (r["x"], r["y"]) for r in reshape.wider(rows, ["k"], "n", "v", ["x", "y"]).collect()}
    assert wide == {"a": (1.0, None), None: (3.0, None)}
    with pytest.raises(Exception, match="comes twice"):
        reshape.wider(rows.union(rows), ["k"], "n", "v", ["x", "y"]).collect()
    assert [tuple(r) for r in reshape.one_hot(rows, "k", "n", ["x"], "drop").orderBy("k").collect()] == [(None, 1), ("a", 1)]
    with pytest.raises(Exception, match="missing or unknown"):
        reshape.one_hot(rows, "k", "n", ["x"]).collect()
    empty = rows.limit(0)
    assert reshape.longer(empty, ["k"], ["v"]).count() == reshape.distinct_list(empty, ["k"], "n").count() == 0
    assert [r["status"] for r in reshape.audit(empty, {"positive": empty["v"] > 0}).collect()] == ["PASS"]


def test_all_particles_feel_all_particles(spark, tmp_path):
    lines = [(i, 1 + i % 3, float(25 + i % 7), (i % 5) / 100, 0.01 * (i % 4)) for i in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    points = [(8 * k + n, q - 25, d * 100, t + 0.01) for k, n, q, d, t in lines]
    got = {r.id: (r.n, r.density) for r in registry.queries()["gauss_kernel_sum"](spark, str(tmp_path)).collect()}
    for i, x, y, _ in points:
        near = [(m, (x - u) ** 2 + (y - v) ** 2) for _, u, v, m in points if (x - u) ** 2 + (y - v) ** 2 <= 12.25]
        assert got.pop(i) == (len(near), pytest.approx(sum(m * math.exp(-d2 / 0.98) for m, d2 in near), abs=2e-6))
    assert not got


def test_library_sizes_count_lines_of_every_status(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 10, "F", 4.0), (1, 10, "O", 2.0), (2, 10, "O", 3.0), (3, 20, "O", 8.0)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linestatus string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["row"]: (r["size"], r.upper_quartile) for r in registry.queries()["library_size_uq"](spark, str(tmp_path)).collect()}
    # counts 0, 3, 6 and 0, 0, 8; the quartile is halfway from the second to the third
    assert got == {10: (9, 0.5), 20: (8, 0.5)}


def test_bootstrap_and_flips_are_as_wide_as_theory(spark):
    """2,000 draws of 400 units: the interval's width is that of the mean's deviation; 5,000 flips reach a p below 0.01."""
    rows = spark.createDataFrame([(i, float(i % 20)) for i in range(400)], "k long, v double")
    got = inference.bootstrap_mean(rows, "k", "v").first()
    sd = math.sqrt(sum((i - 9.5) ** 2 for i in range(20)) / 20 / 400)
    assert got.repeats == 2000
    assert got.high - got.low == pytest.approx(2 * 1.96 * sd, rel=0.1)
    assert inference.sign_flips(rows, "k", "v").first().p == pytest.approx(1 / 5001)
    u = spark.createDataFrame([(x,) for x in (0.3, 0.4, 0.99, 0.9964, 0.9995, 0.9999999)], "u double")
    assert [r[0] for r in u.select(inference.poisson(F.col("u"))).collect()] == [0, 1, 4, 5, 6, 10]


def test_draws_of_units_are_independent(spark):
    """Over 4,000 repeats the draws of two units are uncorrelated, and each is spread evenly."""
    rows = spark.range(1, 4001).select(F.col("id").alias("rep"))
    drawn = rows.select(*(inference.draw(F.lit(k), F.col("rep")).alias(f"u{k}") for k in (1, 2, 3)))
    got = drawn.agg(F.corr("u1", "u2"), F.corr("u1", "u3"), F.corr("u2", "u3"), F.avg("u1"), F.stddev("u2")).first()
    assert all(abs(x) < 0.06 for x in got[:3])
    assert got[3] == pytest.approx(0.5, abs=0.02)
    assert got[4] == pytest.approx(12**-0.5, abs=0.01)


def test_running_sums_with_a_group_of_most_rows(spark):
    """Ranks, corrected p-values and tertiles of a group with nine tenths of the rows, against plain Python."""
    import random

    from lamella.operators import ranks
    from lamella.plans import prefix

    r = random.Random(2)
    rows = [("hot" if r.random() < 0.9 else "cold", i, r.randrange(300) / 7) for i in range(3000)]
    rows += [(None, 5000, 1.0), ("hot", 5001, 2.0)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(7)
    own = {g: sorted(v for h, _, v in rows if h == g) for g in ("hot", "cold", None)}
    for x in prefix.average_ranks(df, ["g"], "v", "rank").collect():
        values = own[x.g]
        assert x["rank"] == values.index(x.v) + (values.count(x.v) + 1) / 2
    for x in prefix.running(df, ["g"], ["v", "i"], {"n": F.lit(1), "s": "v"}, {"low": -F.col("v")}).collect():
        before = sorted((v, i) for h, i, v in rows if h == x.g and (v, i) < (x.v, x.i))
        assert (x.n, x.low) == (len(before), -x.v)
        assert x.s == pytest.approx(sum(v for v, _ in before))
    p = df.where("g IS NOT NULL").withColumn("p", (F.col("v") + 0.01) / 50)
    for x in ranks.benjamini_hochberg(p, "g", "p", "i").where("g = 'cold'").collect():
        values = [(v + 0.01) / 50 for v in own["cold"]]
        assert x.q == pytest.approx(min(1.0, min(w * len(values) / (k + 1) for k, w in enumerate(values) if w >= x.p - 1e-12)), abs=2e-6)
    thirds = [x.by_count for x in ranks.tertiles(df.where("g = 'hot'"), "g", "v", "i").orderBy("v", "i").collect()]
    n = len(thirds)
    assert thirds == [k + 1 for k in range(3) for _ in range(n // 3 + (k < n % 3))]


def test_closure_refuses_cycles_and_repeats(spark):
    from lamella.operators import linkage

    edges = lambda *rows: spark.createDataFrame(list(rows), "node string, parent string")
    got = {(r.node, r.ancestor, r.depth) for r in linkage.closure(edges(("d", "c"), ("c", "b"), ("b", "a"), ("x", None), ("o", "gone"))).collect()}
    assert got == {("d", "c", 1), ("c", "b", 1), ("b", "a", 1), ("d", "b", 2), ("c", "a", 2), ("d", "a", 3), ("o", "gone", 1)}
    with pytest.raises(ValueError, match="own ancestor"):
        linkage.closure(edges(("a", "b"), ("b", "a")))
    with pytest.raises(ValueError, match="given twice"):
        linkage.closure(edges(("a", "b"), ("a", "c")))


def test_factors_of_rows_with_too_few_genes(spark):
    """Rows that share one gene with the reference row, or are in proportion to it, have the factor 1 before scaling."""
    from lamella.operators import factors

    counts = [(1, "a", 10), (1, "b", 20), (1, "c", 30), (1, "d", 5), (2, "a", 20), (2, "b", 40), (2, "c", 60), (2, "d", 10), (3, "a", 7), (3, "z", 70), (3, "y", 3)]
    got = {r["row"]: r.factor for r in factors.trimmed_factors(spark.createDataFrame(counts, "row long, gene string, count long"), "row", "gene", "count").collect()}
    assert len(got) == 3
    assert got[1] == got[2] == got[3] == 1.0


def test_leave_one_out(spark):
    rows = [(i, float(i), 2.0 * i + (i % 3)) for i in range(8)]
    got = {r.k: (r.line, r.mean) for r in inference.fold_error(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y").collect()}
    for k, x, y in rows:
        rest = [(u, v) for i, u, v in rows if i != k]
        mx, my = (sum(c) / 7 for c in zip(*rest, strict=True))
        slope = sum((u - mx) * (v - my) for u, v in rest) / sum((u - mx) ** 2 for u, _ in rest)
        assert got[k] == pytest.approx(((y - my - slope * (x - mx)) ** 2, (y - my) ** 2), abs=1e-4)


def test_stream_drops_late_events(spark, tmp_path):
    """Files come one by one; an event older than the watermark adds nothing, one within it does."""
    import datetime

    from lamella.streaming import windows

    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    files = [[(at(5), "a", 1.0), (at(200), "a", 1.0)], [(at(201), "b", 1.0)], [(at(202), "b", 1.0)], [(at(190), "a", 10.0), (at(6), "a", 100.0)], [(at(210), "b", 1.0)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for file in (tmp_path / "in" / str(i)).glob("*.parquet"):
            import os

            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = windows.run_windows(windows.tumbling(stream, "ts", "event_type", "value"), ["start", "event_type"], f"{tmp_path}/run")
    base = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp())
    got = {((r.start - base) // 60, r.event_type): (r.n, r.total) for r in out.collect()}
    assert got == {(0, "a"): (1, 1.0), (200, "a"): (1, 1.0), (200, "b"): (2, 2.0), (190, "a"): (1, 10.0), (210, "b"): (1, 1.0)}


def test_drawing_transforms():
    from lamella.operators import geometry as g

    assert g.drawing_transform(None) == g.identity()
    m = g.drawing_transform("translate(1 2), rotate(90) scale(2)")
    x, y = (sum(a * b for a, b in zip(row, (3, 1, 1), strict=True)) for row in m[:2])
    assert (x, y) == pytest.approx((1 - 2, 2 + 6))
    for bad in ("rotate(1 2)", "turn(3)", "scale(2) x", "matrix(1 2 3)"):
        with pytest.raises(ValueError):
            g.drawing_transform(bad)
    frame = g.Frames(m, "a", "b")
    with pytest.raises(ValueError):
        frame.then(g.Frames(m, "a", "b"))
    assert [v for row in frame.then(frame.inverse()).matrix for v in row] == pytest.approx([v for row in g.identity() for v in row], abs=1e-12)
    assert g.plane_basis(0, 0)[2] == pytest.approx((0, -1, 0))


def test_places_and_masks_refuse(spark):
    from lamella.operators import geometry as g

    rows = spark.createDataFrame([(1, 1.0, float("nan")), (2, 2.0, 4.0), (3, -1.0, 8.0), (4, None, 1.0)], "id int, x double, y double")
    kept, counts = g.centred_places(rows, ["x", "y"], 2.0, "mean")
    assert tuple(counts.first()) == (4, 2)
    assert sorted((r.id, r.x, r.y) for r in kept.collect()) == [(2, 3.0, -4.0), (3, -3.0, 4.0)]
    with pytest.raises(ValueError):
        g.centred_places(rows, ["x"], 0.0)
    with pytest.raises(ValueError):
        g.masked(rows, "x", "threshold", 99.0)
    with pytest.raises(ValueError):
        g.slab_sides(rows, ["x", "y", "id"], [0, 0, 0], (1, 0, 0), (1, 0, 0), 1.0, "x")
    with pytest.raises(KeyError):
        g.grouped_features(rows.withColumn("f", F.lit("a")), "f", "x", {"one": ["a", "b"]})
    with pytest.raises(ValueError):
        g.grouped_features(rows.withColumn("f", F.lit("a")), "f", "x", {}, [])
    found = g.distinct_candidates([(0.3, 0, 0, 0, False), (0.1, 1, 0, 5, False), (0.2, 0, 0, 350, False), (0.4, 9, 0, 0, False), (0.5, 1, 0, 5, True)], 3)
    assert [c[0] for c in found] == [0.1, 0.4, 0.5]


def test_measures(spark):
    """A measure is 0 away from itself; far ones are the sum of both norms over the second."""
    from lamella.operators import geometry as g

    a = spark.createDataFrame([(0.0, 0.0, "f", 2.0)], "x double, y double, f string, m double")
    b = spark.createDataFrame([(100.0, 0.0, "f", 1.0)], "x double, y double, f string, m double")
    assert g.varifold_distance(a, a, ["x", "y"], "f", "m").first().score == 0
    assert g.varifold_distance(a, b, ["x", "y"], "f", "m").first().score == pytest.approx(5)
    grid = spark.createDataFrame([(0, 0.0, 0.1), (1, 50.0, 0.0)], "n int, x double, y double")
    points = spark.createDataFrame([(7, 0.0, 0.0, 2.0, 6.0)], "p int, x double, y double, m double, q double")
    assert sorted(tuple(r)[:2] for r in g.reconstructed(grid, points, "n", "p", ["x", "y"], "m", "q").collect()) == [(0, pytest.approx(3.0)), (1, 0.0)]


def test_sections_map_or_fail(spark):
    from lamella.operators import crosswalk

    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    sections = frame([(1, 10), (2, 20), (3, 30), (4, 30), (5, 50)], ("section", "number"))
    none = frame([], ("image", "section"))
    files = frame([(70,)], ("number",))
    run = lambda plates, cached=none: {r.image: (r.section, r.status) for r in crosswalk.section_mapping(frame(plates, ("image", "number")), sections, cached, files).collect()}
    assert run([(1, 10), (9, 20), (8, 70), (7, 99)]) == {1: (1, "exact_id"), 9: (2, "repaired_unique_section"), 8: (None, "filename_only"), 7: (None, "unresolved")}
    assert run([(9, 30)], frame([(9, 3)], ("image", "section"))) == {9: (3, "repaired_unique_section")}
    for plates, cached, say in (([(9, 30)], none, "several sections"), ([(1, 11)], none, "number differs"), ([(9, 1)], frame([(9, 77)], ("image", "section")), "unknown"), ([(1, 10)], frame([(1, 2)], ("image", "section")), "differ")):
        with pytest.raises(Exception, match=say):
            run(plates, cached)


def test_counts_that_are_none(spark):
    from lamella.operators import matched

    mapping = spark.createDataFrame([(1, "g")], "c int, grp string")
    run = lambda count: matched.exact_sums(spark.createDataFrame([(1, "x", count), (1, "x", 2.0)], "c int, gene string, n double"), mapping, "c", "grp", "gene", "n").collect()
    assert run(3.0)[0].n == 5
    for bad in (1.5, -1.0, float("nan"), None):
        with pytest.raises(Exception, match="no count"):
            run(bad)


def test_matched_draws_never_take_the_signature_or_a_gene_twice(spark):
    from lamella.operators import matched

    genes = [("d", f"g{i}", i // 10, float(i)) for i in range(60)]
    df = spark.createDataFrame(genes, "d string, g string, place int, a double")
    signature = spark.createDataFrame([("d", f"g{i}") for i in (*range(50, 58), 3, 12)], "d string, g string")
    got = matched.matched_draws(df, signature, "d", "g", 30).collect()
    own = {r.g for r in signature.collect()}
    by = {}
    for r in got:
        by.setdefault(r.draw, []).append(r)
    assert len(by) == 30
    for rows in by.values():
        names = [r.g for r in rows]
        assert len(names) == len(set(names)) == len(own)
        assert not own & set(names)
        # the last stratum has two partners for eight genes; six come from the one before it
        assert sorted(r.place for r in rows) == [0, 1, *[4] * 6, 5, 5]
        assert sum(r.borrowed for r in rows) == 6
    assert len({tuple(sorted(r.g for r in rows)) for rows in by.values()}) > 20


def test_configs_and_drift():
    from lamella.operators import selection

    merged = selection.merged_config({"a": [[1]], "b": {"c": [2, 3], "d": 4}}, {"b": {"d": [5]}, "e": 6}, ["a", "e"])
    assert merged == {"a": 1, "b": {"c": [2, 3], "d": 5}, "e": 6}
    with pytest.raises(ValueError, match="missing"):
        selection.merged_config({}, {}, ["a"])
    one, two = {"files": [{"k": 1, "timestamp": 3}]}, {"files": [{"timestamp": 9, "k": 1}]}
    assert not selection.drifted(one, two)
    assert selection.drifted(one, {"files": []})
    import hashlib

    assert not selection.drifted(one, {"files": []}, hashlib.sha256(b'{"files":[{"k":1}]}').hexdigest())


def test_states_and_channels_refuse(spark):
    from lamella.operators import selection

    planes = spark.createDataFrame([(1, 1), (1, 2)], "g int, z int")
    known = spark.createDataFrame([(5,)], "id int")
    frame = lambda *rows: spark.createDataFrame(list(rows), "g int, z int, labels array<int>")
    run = lambda o, i: sorted(map(tuple, selection.plane_states(planes, o, i, ["g", "z"], "labels", known).collect()))
    assert run(frame((1, 1, [5])), frame((1, 1, [5]), (1, 2, [5]))) == [(1, 1, "LABELED"), (1, 2, "INFERRED")]
    with pytest.raises(Exception, match="unknown label 6"):
        run(frame((1, 1, [6])), frame())
    with pytest.raises(Exception, match="no such plane 1/9"):
        run(frame(), frame((1, 9, [5])))
    active = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 0, 6)], "g string, y int, x int, l long")
    with pytest.raises(Exception, match="several labels at a/0/0"):
        selection.decoded_channels(active, "g", ["y", "x"], "l").collect()


def test_models_against_numpy(spark):
    import numpy as np

    from lamella.operators import models

    r = np.random.default_rng(4)
    n = 300
    x = r.standard_normal((n, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + r.standard_normal(n) + 1e4
    cluster = r.integers(0, 20, n)
    rows = [(int(i), int(cluster[i]), *map(float, x[i]), float(y[i]), "g") for i in range(n)] + [(n, 1, None, 1.0, 1.0, 1.0, 1.0, "g")]
    df = spark.createDataFrame(rows, "k long, c int, x0 double, x1 double, x2 double, x3 double, y double, g string")
    fit = lambda cols: np.linalg.lstsq(np.column_stack([np.ones(n), x[:, cols]]), y, rcond=None)
    rss = lambda cols: float(((y - np.column_stack([np.ones(n), x[:, cols]]) @ fit(cols)[0]) ** 2).sum())
    tss = float(((y - y.mean()) ** 2).sum())
    got = models.redundancy(df, ["g"], "y", {"a": ["x0", "x1"], "b": ["x2", "x3"]}).first()
    assert (got.n, got.r2) == (n, pytest.approx(1 - rss([0, 1, 2, 3]) / tss, abs=1e-6))
    assert got.unique_a == pytest.approx((rss([2, 3]) - rss([0, 1, 2, 3])) / tss, abs=1e-6)
    f = models.nested_f(df, ["g"], "y", ["x0"], ["x1", "x2", "x3"]).first()
    assert f.f == pytest.approx((rss([0]) - rss([0, 1, 2, 3])) / 3 / (rss([0, 1, 2, 3]) / (n - 5)), rel=1e-6)
    short = models.redundancy(df.limit(5), ["g"], "y", {"a": ["x0"]}).first()
    assert short.r2 is None
    wald = models.robust_wald(df, ["g"], "c", ["x0", "x1", "x2"], "y").first()
    z = np.column_stack([np.ones(n), x[:, :3]])
    b, e = fit([0, 1, 2])[0], y - z @ fit([0, 1, 2])[0]
    inverse = np.linalg.inv(z.T @ z)
    meat = sum(np.outer(u, u) for u in (z[cluster == c].T @ e[cluster == c] for c in np.unique(cluster)))
    g = len(np.unique(cluster))
    v = (inverse @ meat @ inverse * (g / (g - 1)) * ((n - 1) / (n - 4)))[1:, 1:]
    assert wald.f == pytest.approx(float(b[1:] @ np.linalg.inv(v) @ b[1:]) / 3, rel=1e-4)
    components = models.principal(df.dropna(), "k", ["x0", "x1", "x2", "x3"], 30).orderBy("component").collect()
    assert [c.value for c in components] == pytest.approx(sorted(np.linalg.eigvalsh(np.corrcoef(x.T)), reverse=True), abs=1e-3)
    assert not any(c.kept for c in components)


def test_shift_candidates_find_a_known_placement(spark):
    """A measure that was turned by 90 degrees, flipped and moved is found again."""
    import random

    from lamella.operators import alignment

    r = random.Random(3)
    points = [(r.uniform(-8, 8), r.uniform(-5, 5), r.choice("ab"), 1.0) for _ in range(150)]
    frame = lambda rows: spark.createDataFrame(rows, "x double, y double, feature string, m double")
    # flipped (x to -x), turned by 90 degrees ((x, y) to (-y, x)), then moved by (3, -2)
    fixed = frame([(-y + 3, -x - 2, f, m) for x, y, f, m in points])
    got = alignment.shift_candidates(frame(points), fixed, ["a", "b"], [0, 90, 180, 270], [1.0], [False, True], 0.5, 64, 1.0).orderBy(F.col("score").desc()).first()
    assert (got.angle, got.flip) == (90.0, True)
    assert (got.dx, got.dy) == pytest.approx((3, -2), abs=0.51)
    assert 0.9 < got.score <= 1.0 + 1e-9
