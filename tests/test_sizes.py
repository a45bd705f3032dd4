"""Work on repeated and crowded rows: results against plain counts, and how many rows a plan makes on its way."""

import math

from lamella.operators import geometry


def most_rows(df):
    """(rows, the most rows that a node of the plan gave out)."""
    rows, most, left = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            of = node.metrics().get("numOutputRows")
            most = max(most, of.get().value() if of.isDefined() else 0)
            left += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def crowd(spark):
    """600 nodes and 6,000 points on a few places."""
    grid = spark.range(600).selectExpr("id", "CAST(id % 3 AS DOUBLE) AS x", "0.25D AS y")
    points = spark.range(6000).selectExpr("id AS p", "CAST(id % 5 AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y", "1 + id % 3 AS m", "(1 + id % 3) * (id % 7) AS q", "CAST(1 + id % 4 AS INT) AS label")
    near = {x: sorted((math.hypot(x - p % 5, 0.25 - p % 2), p) for p in range(6000) if math.hypot(x - p % 5, 0.25 - p % 2) <= 1.5) for x in range(3)}
    return grid, points, near


def test_labels_of_crowded_places(spark):
    grid, points, near = crowd(spark)
    rows, most = most_rows(geometry.reconstructed_labels(grid, points, points.select("p", "label", "m"), "id", "p", ["x", "y"], "label", "m", 0.4, 8, 1.5))
    best = {}
    for x, own in near.items():
        mass = {}
        for d, p in own[:8]:
            mass[1 + p % 4] = mass.get(1 + p % 4, 0) + math.exp(-0.5 * (d / 0.4) ** 2) * (1 + p % 3)
        best[x] = max(mass, key=lambda label: (round(mass[label], 12), -label))
    assert {r["id"]: r["label"] for r in rows} == {i: best[i % 3] for i in range(600)}
    assert most <= 20_000  # 600 nodes by 3,600 near points would be 2,160,000


def test_neighbours_of_crowded_places(spark):
    grid, points, near = crowd(spark)
    rows, most = most_rows(geometry.neighbours(grid, points, "id", "p", ["x", "y"], 4, 1.5))
    assert sorted((r["id"], r["rank"], r["p"], round(r["distance"], 9)) for r in rows) == [(i, k + 1, p, round(d, 9)) for i in range(600) for k, (d, p) in enumerate(near[i % 3][:4])]
    assert most <= 20_000


def test_values_of_crowded_places(spark):
    grid, points, near = crowd(spark)
    rows, most = most_rows(geometry.reconstructed(grid, points, "id", "p", ["x", "y"], "m", "q", 0.4, 8, 1.5))
    for r in rows:
        own = [(math.exp(-0.5 * (d / 0.4) ** 2) * (1 + p % 3), p % 7) for d, p in near[r["id"] % 3][:8]]
        weight = sum(w for w, _ in own)
        assert abs(r["weight"] - weight) < 1e-9 and abs(r["value"] - sum(w * v for w, v in own) / weight) < 1e-9
    assert len(rows) == 600 and most <= 20_000


def test_pair_support_without_pairs(spark):
    """Repeated donors, unknown values and ties against all pairs, which no plan writes."""
    import random
    from statistics import median

    from lamella.operators import matched

    r = random.Random(3)
    some = lambda x: None if r.random() < 0.05 else x
    rows = [(g, some(r.randrange(n // 2)), some(round(r.uniform(-1, 9), 2)), some(float(r.randrange(9))), some(r.uniform(0, 4))) for g, n in (("a", 400), ("b", 90), ("c", 2), ("d", 7)) for _ in range(n)]
    rows += [("e", 1, 1.0, 1.0, 1.0), ("e", 2, 4.0, 3.0, 1.0), ("f", 1, 1.0, 1.0, 1.0), ("f", 1, 2.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0)]
    good = {}
    for g in "abcdef":
        own = [x[1:] for x in rows if x[0] == g and x[1] is not None]
        pairs = [(p, q) for i, p in enumerate(own) for q in own[:i] if p[0] != q[0]]
        near = [(p, q) for p, q in pairs if None not in (p[2:] + q[2:]) and abs(p[2] - q[2]) <= 2 and abs(p[3] - q[3]) <= 1]
        known = lambda of: [abs(p[1] - q[1]) for p, q in of if p[1] is not None and q[1] is not None]
        far = [(p, q) for p, q in near if p[1] is not None and q[1] is not None and abs(p[1] - q[1]) >= 3]
        middle = lambda of: round(median(known(of)), 6) if known(of) else None
        if pairs:
            good[g] = (len(pairs), middle(pairs), middle(near), *(len({x[0] for pair in of for x in pair}) for of in (pairs, near, far)))
    df = spark.createDataFrame(rows, "g string, d int, s double, a double, b double")
    found, most = most_rows(matched.pair_support(df, "g", "d", "s", "a", "b", 2.0, 1.0, 3.0, 4))
    assert {x["g"]: tuple(x)[1:7] for x in found} == good
    assert most <= len(rows)


def test_dealt_products_draw_as_the_window_did(spark):
    """Each repeat's order is that of `draw`, and all rows take part; what is made on the way doesn't grow with the repeats."""
    from hashlib import md5

    from pyspark.sql import functions as F

    from lamella.operators import models

    rows = [(i * 7 % 101, float(i), float(i * i % 13), float(i % 5)) for i in range(60)]
    base = spark.createDataFrame(rows, "_key long, _c0 double, _c1 double, _c2 double").withColumns({f"_t{i}": F.concat_ws("/", F.lit(str(i)), "_key") for i in (1, 2)})
    found, most = most_rows(models.dealt_products(base, 3, 130))
    draw = lambda text, rep: int(md5(f"{text}:{rep // 4}".encode()).hexdigest()[rep % 4 * 8 :][:8], 16)
    assert sorted(x["rep"] for x in found) == list(range(1, 131))
    for x in found:
        columns = [[r[1] for r in sorted(rows)]] + [[r[i + 1] for r in sorted(rows, key=lambda r: draw(f"{i}/{r[0]}", x["rep"]))] for i in (1, 2)]
        assert x["n"] == 60 and x["p"] == [sum(a * b for a, b in zip(p, q)) for p in columns for q in columns]
    assert most <= 60 * 2 * spark.sparkContext.defaultParallelism


def test_residual_permutation_without_repeated_rows(spark):
    from lamella.operators import models

    rows = spark.range(200).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 11 AS DOUBLE) AS z", "CAST(id % 13 + id % 7 AS DOUBLE) AS v")
    found, most = most_rows(models.residual_permutation(rows, "k", "x", "z", "v", 400))
    assert 0.5 < found[0]["slope"] < 1.5 and found[0]["p"] == 1 / 401
    assert most <= 200 * 2 * spark.sparkContext.defaultParallelism


def test_equal_rings_and_places_meet_once(spark):
    """300 points in and 300 left of 200 equal squares, beside a ring of its own and a repeated point."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    corners = [(r, i, x, y) for r in range(200) for i, (x, y) in enumerate(square)] + [(900, 5 - i, x + 1.0, y) for i, (x, y) in enumerate(square)]
    rings = spark.createDataFrame(corners, "ring long, place int, x double, y double")
    points = spark.range(600).selectExpr("id", "CASE id % 2 WHEN 0 THEN 0.5D ELSE -3D END AS x", "1.5D AS y")
    rows, most = most_rows(geometry.in_rings(points, rings, "id", "x", "y", "ring", 1.0))
    assert sorted(map(tuple, rows)) == [(i, r, 1, 1) for i in range(0, 600, 2) for r in range(200)]
    assert most <= 60_000  # its own rows; the points on the left alone meet 120,400 edges
    twice = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.5, 2.0), (2, 4.5, 2.0)], "id long, x double, y double")
    own = rings.where("ring IN (7, 900)")
    assert sorted(map(tuple, geometry.in_rings(twice, own, "id", "x", "y", "ring", 1.0).collect())) == [(1, 7, 1, 1), (1, 900, -2, 2), (2, 900, -1, 1)]


def test_rings_of_many_points_are_written_small(spark, tmp_path):
    """3,000,000 rows in less than 0.3 bytes each: points take the same few rings one after another."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    rings = spark.range(6000).selectExpr("id AS ring", "explode(array(" + ", ".join(f"struct({i} AS place, {x}D AS x, {y}D AS y)" for i, (x, y) in enumerate(square)) + ")) AS c").select("ring", "c.*")
    points = spark.range(500).selectExpr("id", "0.5D AS x", "1.5D AS y")
    geometry.in_rings(points, rings, "id", "x", "y", "ring", 1.0).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.distinct().count() == rows.count() == 3_000_000 and rows.where("winding = 1 AND crossings = 1 AND id < 500 AND ring < 6000").count() == 3_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 900_000


def test_repeated_points_and_rings_count_each_time(spark):
    """300 points given twice, the second time on their own place or outside, and 200 rings, some given three times."""
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    corners = [(r, i, x, y) for r in range(200) for _ in range(1 if r % 10 else 3) for i, (x, y) in enumerate(square)]
    rings = spark.createDataFrame(corners, "ring long, place int, x double, y double")
    points = spark.range(600).selectExpr("id % 300 AS id", "CASE WHEN id >= 300 AND id % 3 = 0 THEN 9D ELSE 0.5D END AS x", "1.5D AS y")
    points = points.union(spark.createDataFrame([(None, 0.5, 1.5), (None, 0.5, 2.5), (900, 0.5, 3.5)], "id long, x double, y double"))
    rows, most = most_rows(geometry.in_rings(points, rings, "id", "x", "y", "ring", 1.0))
    given = {None: 2, 900: 1} | {i: 2 if i % 3 else 1 for i in range(300)}
    good = {(i, r, n * (1 if r % 10 else 3)) for i, n in given.items() for r in range(200)}
    assert {(*x[:2], x[2]) for x in rows} == good and all(x[2] == x[3] for x in rows)
    assert len(rows) == len(good) and most <= len(good)  # not once for each row of a point


def test_mapping_of_more_than_a_million_parts(spark, tmp_path):
    """Part 1000004's id is also the section made up for part 4, of another number: the SQL's rows, no failure."""
    import duckdb

    from lamella import registry

    folder = str(tmp_path)
    spark.createDataFrame([(k,) for k in (2, 3, 4, 12, 1000002, 1000003, 1000004, 1000012)], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    own = registry.queries()["section_mapping"](spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    result = db.execute(registry.oracle_sql()["section_mapping"])
    columns = [c[0] for c in result.description]
    assert sorted(map(str, (tuple(r) for r in own.select(*columns).collect()))) == sorted(map(str, result.fetchall()))


def test_neighbours_of_repeated_queries(spark):
    grid, points, near = crowd(spark)
    again = grid.selectExpr("id % 90 AS id", "CAST(id DIV 90 % 3 AS DOUBLE) AS x", "y")
    places = {}
    for i in range(600):
        places.setdefault(i % 90, []).append(i // 90 % 3)
    rows, most = most_rows(geometry.neighbours(again, points, "id", "p", ["x", "y"], 4, 1.5))
    best = {i: sorted(pair for x in own for pair in near[x])[:4] for i, own in places.items()}
    assert sorted((r["id"], r["rank"], r["p"], round(r["distance"], 9)) for r in rows) == [(i, k + 1, p, round(d, 9)) for i in range(90) for k, (d, p) in enumerate(best[i])]
    assert most <= 20_000


def test_values_of_repeated_points(spark):
    grid, points, near = crowd(spark)
    again = points.crossJoin(spark.range(3).select()).where("p % 2 = 0").union(points.where("p % 2 = 1"))
    rows, most = most_rows(geometry.reconstructed(grid, again, "id", "p", ["x", "y"], "m", "q", 0.4, 8, 1.5))
    for r in rows:
        best = sorted(pair for pair in near[r["id"] % 3] for _ in range(1 if pair[1] % 2 else 3))[:8]
        own = [(math.exp(-0.5 * (d / 0.4) ** 2) * (1 + p % 3), p % 7) for d, p in best]
        weight = sum(w for w, _ in own)
        assert abs(r["weight"] - weight) < 1e-9 and abs(r["value"] - sum(w * v for w, v in own) / weight) < 1e-9
    assert len(rows) == 600 and most <= 30_000
