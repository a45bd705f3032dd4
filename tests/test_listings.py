"""Listings, selections, records, drawings and archives, without a network."""

import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.sources import listings, readers, sinks

PAGE = '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">{}{}</ListBucketResult>'
ITEM = "<Contents><Key>{}</Key><Size>{}</Size><LastModified>2024-01-0{}T00:00:00Z</LastModified></Contents>"


def store(prefix, token):
    """Two pages of one prefix, one of another, none of a third."""
    if prefix == "none/":
        raise urllib.error.HTTPError("u", 404, "no", None, None)
    if prefix == "a/" and token is None:
        return PAGE.format(ITEM.format("a/x/1.csv", 5, 1) + ITEM.format("a/", 0, 1), "<NextContinuationToken>t</NextContinuationToken>").encode()
    if prefix == "a/":
        return PAGE.format(ITEM.format("a/x/2.csv", 7, 2) + ITEM.format("a/skip/3.csv", 9, 3), "").encode()
    return PAGE.format(ITEM.format("b/1.csv", 1, 4), "").encode()


def test_listing(spark):
    objects, left_out = listings.listing(spark, store, ["a/", "b/", "none/"], ["skip"])
    assert sorted((r.key, r.size_bytes, r.last_modified[:10]) for r in objects.collect()) == [("a/x/1.csv", 5, "2024-01-01"), ("a/x/2.csv", 7, "2024-01-02"), ("b/1.csv", 1, "2024-01-04")]
    assert [tuple(r) for r in left_out.collect()] == [("skip", 1)]
    assert [tuple(r) for r in listings.folders(objects, "a/").collect()] == [("a/x/", 2, 12)]


def test_fetch_waits_and_gives_up():
    waits, failures = [], [OSError("reset")] * 3

    def fetch(prefix, token):
        if failures:
            raise failures.pop()
        return PAGE.format("", "").encode()

    assert len(list(listings.pages(fetch, "p", waits.append))) == 1
    assert waits == [1, 2, 4]
    failures += [OSError("reset")] * 4
    with pytest.raises(OSError, match="reset"):
        list(listings.pages(fetch, "p", waits.append))


def test_selection(spark, tmp_path):
    item = {"release": 1, "object_family": "f", "lineage": "l", "s3_key": "k", "size_bytes": "12", "local_path": "in/k"}
    whole = {"source_bucket": "b", "inventory_manifest": "m", "provenance_path": "p", "items": [item]}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(whole, indent=1))
    facts, rows = listings.selection(spark, str(path))
    assert facts["source_bucket"] == "b"
    assert [tuple(r) for r in rows.collect()] == [("1", "f", "l", "k", 12, "in/k")]
    assert [tuple(r) for r in listings.fetch_plan(rows, "/data/").collect()] == [("k", 12, "/data/in/k")]
    with pytest.raises(Exception, match="leaves the root"):
        listings.fetch_plan(rows.withColumn("local_path", F.lit("../k")), "/data").collect()
    for broken, say in ((whole | {"items": []}, "no items"), ({"items": [item]}, "lacks"), (whole | {"items": [{}]}, "item 1 lacks"), (whole | {"items": [item | {"size_bytes": "x"}]}, "item 1")):
        path.write_text(json.dumps(broken))
        spark.catalog.refreshByPath(str(path))
        with pytest.raises(ValueError, match=say):
            listings.selection(spark, str(path))


def test_records(spark):
    one = {"id": 1, "treatments": [{"name": "NISSL"}, {"name": "other"}], "section_images": [{"id": 10, "section_number": 3, "width": 5, "height": 6}]}
    answer = json.dumps({"success": True, "msg": [one]})
    assert [tuple(r) for r in listings.section_records(spark, [answer], {"NISSL": "nissl"}).collect()] == [(1, "nissl", 10, 3, 5, 6)]
    with pytest.raises(Exception, match="isn't one kind"):
        listings.section_records(spark, [answer], {}).collect()
    with pytest.raises(Exception, match="comes twice"):
        listings.section_records(spark, [answer, answer], {"NISSL": "nissl"}).collect()


def drawing(path, body):
    path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg">{body}</svg>')


def test_drawings(spark, tmp_path):
    group = '<g graphic_group_label_id="{}" graphic_group_label="{}">{}</g>'
    shape = '<path structure_id="{}" d="M0 0L1 1" transform="scale(2)"/>'
    drawing(tmp_path / "a.svg", group.format(2, "two", "<g>" + shape.format(5) + "</g>" + shape.format(6)) + group.format(1, "one", shape.format(5)))
    shapes = listings.drawings(spark, str(tmp_path / "a.svg"), {1: "one", 2: "two"}, [5, 6])
    assert [(r.place, r.grp, r.structure, r.transform) for r in shapes.orderBy("place").collect()] == [(0, 2, 5, "scale(2)"), (1, 2, 6, "scale(2)"), (2, 1, 5, "scale(2)")]
    assert sorted((r.order, r.grp, r.shapes, r.structures) for r in listings.drawing_groups(shapes).collect()) == [(1, 2, 2, 2), (2, 1, 1, 1)]
    for body, say in ((shape.format(5), "without a group"), (group.format(2, "two", shape.format(9)), "unknown structure 9"), (group.format(2, "deux", ""), "deux"), (group.format(3, "x", ""), "group 3")):
        drawing(tmp_path / "b.svg", body)
        with pytest.raises(Exception, match=say):
            listings.drawings(spark, str(tmp_path / "b.svg"), {1: "one", 2: "two"}, [5, 6]).collect()


def test_fetch_one(tmp_path):
    target = str(tmp_path / "x" / "f")
    come = lambda data, stated=None: lambda key: (stated, iter([data]))
    assert listings.fetch_one(come(b"123"), "k", 3, target) == "fetched"
    assert listings.fetch_one(come(b"zzz"), "k", 3, target) == "present"
    with pytest.raises(FileExistsError):
        listings.fetch_one(come(b"1234"), "k", 4, target)
    assert listings.fetch_one(come(b"12"), "k", 3, str(tmp_path / "g")) == "quarantined"
    assert (tmp_path / "g.quarantine").read_bytes() == b"12"
    assert not (tmp_path / "g").exists()
    with pytest.raises(ValueError, match="offered"):
        listings.fetch_one(come(b"12", 2), "k", 3, str(tmp_path / "h"))


def test_particles_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0, [0.0, 4.0]), (0, 0.5, 0.0, -1.0, [3.0, 1.0])], "particle long, x double, y double, z double, nu array<double>")
    assert listings.save_particles(rows, str(tmp_path / "p.npz"), ["a", "b"], {"k": 1}) == {"particles": 2, "mass": 8.0}
    metadata, back = listings.particles(spark, str(tmp_path / "p.npz"), "nu")
    assert metadata == {"k": 1, "labels": ["a", "b"]}
    assert [tuple(r) for r in back.orderBy("particle").collect()] == [(0, 0.5, 0.0, -1.0, [3.0, 1.0]), (1, 1.0, 2.0, 3.0, [0.0, 4.0])]
    with np.load(tmp_path / "p.npz") as kept:
        assert kept["largest"].tolist() == [1, 2]
        assert kept["entropy"].tolist() == pytest.approx([-(0.75 * np.log(0.75) + 0.25 * np.log(0.25)), 0.0])
    np.savez(tmp_path / "bad.npz", X=np.zeros((1, 3)), nu=np.array([[-1.0]]))
    with pytest.raises(ValueError, match="not negative"):
        listings.particles(spark, str(tmp_path / "bad.npz"), "nu")
    shape = listings.grid_geometry([[2, 0, 0, 1], [0, 0, -3, 0], [0, 1, 0, 0], [0, 0, 0, 1]], (3, 4, 5))
    assert shape == {"spacing": [2.0, 1.0, 3.0], "low": [1.0, -12.0, 0.0], "high": [5.0, 0.0, 3.0]}


def test_pinned_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    digest = listings.digest_of(str(tmp_path / "f"))
    assert bytes(listings.pinned(spark, str(tmp_path / "f"), digest).first().content) == b"abc"
    with pytest.raises(Exception, match="digest differs"):
        listings.pinned(spark, str(tmp_path / "f"), "0" * 64).collect()


def test_more_sinks(spark, tmp_path):
    import gzip

    rows = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "cell int, gene string, n int")
    assert sinks.write_long_genes(rows, str(tmp_path / "g.csv.gz"), ["cell", "gene", "n"], ["z", "x"], "gene") == 1
    assert gzip.open(tmp_path / "g.csv.gz", "rt").read().splitlines() == ["cell,gene,n", "1,x,2"]
    assert (tmp_path / "g.csv.gz.missing_genes.txt").read_text() == "z\n"
    with pytest.raises(ValueError, match="csv"):
        sinks.write_long_genes(rows, str(tmp_path / "g.txt"), ["gene"], ["x"], "gene")
    assert sinks.write_or_csv(rows, str(tmp_path / "t")) == "parquet"
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    (tmp_path / "blocked").write_text("a file where the folder should be")
    assert sinks.write_or_csv(rows, str(tmp_path / "blocked")).startswith("csv: ")
    assert (tmp_path / "blocked.csv").read_text().splitlines()[0] == "cell,gene,n"


def test_workbooks_and_headers(spark, tmp_path):
    from tests.test_sources import workbook

    workbook(tmp_path / "t.xlsx")
    tables, notes = readers.workbook(spark, str(tmp_path / "t.xlsx"), skip="README")
    assert list(tables) == ["A"] and notes == []
    assert tables["A"].columns == ["donor id", "7", "c 1"]
    tables, notes = readers.workbook(spark, str(tmp_path / "t.xlsx"), skip="A")
    assert tables == {} and notes[0] == "donor id 7 c\n1"
    row = spark.createDataFrame([("H20.33.001-A06-NEUN.svs", "Aperio|MPP = 0.25|x")], "name string, text string")
    got = row.select(readers.slide(F.col("name"), F.col("text")).alias("s")).first().s
    assert (got.donor, got.block, got.stain, got.mpp) == ("H20.33.001", "A06", "NEUN", 0.25)
    for name, text, say in (("x.svs", "MPP=1", "name"), ("H20.33.001-A06-NEUN.svs", "none", "MPP")):
        with pytest.raises(Exception, match=say):
            spark.createDataFrame([(name, text)], "name string, text string").select(readers.slide(F.col("name"), F.col("text"))).collect()
