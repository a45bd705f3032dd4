"""Readers and sinks on small files made here."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lamella.sources import readers, sinks


def fails(df):
    with pytest.raises(Exception) as error:
        df.collect()
    return str(error.value)


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>donor id</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c\n1</t></is></c><c r="B1"><v>7</v></c></row><row><c r="C2" t="s"><v>1</v></c></row><row/><row><c r="B4"><v>4</v></c><c><v>5</v></c></row>'
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "t.xlsx")
    rows = readers.donor_table(spark, str(tmp_path / "t.xlsx"), "A")
    assert rows.columns == ["Donor ID", "7", "c 1"]
    # the last cell has no reference: it stands right of the one before it
    assert sorted(tuple(r) for r in rows.collect()) == [("", "", ""), ("", "", "ab"), ("", "4", "5")]
    with pytest.raises(Exception, match="no sheet"):
        readers.sheet_table(spark, str(tmp_path / "t.xlsx"), "B")
    with pytest.raises(ValueError, match="neither"):
        readers.donor_table(spark, "t.txt")


def test_inventory_and_optional(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" key ,size_bytes\nx,12\ny, 3\n")
    assert [tuple(r) for r in readers.inventory(spark, str(tmp_path / "a.csv")).collect()] == [("x", 12), ("y", 3)]
    (tmp_path / "b.csv").write_text("key,size_bytes\nx,12\nbroken,1.5k\n")
    assert "broken" in fails(readers.inventory(spark, str(tmp_path / "b.csv")))
    (tmp_path / "c.csv").write_text("key\nx\n")
    with pytest.raises(ValueError, match="size_bytes"):
        readers.inventory(spark, str(tmp_path / "c.csv"))
    assert readers.optional_csv(spark, str(tmp_path / "none.csv")) is None


def test_gene_sets(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("S\td\tB\tA\tB\n\nT\t\tC\n")
    got = sorted((r.set, r.place, r.gene) for r in readers.gene_sets(spark, str(tmp_path / "a.gmt")).collect())
    assert got == [("S", 0, "B"), ("S", 1, "A"), ("T", 0, "C")]
    (tmp_path / "b.gmt").write_text("S\td\n")
    assert "fewer than three" in fails(readers.gene_sets(spark, str(tmp_path / "b.gmt")))


def test_ordered_groups(spark):
    rows = spark.createDataFrame([("g", "b", 3), ("g", "a", 1), ("g", " b", 0), ("g", " ", 2), ("h", None, 1)], "g string, i string, o int")
    assert sorted(tuple(r) for r in readers.ordered_groups(rows, "g", "i", "o").collect()) == [("g", "a", 1), ("g", "b", 0)]


def test_rings(spark, tmp_path):
    v = '<V X="1" Y="2"/>'
    (tmp_path / "a.annotations").write_text(f'<Annotations><Annotation Name=" Grey "><Regions><Region NegativeROA="1"><Vertices>{v * 3}</Vertices></Region><Region NegativeROA="0"><Vertices>{v * 2}</Vertices></Region></Regions></Annotation></Annotations>')
    assert [(r.layer, r.hole, len(r.ring), r.ring[0].x) for r in readers.rings(spark, str(tmp_path / "a.annotations")).collect()] == [("grey", True, 3, 1.0)]


def test_slide_header(spark):
    row = spark.createDataFrame([("Aperio v1|MPP = 0.25|Title = a=b",)], "t string").select(readers.slide_header(F.col("t")).alias("m")).first()
    assert row.m == {"MPP": "0.25", "Title": "a=b"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "x,y")], "a int, b string")
    path = tmp_path / "o.csv"
    assert sinks.write_csv(rows, str(path), ["b", "a"], ["a"]) == 2
    assert path.read_text().splitlines() == ["b,a", '"x,y",1', ",2"]
    with pytest.raises(ValueError, match="no columns"):
        sinks.write_csv(rows, str(path), [])
    sinks.write_provenance(str(tmp_path / "p.json"), {"b": 1, "a": None})
    assert (tmp_path / "p.json").read_text() == '{\n  "a": null,\n  "b": 1\n}\n'
    sinks.write_table(rows, str(tmp_path / "t"), ["a"])
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_table(rows, str(tmp_path / "t"))
