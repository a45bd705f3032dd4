"""Volume files, archives, chunked labels and plane stores on small arrays."""

import gzip
import io
import json
import os
import struct
import tarfile

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lamella.sources import volumes

AFFINE = [[0, -2.0, 0, 5], [1.5, 0, 0, -1], [0, 0, 3.0, 2], [0, 0, 0, 1]]


def image():
    r = np.random.default_rng(1)
    return r.integers(0, 3, (3, 4, 5)).astype("i2")


def test_volume_files(spark, tmp_path):
    data = volumes.volume_bytes(image(), AFFINE)
    header, back = volumes.voxels(gzip.compress(data))
    assert header["shape"] == [3, 4, 5]
    assert np.allclose(header["affine"], AFFINE)
    assert (back == image()).all()
    (tmp_path / "a.nii.gz").write_bytes(gzip.compress(data))
    rows = volumes.volume_rows(spark, str(tmp_path / "a.nii.gz"))
    want = {(*map(int, at), float(image()[tuple(at)])) for at in np.argwhere(image())}
    assert {tuple(r)[1:] for r in rows.collect()} == want
    assert volumes.write_volume(rows, str(tmp_path / "b.nii"), (3, 4, 5), AFFINE) == len(want)
    assert (volumes.voxels((tmp_path / "b.nii").read_bytes())[1] == image()).all()
    with pytest.raises(ValueError, match="outside"):
        volumes.write_volume(rows, str(tmp_path / "c.nii"), (2, 4, 5), AFFINE)
    assert not (tmp_path / "c.nii").exists()
    with pytest.raises(ValueError, match="not a volume"):
        volumes.volume_header(b"x" * 400)


def test_volume_headers_of_turned_grids():
    """The quaternion form, and neither form, give the same places as the specification's formulas."""
    data = bytearray(volumes.volume_bytes(image(), np.diag([2.0, 3.0, 4.0, 1.0])))
    struct.pack_into("<2h", data, 252, 1, 0)
    struct.pack_into("<6f", data, 256, 0.0, 0.0, 2**-0.5, 7.0, 8.0, 9.0)
    got = np.array(volumes.volume_header(bytes(data))["affine"])
    assert np.allclose(got, [[0, -3, 0, 7], [2, 0, 0, 8], [0, 0, 4, 9], [0, 0, 0, 1]], atol=1e-6)
    struct.pack_into("<2h", data, 252, 0, 0)
    assert np.allclose(volumes.volume_header(bytes(data))["affine"], np.diag([2.0, 3.0, 4.0, 1.0]))


def test_archives():
    def archive(*names):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name in names:
                data = gzip.compress(struct.pack(">4i", 1, 7, 8, 9)) if name.endswith("mgz") else volumes.volume_bytes(image(), AFFINE)
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return out.getvalue()

    found = volumes.archive_rows(archive("a/T1.mgz", "a/notes.txt", "b/x.nii"))
    assert [(f["name"], f["shape"]) for f in found] == [("a/T1.mgz", [7, 8, 9]), ("b/x.nii", [3, 4, 5])]
    assert volumes.only_candidate(found, "T1")["name"] == "a/T1.mgz"
    with pytest.raises(ValueError, match="2 files"):
        volumes.only_candidate(found, "/")
    with pytest.raises(ValueError, match="leaves the archive"):
        volumes.archive_rows(archive("../T1.mgz"))


def test_chunked_labels(spark, tmp_path):
    labels = [([y, x], int(v)) for (y, x), v in np.ndenumerate(np.arange(35).reshape(5, 7)) if v % 3]
    rows = spark.createDataFrame(labels, "index array<long>, label long")
    digest = volumes.write_labels(rows, str(tmp_path / "g" / "one"), (5, 7), (2, 4))
    assert digest == volumes.tree_digest(str(tmp_path / "g" / "one"))
    got = volumes.label_rows(spark, str(tmp_path / "g"), ["one"]).collect()
    assert sorted((r["index"], r["label"]) for r in got) == sorted(labels)
    with pytest.raises(FileExistsError):
        volumes.write_labels(rows, str(tmp_path / "g" / "one"), (5, 7), (2, 4))
    for bad in (([9, 0], 1), ([0, 0], -1), ([0, 0], 1 << 32)):
        with pytest.raises(Exception, match="out of range"):
            volumes.write_labels(spark.createDataFrame([bad], "index array<long>, label long"), str(tmp_path / "bad"), (5, 7), (2, 4))
        assert not (tmp_path / "bad").exists()
    # other packings, a chunk that isn't there, and one that reaches beyond the extent
    for name, pack in (("zstd", zstandard.ZstdCompressor().compress), ("gzip", gzip.compress), (None, bytes)):
        folder = tmp_path / f"h{name}" / "a"
        os.makedirs(folder)
        meta = {"zarr_format": 2, "shape": [3, 3], "chunks": [2, 2], "dtype": "<u2", "compressor": {"id": name} if name else None, "fill_value": 0, "order": "C", "filters": None}
        (folder / ".zarray").write_text(json.dumps(meta))
        (folder / "1.1").write_bytes(pack(np.array([[5, 6], [7, 8]], "<u2").tobytes()))
        assert [(r["index"], r["label"]) for r in volumes.label_rows(spark, str(folder.parent), ["a"]).collect()] == [([2, 2], 5)]
    os.symlink(tmp_path / "g", tmp_path / "g" / "one" / "link")
    with pytest.raises(ValueError, match="link"):
        volumes.tree_digest(str(tmp_path / "g" / "one"))
    os.unlink(tmp_path / "g" / "one" / "link")
    (tmp_path / "g" / "one" / "x.part").write_text("")
    with pytest.raises(ValueError, match="unfinished"):
        volumes.tree_digest(str(tmp_path / "g" / "one"))


def test_plane_store(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "grp int, z int, y int, x int, label long")
    path = str(tmp_path / "store")
    assert volumes.store_planes(frame((1, 1, 0, 0, 5), (1, 2, 0, 0, 6)), path, observed=False) == [(1, 1), (1, 2)]
    assert volumes.store_planes(frame((1, 2, 0, 1, 7)), path, observed=True) == [(1, 2)]
    got = {(r.grp, r.z, r.y, r.x, r.label, r.state) for r in volumes.read_planes(spark, path).select("grp", "z", "y", "x", F.col("label"), "state").collect()}
    assert got == {(1, 1, 0, 0, 5, "inferred"), (1, 2, 0, 1, 7, "observed")}
    for rows, observed in ((frame((1, 2, 0, 0, 1)), True), (frame((1, 1, 0, 0, 1)), False)):
        with pytest.raises(FileExistsError, match="are there"):
            volumes.store_planes(rows, path, observed)
