"""Volumes and planes: headers of volume files, archives of them, chunked label arrays, and a store of dense planes.
Voxels travel as rows of indexes and values, zeros left out; each chunk or plane is one task's work."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
import math
import os
import shutil
import struct
import tarfile
import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the volume format: sample codes and their types.
SAMPLES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER, VOXELS_AT = 348, 352


def volume_header(data: bytes) -> dict:
    """Shape, sample type, places of values, scaling, and the matrix from indexes to places, of a volume file's bytes."""
    order = next((o for o in "<>" if len(data) >= HEADER and struct.unpack(f"{o}i", data[:4])[0] == HEADER), None)
    if order is None or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a volume file")
    dims = struct.unpack(f"{order}8h", data[40:56])
    code = struct.unpack(f"{order}h", data[70:72])[0]
    spacing = struct.unpack(f"{order}8f", data[76:108])
    offset, slope, start = struct.unpack(f"{order}3f", data[108:120])
    qform, sform = struct.unpack(f"{order}2h", data[252:256])
    if not 1 <= dims[0] <= 7 or code not in SAMPLES:
        raise ValueError(f"unreadable volume: {dims[0]} axes, sample code {code}")
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack(f"{order}12f", data[280:328])).reshape(3, 4)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack(f"{order}6f", data[256:280])
        a = math.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * [spacing[1], spacing[2], spacing[3] * (-1 if spacing[0] < 0 else 1)]
        affine[:3, 3] = x, y, z
    else:
        affine[range(3), range(3)] = spacing[1:4]
    return {"shape": list(dims[1 : dims[0] + 1]), "dtype": order + SAMPLES[code], "offset": int(offset), "slope": slope or 1.0, "start": start if slope else 0.0, "affine": affine.tolist()}


def unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def voxels(data: bytes) -> tuple[dict, np.ndarray]:
    """(header, values) of a volume file, packed or not, scaled as it says."""
    raw = unpacked(data)
    header = volume_header(raw)
    flat = np.frombuffer(raw, header["dtype"], math.prod(header["shape"]), max(header["offset"], VOXELS_AT))
    image = flat.reshape(header["shape"], order="F")
    return header, image if (header["slope"], header["start"]) == (1.0, 0.0) else image * header["slope"] + header["start"]


def volume_bytes(image: np.ndarray, affine: Sequence[Sequence[float]]) -> bytes:
    """A volume file of an array of three axes, with its matrix."""
    kind = next(code for code, t in SAMPLES.items() if np.dtype(t) == image.dtype.newbyteorder("="))
    header = bytearray(VOXELS_AT)
    a = np.asarray(affine, float)
    struct.pack_into("<i", header, 0, HEADER)
    struct.pack_into("<8h", header, 40, image.ndim, *image.shape, *[1] * (7 - image.ndim))
    struct.pack_into("<2h", header, 70, kind, 8 * image.dtype.itemsize)
    struct.pack_into("<8f", header, 76, 1.0, *np.linalg.norm(a[:3, :3], axis=0), *[1.0] * 4)
    struct.pack_into("<3f", header, 108, float(VOXELS_AT), 1.0, 0.0)
    struct.pack_into("<2h", header, 252, 0, 1)
    struct.pack_into("<12f", header, 280, *a[:3].ravel())
    header[344:348] = b"n+1\0"
    return bytes(header) + image.astype(image.dtype.newbyteorder("<")).tobytes(order="F")


def _volume_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            _, image = voxels(content.as_py())
            at = np.nonzero(image.reshape((*image.shape, *[1] * (3 - image.ndim))[:3] if image.ndim < 3 else image.shape[:3]))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at[0])), *(pa.array(x, pa.int32()) for x in at), pa.array(image.reshape(-1)[np.ravel_multi_index(at, image.shape[:3])] if image.ndim == 3 else image[image != 0], pa.float64())], ["path", "i", "j", "k", "value"])


def volume_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, k, value) of the voxels of volume files that aren't 0."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_volume_rows, "path string, i int, j int, k int, value double")


def write_volume(rows: DataFrame, path: str, shape: Sequence[int], affine: Sequence[Sequence[float]], dtype: str = "f4") -> int:
    """(i, j, k, value) rows as one volume file on a reference grid, 0 elsewhere; it appears when it is whole. Rows outside
    the grid fail."""
    image = np.zeros(tuple(shape), dtype)
    n = 0
    for row in rows.select("i", "j", "k", "value").toLocalIterator():
        if not all(0 <= row[a] < shape[a] for a in range(3)):
            raise ValueError(f"voxel {tuple(row)[:3]} lies outside of {tuple(shape)}")
        image[row[0], row[1], row[2]] = row[3]
        n += 1
    with open(f"{path}.part", "wb") as file:
        file.write(volume_bytes(image, affine))
    os.replace(f"{path}.part", path)
    return n


def archive_rows(data: bytes, suffixes: Sequence[str] = (".mgz", ".nii", ".nii.gz")) -> list[dict]:
    """The volume files of a tar archive: name, bytes and shape. A name that leaves the archive fails, and links don't
    count."""
    out = []
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        for member in archive:
            parts = member.name.split("/")
            if member.name.startswith("/") or ".." in parts:
                raise ValueError(f"name leaves the archive: {member.name}")
            if not member.isfile() or not member.name.endswith(tuple(suffixes)):
                continue
            raw = unpacked(archive.extractfile(member).read())
            # the other format: version 1, then the extents, all big-endian
            shape = list(struct.unpack(">3i", raw[4:16])) if member.name.endswith(".mgz") else volume_header(raw)["shape"]
            out.append({"name": member.name, "bytes": member.size, "shape": shape})
    return out


def only_candidate(found: list[dict], part: str) -> dict:
    hits = [f for f in found if part in f["name"]]
    if len(hits) != 1:
        raise ValueError(f"{len(hits)} files hold {part!r}")
    return hits[0]


def _chunk(data: bytes, meta: dict) -> np.ndarray:
    kind = (meta.get("compressor") or {}).get("id")
    raw = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x)}[kind](data)
    return np.frombuffer(raw, meta["dtype"]).reshape(meta["chunks"], order=meta.get("order", "C"))


def _array_rows(batches: Iterator[pa.RecordBatch], metas: dict[str, dict]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            folder, _, name = path.rpartition("/")
            root = next((r for r in metas if path.startswith(f"{r}/")), None)
            if root is None:
                continue
            meta = metas[root]
            sep = meta.get("dimension_separator", ".")
            place = [int(x) for x in path[len(root) + 1 :].split(sep)]
            chunk = _chunk(content.as_py(), meta)
            # what a last chunk holds beyond the array's extent is no label
            chunk = chunk[tuple(slice(0, s - p * c) for s, p, c in zip(meta["shape"], place, meta["chunks"], strict=True))]
            at = np.nonzero(chunk)
            columns = [pa.array(x + p * c, pa.int64()) for x, p, c in zip(at, place, meta["chunks"], strict=True)]
            index = pa.array(list(zip(*(c.to_pylist() for c in columns), strict=True)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([root] * len(at[0]), pa.string()), index, pa.array(chunk[at].astype(np.int64))], ["array", "index", "label"])


def _description(spark: SparkSession, folder: str) -> tuple[str, str]:
    """(the folder's whole name, the text of its description), by Spark's file system: its readers pass over dot files."""
    files = spark._jvm.org.apache.hadoop.fs
    path = files.Path(f"{folder}/.zarray")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with_bytes = system.open(path)
    try:
        return system.makeQualified(path.getParent()).toString(), spark._jvm.org.apache.commons.io.IOUtils.toString(with_bytes, "UTF-8")
    finally:
        with_bytes.close()


def label_rows(spark: SparkSession, root: str, arrays: Sequence[str]) -> DataFrame:
    """(array, index, label) of the labels that aren't 0 in chunked arrays under root; a task decodes a chunk. Packings are
    none, zlib, gzip and zstd; chunks that aren't there are empty."""
    metas = {}
    for a in arrays:
        folder, text = _description(spark, f"{root}/{a}")
        meta = json.loads(text)
        if np.dtype(meta["dtype"]).kind != "u" or meta.get("filters"):
            raise ValueError(f"{a} isn't a plain array of unsigned labels")
        metas[folder] = meta
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root}/{a}" for a in arrays])
    chunks = files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(r"^\d+(\.\d+)*$")).select("path", "content")
    return chunks.mapInArrow(partial(_array_rows, metas=metas), "array string, index array<long>, label long")


def write_labels(rows: DataFrame, path: str, shape: Sequence[int], chunks: Sequence[int]) -> str:
    """(index, label) rows as a chunked array, staged beside its path and published whole; returns the tree's digest. A
    label beyond 32 bits or below 0, and an index outside, fail. Chunks are gathered one at a time."""
    if os.path.exists(path):
        raise FileExistsError(path)
    staged = f"{path}.part"
    shutil.rmtree(staged, ignore_errors=True)
    os.makedirs(staged)
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": "<u4", "compressor": {"id": "zlib", "level": 1}, "fill_value": 0, "order": "C", "filters": None}
    with open(f"{staged}/.zarray", "w") as file:
        json.dump(meta, file, sort_keys=True)
    axes = range(len(shape))
    inside = F.lit(True)
    for a, s in zip(axes, shape, strict=True):
        inside &= (F.col("index")[a] >= 0) & (F.col("index")[a] < s)
    ok = inside & (F.col("label") >= 0) & (F.col("label") < 1 << 32)
    checked = rows.select("index", F.when(ok, F.col("label")).otherwise(F.raise_error(F.lit("label or index out of range")).cast("long")).alias("label"))
    block = F.concat_ws(".", *(F.floor(F.col("index")[a] / c).cast("string") for a, c in zip(axes, chunks, strict=True)))
    ordered = checked.withColumn("block", block).orderBy("block")
    for name, own in itertools.groupby(ordered.toLocalIterator(), key=lambda r: r["block"]):
        image, start = np.zeros(tuple(chunks), "<u4"), [int(x) * c for x, c in zip(name.split("."), chunks, strict=True)]
        for row in own:
            image[tuple(i - s for i, s in zip(row["index"], start, strict=True))] = row["label"]
        with open(f"{staged}/{name}", "wb") as file:
            file.write(zlib.compress(image.tobytes(), 1))
    digest = tree_digest(staged)
    os.replace(staged, path)
    return digest


def tree_digest(folder: str) -> str:
    """SHA-256 over the sorted names and digests of a folder's files. A link, and a file that is still being written,
    fail."""
    lines = []
    for top, folders, files in os.walk(folder):
        for name in (*folders, *files):
            if os.path.islink(os.path.join(top, name)):
                raise ValueError(f"link in {folder}: {name}")
        for name in files:
            if name.endswith((".part", ".tmp")):
                raise ValueError(f"unfinished file in {folder}: {name}")
            full = os.path.join(top, name)
            with open(full, "rb") as file:
                lines.append(os.path.relpath(full, folder).replace(os.sep, "/") + "\0" + hashlib.file_digest(file, "sha256").hexdigest() + "\n")
    return hashlib.sha256("".join(sorted(lines)).encode()).hexdigest()


def store_planes(rows: DataFrame, path: str, observed: bool) -> list[tuple]:
    """Writes planes (grp, z, y, x, label) to a store in folders by group and plane, and returns those written. A plane that
    was observed is never written again; an inferred one gives way to an observed one only."""
    spark = rows.sparkSession
    state = "observed" if observed else "inferred"
    asked = {(r["grp"], r["z"]) for r in rows.select("grp", "z").distinct().collect()}  # planes, not pixels
    there = {}
    if os.path.exists(f"{path}/planes"):
        there = {(r["grp"], r["z"]): r["state"] for r in spark.read.parquet(f"{path}/planes").select("grp", "z", "state").distinct().collect()}
    if kept := sorted(p for p in asked if there.get(p) == "observed" or (there.get(p) and not observed)):
        raise FileExistsError(f"planes are there: {kept[:5]}")
    rows.withColumn("state", F.lit(state)).repartition("grp", "z").write.mode("append").partitionBy("grp", "z", "state").parquet(f"{path}/planes")
    return sorted(asked)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """The planes of a store, observed ones in place of inferred ones."""
    rows = spark.read.parquet(f"{path}/planes")
    best = rows.select("grp", "z", "state").distinct().groupBy("grp", "z").agg(F.max("state").alias("state"))
    return rows.join(best, ["grp", "z", "state"])
