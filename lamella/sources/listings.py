"""Object stores, selections, web records, drawings and particle archives as tables. What needs a network takes the
function that fetches, so that callers choose it and tests need none."""

from __future__ import annotations

import hashlib
import io
import json
import os
import time
import urllib.error
from collections.abc import Callable, Iterator, Sequence
from functools import partial
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 4
#: What a selection and each of its items must have.
SELECTION_FIELDS = ("source_bucket", "inventory_manifest", "provenance_path", "items")
ITEM_FIELDS = ("release", "object_family", "lineage", "s3_key", "size_bytes", "local_path")


def _named(element: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in element.iter() if e.tag.rsplit("}", 1)[-1] == name)


def _text(element: ElementTree.Element, name: str) -> str | None:
    return next((e.text for e in _named(element, name)), None)


def fetched(fetch: Callable[[str, str | None], bytes], prefix: str, token: str | None, wait: Callable[[float], None] = time.sleep) -> bytes | None:
    """One page of a listing, tried ATTEMPTS times with doubled waits on errors of the connection; None where the store
    knows no such prefix."""
    for k in range(ATTEMPTS):
        try:
            return fetch(prefix, token)
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
            if k == ATTEMPTS - 1:
                raise
        except OSError:
            if k == ATTEMPTS - 1:
                raise
        wait(2.0**k)
    return None


def pages(fetch: Callable[[str, str | None], bytes], prefix: str, wait: Callable[[float], None] = time.sleep) -> Iterator[ElementTree.Element]:
    """The pages of a prefix, as their continuation tokens go."""
    token = None
    while (data := fetched(fetch, prefix, token, wait)) is not None:
        page = ElementTree.fromstring(data)
        yield page
        token = _text(page, "NextContinuationToken")
        if not token:
            return


def _listed(batches: Iterator[pa.RecordBatch], fetch: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for prefix in batch.column(0).to_pylist():
            for page in pages(fetch, prefix):
                found = [(prefix, _text(e, "Key"), int(_text(e, "Size") or 0), _text(e, "LastModified")) for e in _named(page, "Contents")]
                columns = list(zip(*found, strict=True)) or [()] * 4
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["prefix", "key", "size_bytes", "last_modified"])


def listing(spark: SparkSession, fetch: Callable[[str, str | None], bytes], prefixes: Sequence[str], excluded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(prefix, key, size_bytes, last_modified) of all objects, a task for each prefix; and how many each excluded part of
    a key left out. Keys of folders go, and so do objects without size that mark one."""
    asked = spark.createDataFrame([(p,) for p in prefixes], "prefix string").repartition(max(1, len(prefixes)))
    found = asked.mapInArrow(partial(_listed, fetch=fetch), "prefix string, key string, size_bytes long, last_modified string").where(~F.col("key").endswith("/"))
    hit = F.coalesce(*(F.when(F.col("key").contains(x), F.lit(x)) for x in excluded), F.lit(None).cast("string"))
    marked = found.withColumn("hit", hit)
    return marked.where("hit IS NULL").drop("hit"), marked.where("hit IS NOT NULL").groupBy("hit").agg(F.count("*").alias("n"))


def folders(objects: DataFrame, prefix: str) -> DataFrame:
    """The folders right below a prefix, each with its objects and bytes."""
    rest = F.substr(F.col("key"), F.lit(len(prefix) + 1))
    inside = objects.where(F.startswith("key", F.lit(prefix)) & rest.contains("/"))
    return inside.groupBy(F.concat(F.lit(prefix), F.substring_index(rest, "/", 1), F.lit("/")).alias("folder")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def selection(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(the selection's own fields, its items) of a JSON file; a missing field, no items, and a size that is no number
    fail, with the item's number."""
    text = spark.read.text(path, wholetext=True).first()
    raw = json.loads(text["value"] if text else "{}")
    if missing := [f for f in SELECTION_FIELDS if f not in raw]:
        raise ValueError(f"selection lacks {missing}")
    if not isinstance(raw["items"], list) or not raw["items"]:
        raise ValueError("selection has no items")
    rows = []
    for i, item in enumerate(raw["items"], 1):
        if missing := [f for f in ITEM_FIELDS if not isinstance(item, dict) or f not in item]:
            raise ValueError(f"item {i} lacks {missing}")
        try:
            rows.append(tuple(int(item[f]) if f == "size_bytes" else str(item[f]) for f in ITEM_FIELDS))
        except (TypeError, ValueError) as error:
            raise ValueError(f"item {i}: {error}") from error
    return {f: raw[f] for f in SELECTION_FIELDS[:-1]}, spark.createDataFrame(rows, ", ".join(f"{f} {'long' if f == 'size_bytes' else 'string'}" for f in ITEM_FIELDS))


def section_records(spark: SparkSession, answers: Sequence[str], kinds: dict[str, str]) -> DataFrame:
    """(data_set, kind, image, number, width, height) of a service's answers, text of JSON records with nested images. A
    data set whose treatments name no kind or several fails, and so does an image that comes twice."""
    schema = "array<struct<id:long,treatments:array<struct<name:string>>,section_images:array<struct<id:long,section_number:int,width:int,height:int>>>>"
    sets = spark.createDataFrame([(a,) for a in answers], "answer string").select(F.explode(F.from_json(F.get_json_object("answer", "$.msg"), schema)).alias("s")).select("s.*")
    mapped = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    own = F.array_distinct(F.array_compact(F.transform("treatments", lambda t: F.try_element_at(mapped, t["name"]))))
    ambiguous = F.raise_error(F.concat(F.lit("treatment isn't one kind: "), F.col("id").cast("string"))).cast("string")
    images = sets.select(F.col("id").alias("data_set"), F.when(F.size(own) == 1, own[0]).otherwise(ambiguous).alias("kind"), F.explode("section_images").alias("i"))
    flat = images.select("data_set", "kind", F.col("i.id").alias("image"), F.col("i.section_number").alias("number"), "i.width", "i.height")
    twice = flat.groupBy("image").count().where("count > 1").select(F.raise_error(F.concat(F.lit("image comes twice: "), F.col("image").cast("string"))).cast("string").alias("e")).agg(F.count("e").alias("_c"))
    return flat.crossJoin(twice).where("_c >= 0").drop("_c")


def _shapes(batches: Iterator[pa.RecordBatch], groups: dict[int, str], structures: frozenset[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            inside: list[int | None] = []
            for event, e in ElementTree.iterparse(io.BytesIO(content.as_py()), ("start", "end")):
                if event == "end":
                    inside.pop()
                    continue
                group = inside[-1] if inside else None
                if (raw := e.get("graphic_group_label_id")) is not None:
                    group = int(raw)
                    if groups.get(group) is None or e.get("graphic_group_label") != groups[group]:
                        raise ValueError(f"{name}: group {raw} isn't {e.get('graphic_group_label')!r}")
                inside.append(group)
                if e.tag.rsplit("}", 1)[-1] == "path":
                    structure = int(e.get("structure_id") or -1)
                    if group is None or structure not in structures:
                        raise ValueError(f"{name}: a path without a group, or of the unknown structure {structure}")
                    rows.append((name, len(rows), group, structure, e.get("transform"), e.get("d")))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "place", "grp", "structure", "transform", "d"])


def drawings(spark: SparkSession, path: str, groups: dict[int, str], structures: Sequence[int]) -> DataFrame:
    """(path, place, grp, structure, transform, d): the paths of drawings in document order; a path's group is that of the
    nearest element around it that names one. An unknown group, structure or name fails with the file's name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(partial(_shapes, groups=groups, structures=frozenset(structures)), "path string, place int, grp long, structure long, transform string, d string")


def drawing_groups(shapes: DataFrame) -> DataFrame:
    """(path, order, grp): a drawing's groups by their first path."""
    first = shapes.groupBy("path", "grp").agg(F.min("place").alias("first"), F.count("*").alias("shapes"), F.countDistinct("structure").alias("structures"))
    from pyspark.sql import Window

    return first.withColumn("order", F.row_number().over(Window.partitionBy("path").orderBy("first"))).drop("first")


def fetch_plan(wanted: DataFrame, root: str) -> DataFrame:
    """(s3_key, size_bytes, target): where each selected object goes; one that would leave the root fails."""
    leaves = F.col("local_path").rlike(r"(^|/)\.\.(/|$)") | F.startswith("local_path", F.lit("/"))
    bad = F.raise_error(F.concat(F.lit("path leaves the root: "), F.col("local_path"))).cast("string")
    return wanted.select("s3_key", "size_bytes", F.when(leaves, bad).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("local_path"))).alias("target"))


def fetch_one(open_: Callable[[str], tuple[int | None, Iterator[bytes]]], key: str, size: int, target: str) -> str:
    """Fetches one object beside its target and renames it when its size is right: 'present' where the target is there
    with that size, 'fetched', or 'quarantined', with what came kept under another name. Nothing is overwritten."""
    if os.path.exists(target):
        if os.path.getsize(target) != size:
            raise FileExistsError(f"{target} has {os.path.getsize(target)} bytes, not {size}")
        return "present"
    stated, chunks = open_(key)
    if stated is not None and stated != size:
        raise ValueError(f"{key}: {stated} bytes are offered, not {size}")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(f"{target}.part", "wb") as out:
        for chunk in chunks:
            out.write(chunk)
    right = os.path.getsize(f"{target}.part") == size
    os.replace(f"{target}.part", target if right else f"{target}.quarantine")
    return "fetched" if right else "quarantined"


def particles(spark: SparkSession, path: str, features: str) -> tuple[dict, DataFrame]:
    """(metadata, (particle, x, y, z, nu)) of a particle archive, by key. Places must be finite, masses finite and 0 or
    more, and the metadata text of JSON."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    with np.load(io.BytesIO(bytes(content["content"])), allow_pickle=False) as archive:
        x, nu = np.asarray(archive["X"], float), np.asarray(archive[features], float)
        metadata = json.loads(str(archive["metadata"])) if "metadata" in archive else {}
    if x.ndim != 2 or x.shape[1] != 3 or len(nu) != len(x) or not np.isfinite(x).all() or not np.isfinite(nu).all() or (nu < 0).any():
        raise ValueError("places must be finite triples, masses finite and not negative")
    rows = [(i, *map(float, place), masses) for i, (place, masses) in enumerate(zip(x, nu.reshape(len(x), -1).tolist(), strict=True))]
    return metadata, spark.createDataFrame(rows, "particle long, x double, y double, z double, nu array<double>")


def save_particles(rows: DataFrame, path: str, labels: Sequence[str], metadata: dict) -> dict[str, float]:
    """Writes (particle, x, y, z, nu) as an archive with each particle's largest feature (from 1), weight and entropy, and
    returns the totals that are conserved. One archive is one file, gathered in order of particles."""
    table = rows.orderBy("particle").select("x", "y", "z", "nu").toArrow()
    x = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1) if len(table) else np.zeros((0, 3))
    nu = np.array(table.column("nu").to_pylist(), float).reshape(len(x), -1)
    weight = nu.sum(axis=1)
    share = nu / np.where(weight > 0, weight, 1)[:, None]
    entropy = -np.where(share > 0, share * np.log(np.where(share > 0, share, 1)), 0).sum(axis=1)
    largest = nu.argmax(axis=1) + 1 if nu.size else np.zeros(len(x), int)
    with open(f"{path}.part", "wb") as out:
        np.savez(out, X=x.astype(np.float32), nu=nu, largest=largest.astype(np.int32), weight=weight, entropy=entropy, metadata=json.dumps(metadata | {"labels": list(labels)}, sort_keys=True))
    os.replace(f"{path}.part", path)
    return {"particles": len(x), "mass": float(weight.sum())}


def grid_geometry(affine: Sequence[Sequence[float]], shape: Sequence[int]) -> dict:
    """Voxel sizes (lengths of the matrix's columns) and the bounds of a volume's eight corners."""
    a = np.asarray(affine, float)
    corners = np.array(np.meshgrid(*((0, n - 1) for n in shape), indexing="ij")).reshape(3, -1).T
    world = corners @ a[:3, :3].T + a[:3, 3]
    return {"spacing": np.linalg.norm(a[:3, :3], axis=0).tolist(), "low": world.min(axis=0).tolist(), "high": world.max(axis=0).tolist()}


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The file's row (path, content), if its digest is the pinned one."""
    digest = F.sha2("content", 256)
    changed = F.raise_error(F.concat(F.lit("digest differs: "), F.col("path"))).cast("binary")
    return spark.read.format("binaryFile").load(path).select("path", F.when(digest == sha256, F.col("content")).otherwise(changed).alias("content"))


def digest_of(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
