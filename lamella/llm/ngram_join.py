"""N-gram Jaccard join: a blocked sparse matrix product of documents by word shingles.

1. Equal shingle sets collapse into one class (group by a 128-bit digest), so copies never meet in pairs.
2. Shingles get one global order, rare first: counts over all documents fall into a table of fixed size, whose
   doubling steps order the shingles. Two sets of similarity ``t`` share one of their first ``n - ceil(t * n) + 1``
   shingles, whatever the order; the counts only keep the lists short.
3. Each shingle's list has a hub, its smallest class; the members of a hub make a block. First go the members that
   link with none of their block: each set has a bitmap of the parities of its shingles' buckets, and two bitmaps
   differ in no more bits than the sets in shingles, so pairs whose bitmaps differ in more than their sizes allow
   are no links. Only what stays needs its whole set.
   Blocks are then dealt out in tiles of ``TILE`` classes with the hub in each. In a tile the product of the
   incidence matrix with its transpose accumulates overlaps; pairs below the bound from their sizes go; a spanning
   forest of the rest comes out.
4. Links become components by contraction. In blocks of several tiles with several components left, the classes
   outside the block's largest component are multiplied with all tiles of fitting sizes. So no link between
   different components is lost, and pairs inside a component are never written.

Defined cases: null, empty or blank texts have an empty set and link with nothing; texts under five words are one
shingle; repeated rows and ties share one class; a null doc_id counts as the largest id and comes back as null;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import WORD_PATTERN, release, released, settled, shuffle_partitions, table
from lamella.llm.textkernels import shingle_sets, text_slices

PERCENT = 80
WIDTH = 5
TILE = 128
#: Counters of the table that orders shingles: 4 MB for each task, whatever the corpus.
COUNTERS_LOG2 = 22
#: Lists that the counts put above this are dealt out so that one list can be split over tasks.
HOT_LIST = 1 << 17
#: Classes in a tile of the bitmap filter.
SIEVE_TILE = 1024
#: Up to so many classes that need their whole sets are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 250_000
#: Columns of the dense part of a tile's product.
SLAB = 4096
NO_ID = 2**63 - 1
_CHUNK = 1 << 16


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest()


def set_id(own: np.ndarray) -> int:
    return int.from_bytes(digest(own)[:8], "little", signed=True)


def parities(own: np.ndarray) -> bytes:
    """A bit for each of n buckets or more (a power of two): whether an odd number of shingles falls into it."""
    buckets = max(64, 1 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1).tobytes()


def near(bits: list[np.ndarray], sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set of a unit whether its bitmap allows a link with another one, of the other side where sides are given."""
    found = np.zeros(len(bits), bool)
    length = np.array([len(b) for b in bits])
    for width in np.unique(length).tolist():
        own = np.flatnonzero(length == width)
        for asked, other in ((own, own), (own, np.flatnonzero(length == 2 * width))) if side is None else _facing(own, np.flatnonzero(length == 2 * width), side):
            if not len(other) or not len(asked):
                continue
            # the wider bitmap folds onto the narrower one
            theirs = np.stack([bits[j] if len(bits[j]) == width else bits[j][:width] ^ bits[j][width:] for j in other])
            for i in asked.tolist():
                differ = np.bitwise_count(theirs.view(np.uint64) ^ bits[i].view(np.uint64)).sum(axis=1, dtype=np.int64)
                # intersection >= percent / (100 + percent) of both sizes
                hit = ((100 + percent) * differ <= (100 - percent) * (sizes[other] + sizes[i])) & (other != i)
                if hit.any():
                    found[i] = True
                    found[other[hit]] = True
    return found


def _facing(own: np.ndarray, wider: np.ndarray, side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Whom to compare with whom, so that each pair of different sides meets once."""
    of = lambda x, k: x[side[x] == k]
    return [(of(own, 0), of(own, 1)), (of(own, 0), of(wider, 1)), (of(own, 1), of(wider, 0))]


def _sieve(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(hub, set_id) of the members that may link; the rows come sorted by unit. A unit is a tile, or two that meet."""
    unit: str | None = None
    hub = 0
    members: dict[int, tuple[int, np.ndarray, int]] = {}

    def done() -> list[tuple[int, int]]:
        if len(members) < 2:
            return []
        side = np.array([k for _, _, k in members.values()])
        stay = near([b for _, b, _ in members.values()], np.array([n for n, _, _ in members.values()]), percent, side if side.any() else None)
        return [(hub, i) for i, s in zip(members, stay.tolist(), strict=True) if s]

    for batch in batches:
        out: list[tuple[int, int]] = []
        columns = (batch.column(c).to_pylist() for c in ("unit", "hub", "set_id", "n", "side"))
        for key, block, i, n, side, packed in zip(*columns, batch.column("bits"), strict=True):
            if key != unit:
                out += done()
                unit, hub, members = key, block, {}
            members[i] = (n, np.frombuffer(packed.as_buffer(), np.uint8), side)
        if out:
            yield _edges(out)
    if last := done():
        yield _edges(last)


def _profile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (id, text key, n, set id, bitmap), then this task's shingle counts in pieces."""
    counts = np.zeros(1 << COUNTERS_LOG2, np.uint32)
    names = ["rid", "text_key", "n", "set_id", "bits", "piece", "counts"]
    for batch in batches:
        sizes, ids, bits, pending = [], [], [], []
        for _, data, starts in text_slices(batch.column(1)):
            for own in shingle_sets(data, starts, width):
                sizes.append(len(own))
                ids.append(set_id(own) if len(own) else 0)
                bits.append(parities(own) if len(own) else b"")
                pending.append(own)
            flat = np.concatenate(pending) if pending else np.zeros(0, np.uint64)
            pending = []
            np.add.at(counts, (flat >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64), np.uint32(1))
        k = len(sizes)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
    used = [i for i in range(len(counts) // _CHUNK) if counts[i * _CHUNK : (i + 1) * _CHUNK].any()]
    if used:
        packed = [zlib.compress(counts[i * _CHUNK : (i + 1) * _CHUNK].tobytes(), 1) for i in used]
        k = len(used)
        yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names)


def _add_counts(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CHUNK, np.uint64)
    for batch in group:
        for packed in batch.column("counts"):
            total += np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["piece", "counts"])


def _levels(totals: dict[int, np.ndarray]) -> tuple[np.ndarray, float]:
    """The doubling step of each counter, 0 for all that chance may have put there, and where the steps begin."""
    whole = np.zeros(1 << COUNTERS_LOG2, np.uint64)
    for piece, own in totals.items():
        whole[piece * _CHUNK : (piece + 1) * _CHUNK] = own
    floor = whole.mean() + 4 * np.sqrt(whole.mean()) + 4
    return np.ceil(np.log2(np.maximum(whole.astype(np.float64) / floor, 1.0))).astype(np.uint8), floor


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, levels, hot_level: int) -> Iterator[pa.RecordBatch]:
    """Each class's first shingles, once a task: those of short lists, and those of lists that may be very long."""
    level = levels.value
    met: set[int] = set()
    for batch in batches:
        ids, tokens, hot = [], [], []
        for _, data, starts in text_slices(batch.column(0)):
            for own in shingle_sets(data, starts, width):
                n = len(own)
                if not n or (name := set_id(own)) in met:
                    continue
                met.add(name)
                k = n - -(-percent * n // 100) + 1
                step = level[(own >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)].astype(np.uint64)
                order = (step << np.uint64(56)) | (own >> np.uint64(8))
                picked = np.argpartition(order, k - 1)[:k] if k < n else np.arange(n)
                ids.append(name)
                far = step[picked] >= hot_level
                tokens.append(own[picked][~far].view(np.int64))
                hot.append(own[picked][far].view(np.int64))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(hot, pa.list_(pa.int64()))], ["set_id", "tokens", "hot"])


def _whole_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    known: set[int] = set()  # equal rows, id and all, bring their set once from each task
    for batch in batches:
        wanted = batch.column(2).to_numpy(zero_copy_only=False)
        ids, packed, row = [], [], 0
        for _, data, starts in text_slices(batch.column(1)):
            for own in shingle_sets(data, starts, width):
                if len(own) and int(wanted[row]) not in known and set_id(own) == wanted[row]:
                    known.add(int(wanted[row]))
                    ids.append(int(wanted[row]))
                    packed.append(own.astype("<u8").tobytes())
                row += 1
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["set_id", "hashes"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The overlap counts of all pairs: incidence matrix times its transpose, a slab of shared columns at a time."""
    k = len(sets)
    if k == 2:
        o = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), o], [o, len(sets[1])]], np.int64)
    rows = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    rows, column = rows[shared], column[shared]
    renumber = np.cumsum(df > 1) - 1
    column = renumber[column]
    result = np.zeros((k, k), np.float64)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, SLAB):
        a, b = np.searchsorted(column, (start, start + SLAB))
        slab = np.zeros((k, min(SLAB, width - start)), np.float32)
        slab[rows[a:b], column[a:b] - start] = 1
        result += slab @ slab.T
    return np.rint(result).astype(np.int64)


def links(ids: list[int], sets: list[np.ndarray], groups: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity is percent / 100 or more (and whose groups differ)."""
    found = overlaps(sets)
    size = np.array([len(s) for s in sets], np.int64)
    linked = 100 * found >= percent * (size[:, None] + size[None, :] - found)
    if groups is not None:
        own = np.array(groups)
        linked &= own[:, None] != own[None, :]
    root = list(range(len(ids)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for a, b in np.argwhere(np.triu(linked, 1)).tolist():
        ra, rb = top(a), top(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            forest.append((ids[a], ids[b]))
    return forest


def _tiles(batches: Iterator[pa.RecordBatch], percent: int, grouped: bool) -> Iterator[pa.RecordBatch]:
    """Links inside each run of rows of one unit; the rows come sorted by unit."""
    unit: str | None = None
    members: dict[int, tuple[np.ndarray, int]] = {}

    def done() -> list[tuple[int, int]]:
        if len(members) < 2:
            return []
        ids = list(members)
        return links(ids, [members[i][0] for i in ids], [members[i][1] for i in ids] if grouped else None, percent)

    for batch in batches:
        out: list[tuple[int, int]] = []
        groups = batch.column("grp").to_pylist() if grouped else [0] * len(batch)
        for key, i, packed, g in zip(batch.column("unit").to_pylist(), batch.column("set_id").to_pylist(), batch.column("hashes"), groups, strict=True):
            if key != unit:
                out += done()
                unit, members = key, {}
            members[i] = (np.frombuffer(packed.as_buffer(), "<u8").copy(), g)
        if out:
            yield _edges(out)
    if last := done():
        yield _edges(last)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): rounds of taking the least neighbour, jumping and contracting.

    Least neighbours are aggregated before any shuffle, and the joins are sort-merge joins that Spark can split, so
    a node with a great many links is no single task's work.
    """
    current = settled(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels: DataFrame | None = None
    while not current.isEmpty():
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("up"))
        parent = settled(parent)
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = settled(parent.join(above, "up").select("node", F.col("top").alias("up")))
        if labels is None:
            labels = parent.select("node", F.col("up").alias("root"))
        else:
            moved = parent.select(F.col("node").alias("root"), "up")
            labels = settled(labels.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left = current.join(parent.select(F.col("node").alias("u"), F.col("up").alias("a")), "u")
        moved = left.join(parent.select(F.col("node").alias("v"), F.col("up").alias("b")), "v").where("a <> b")
        current = settled(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if labels is None:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


def _multiply(units: DataFrame, sets: DataFrame, percent: int, grouped: bool) -> DataFrame:
    parts = max(shuffle_partitions(units.sparkSession), 12)
    dealt = units.join(sets, "set_id").repartition(parts, "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(released(partial(_tiles, percent=percent, grouped=grouped)), "u long, v long")


def components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, tile: int = TILE, hot_list: int = HOT_LIST) -> DataFrame:
    """For each row of documents: its id, the size of its set and the least id of its component."""
    rows = _components(documents, id_col, text_col, width, percent, tile, hot_list)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(known("rid").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def _components(documents: DataFrame, id_col: str, text_col: str, width: int = WIDTH, percent: int = PERCENT, tile: int = TILE, hot_list: int = HOT_LIST) -> DataFrame:
    """(rid, text_key, n, root, component) of each row, NO_ID for a null id; root tells components apart even where ids repeat."""
    spark = documents.sparkSession
    text = documents[text_col].cast("string")
    # ids may be null or repeated: a class is found again by the id and the text of one of its rows
    docs = documents.select(F.coalesce(documents[id_col].cast("long"), F.lit(NO_ID)).alias("rid"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    seen = settled(docs.mapInArrow(released(partial(_profile, width=width)), "rid long, text_key long, n long, set_id long, bits binary, piece int, counts binary"))
    base = seen.where("piece IS NULL").select("rid", "text_key", "n", "set_id")
    summed = seen.where("piece IS NOT NULL").select("piece", "counts").groupBy("piece").applyInArrow(_add_counts, "piece int, counts binary")
    # 64 rows of 64 thousand counters, however large the corpus
    level, floor = _levels({r["piece"]: np.frombuffer(zlib.decompress(r["counts"]), np.uint64) for r in summed.toLocalIterator()})
    release()
    hot_level = max(1, int(np.ceil(np.log2(max(2.0, hot_list / floor)))))
    levels = spark.sparkContext.broadcast(level)

    classes = settled(seen.where("n > 0").groupBy("set_id", "n").agg(F.min(F.struct("rid", "text_key")).alias("row"), F.first("bits").alias("bits")).select("set_id", "n", F.col("row.rid").alias("rep"), F.col("row.text_key").alias("text_key"), "bits"))
    own = docs.select("text").mapInArrow(released(partial(_prefixes, width=width, percent=percent, levels=levels, hot_level=hot_level)), "set_id long, tokens array<long>, hot array<long>")
    listed = own.select("set_id", F.explode("tokens").alias("token"))
    order = Window.partitionBy("token").orderBy("set_id")
    pairs = listed.withColumn("hub", F.first("set_id").over(order)).where("hub <> set_id").select("hub", "set_id")
    if int(level.max(initial=0)) >= hot_level:
        far = own.select("set_id", F.explode("hot").alias("token"))
        hubs = far.groupBy("token").agg(F.min("set_id").alias("hub"))
        pairs = pairs.union(far.join(hubs.hint("merge"), "token").where("hub <> set_id").select("hub", "set_id"))
    blocks = _sieved(settled(pairs.distinct()), classes, percent)

    parts = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    # blocks of several tiles; all others have one
    large = settled(blocks.groupBy("hub").agg(F.count("*").alias("size")).select("hub", parts.alias("parts")).where("parts > 1"))
    wanted = classes.join(blocks.select("set_id").distinct().hint("merge"), "set_id", "left_semi")
    reps = settled(wanted.select(F.col("rep").alias("rid"), "text_key", "set_id"))
    reps = F.broadcast(reps) if reps.count() <= BROADCAST_ROWS else reps.hint("merge")
    sets = settled(docs.join(reps, ["rid", "text_key"]).select("rid", "text", "set_id").mapInArrow(released(partial(_whole_sets, width=width)), "set_id long, hashes binary"))

    share = F.pmod(F.xxhash64("set_id", "hub"), F.col("parts")).cast("int")
    dealt = blocks.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large.hint("merge"), "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    unit = lambda *of: F.concat_ws(":", *of)
    first = dealt.where("set_id <> hub").select("set_id", unit("hub", share).alias("unit"))
    hub_rows = dealt.where("set_id = hub").select("hub", "set_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = first.union(hub_rows.select("set_id", unit("hub", "part").alias("unit")))
    found = settled(_multiply(first, sets, percent, grouped=False))

    if not large.isEmpty():
        found = settled(found.union(_rest(large, blocks, classes, found, sets, percent, tile)))
    roots = connected_components(found)
    classed = classes.join(roots.select(F.col("node").alias("set_id"), "root").hint("merge"), "set_id", "left")
    classed = classed.select("set_id", "rep", F.coalesce("root", "set_id").alias("root"))
    least = classed.groupBy("root").agg(F.min("rep").alias("least"))
    labelled = classed.join(least.hint("merge"), "root").select("set_id", "root", "least")
    rows = base.join(labelled.hint("merge"), "set_id", "left")
    return rows.select("rid", "text_key", "n", "root", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("rid")).alias("component"))


def _sieved(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(hub, set_id), the hub's own row included: the members of blocks that may link with another of their block.

    A block of up to SIEVE_TILE members is one unit. A larger one falls into bands by the sets' sizes, whose steps are
    so wide that sets two bands apart can't link, and each band into tiles; a tile meets the tiles of its band and of
    the next one."""
    members = pairs.union(pairs.select("hub", F.col("hub").alias("set_id")).distinct())
    hubs = members.groupBy("hub").agg(F.count("*").alias("size")).where(F.col("size") > SIEVE_TILE)
    members = members.join(_counted(hubs), "hub", "left").join(classes.select("set_id", "n", "bits").hint("merge"), "set_id")
    columns = ["unit", "hub", "set_id", "n", "side", "bits"]
    small = members.where("size IS NULL").withColumn("unit", F.col("hub").cast("string")).withColumn("side", F.lit(0)).select(*columns)

    large = members.where("size IS NOT NULL").withColumn("band", _band(percent))
    counts = large.groupBy("hub", "band").agg(F.ceil(F.count("*") / F.lit(SIEVE_TILE)).cast("int").alias("parts"))
    after = counts.select("hub", (F.col("band") - 1).alias("band"), F.col("parts").alias("after"))
    before = counts.select("hub", (F.col("band") + 1).alias("band"), F.col("parts").alias("before"))
    bands = counts.join(after, ["hub", "band"], "left").join(before, ["hub", "band"], "left")
    dealt = large.join(_counted(bands), ["hub", "band"]).withColumn("part", F.pmod(F.xxhash64("set_id", "hub"), F.col("parts")).cast("int"))
    # the tiles that a member's tile meets: (band, part) and which of the two comes first
    meets = lambda n, step, first: F.transform(F.sequence(F.lit(1), n), lambda q: F.struct((F.col("band") + step).alias("band"), (q - 1).alias("part"), F.lit(first).alias("first")))
    none = F.array().cast("array<struct<band:int,part:int,first:boolean>>")
    there = lambda n, *of: F.when(F.coalesce(n, F.lit(0)) > 0, meets(n, *of)).otherwise(none)
    other = F.explode(F.concat(meets(F.col("parts"), 0, True), there(F.col("after"), 1, True), there(F.col("before"), -1, False)))
    dealt = dealt.withColumn("other", other)
    same = F.col("other.band") == F.col("band")
    first = F.when(same, F.col("part") <= F.col("other.part")).otherwise(F.col("other.first"))
    own, theirs = F.concat_ws(".", "band", "part"), F.concat_ws(".", "other.band", "other.part")
    unit = F.when(first, F.concat_ws(":", "hub", own, theirs)).otherwise(F.concat_ws(":", "hub", theirs, own))
    tiles = dealt.withColumn("unit", unit).withColumn("side", F.when(first, 0).otherwise(1)).select(*columns)
    count = max(shuffle_partitions(pairs.sparkSession), 12)
    stay = small.union(tiles).repartition(count, "unit").sortWithinPartitions("unit").mapInArrow(released(partial(_sieve, percent=percent)), "u long, v long")
    return settled(stay.select(F.col("u").alias("hub"), F.col("v").alias("set_id")).distinct())


def _counted(few: DataFrame) -> DataFrame:
    """A table of large blocks, counted before it is broadcast: members then needn't meet by their hub in one task."""
    few = settled(few)
    return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge")


def _band(percent: int) -> Column:
    """Steps of a set's size n: sets two steps apart can't be similar enough."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 1.000001)).cast("int")


def _rest(large: DataFrame, blocks: DataFrame, classes: DataFrame, found: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links between different components of blocks that were dealt out in several tiles."""
    roots = connected_components(found).select(F.col("node").alias("set_id"), "root")
    hubs = large.select("hub")
    members = blocks.join(_counted(hubs), "hub", "left_semi")
    members = members.join(roots.hint("merge"), "set_id", "left").join(classes.select("set_id", "n").hint("merge"), "set_id")
    members = settled(members.select("hub", "set_id", F.coalesce("root", "set_id").alias("grp"), _band(percent).alias("step")))
    per = members.groupBy("hub", "grp").agg(F.count("*").alias("k"))
    main = per.groupBy("hub").agg(F.max(F.struct("k", "grp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("hub", F.col("m.grp").alias("main"))
    open_ = members.join(main.hint("merge"), "hub")
    tiles = open_.groupBy("hub", "step").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(tile // 2))).cast("int").alias("parts"))
    open_ = settled(open_.join(tiles.hint("merge"), ["hub", "step"]).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")))
    a = open_.where("grp <> main")
    # the tiles of A and B that meet, without their rows
    ta = a.select("hub", F.col("step").alias("sa"), F.col("part").alias("pa")).distinct()
    tb = open_.select("hub", F.col("step").alias("sb"), F.col("part").alias("pb")).distinct()
    meet = ta.join(tb, "hub").where("abs(sa - sb) <= 1")
    meet = settled(meet.withColumn("unit", F.concat_ws(":", "hub", "sa", "pa", "sb", "pb")))
    left = a.join(meet.select("hub", F.col("sa").alias("step"), F.col("pa").alias("part"), "unit"), ["hub", "step", "part"])
    right = open_.join(meet.select("hub", F.col("sb").alias("step"), F.col("pb").alias("part"), "unit"), ["hub", "step", "part"])
    units = left.select("unit", "set_id", "grp").union(right.select("unit", "set_id", "grp"))
    return _multiply(units, sets, percent, grouped=True)


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with one row of each component: that of the least id, and of several such rows that of the least hash of
    the text, and of equal ones the first that comes. Rows without a word all stay."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    own = dict(zip(documents.columns, names, strict=True))
    text = F.col(own[text_col]).cast("string")
    rows = documents.toDF(*names).withColumn("rid", F.coalesce(F.col(own[id_col]).cast("long"), F.lit(NO_ID))).withColumn("text_key", F.xxhash64(text))
    worded = F.coalesce(text.rlike(WORD_PATTERN), F.lit(False))
    grouped = _components(documents, id_col, text_col).where("n > 0")
    copies = grouped.groupBy("root", "rid", "text_key").agg(F.count("*").alias("copies"))
    best = copies.groupBy("root").agg(F.min(F.struct("rid", "text_key", "copies")).alias("b")).select("b.rid", "b.text_key", "b.copies")
    found = rows.where(worded).join(best.hint("merge"), ["rid", "text_key"])
    one = found.where("copies = 1").select(*names)
    # equal rows but for other columns: one of them, chosen in partial aggregates, so that no task holds them all
    again = found.where("copies > 1").groupBy("rid", "text_key").agg(F.first(F.struct(*names)).alias("r")).select("r.*")
    return rows.where(~worded).select(*names).union(one).union(again).toDF(*documents.columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_ngram_jaccard_join": op1}
SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS sh FROM w
), c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
t AS (SELECT rep, n, unnest(sh) AS token FROM c WHERE n > 0),
f AS (SELECT token, count(*) AS df FROM t GROUP BY token),
p AS (SELECT rep, n, token FROM (SELECT rep, n, t.token, row_number() OVER (PARTITION BY rep ORDER BY df, t.token) AS pos FROM t JOIN f ON t.token = f.token) WHERE pos <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.token = b.token AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
links AS (SELECT a, b FROM (SELECT cand.a, cand.b, x.n AS na, y.n AS nb, len(list_intersect(x.sh, y.sh)) AS o FROM cand JOIN c x ON x.rep = cand.a JOIN c y ON y.rep = cand.b) WHERE 100 * o >= 80 * (na + nb - o)),
e AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
r(node, root) AS (SELECT rep, rep FROM c WHERE n > 0 UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.root END AS component_id
FROM s JOIN c ON c.sh = list_sort(s.sh) LEFT JOIN m ON m.node = c.rep
"""
}
