"""Approximate nearest neighbours by multi-index hashing.

Binary codes: vectors are turned by learned rotations (iterative quantisation: each rotation is fitted so that the
signs of the turned sample lie close to it); every rotation gives one bit per dimension, of the leading principal ones
where there are more than ``DIMENSIONS``. A code splits into
substrings of ``SUBSTRING`` bits, and each substring has an index of its own: rows are shuffled by (substring, value).

A query probes every index at all values up to one bit away from its own substring, so that by the pigeonhole
principle every code within ``2 * substrings - 1`` bits is retrieved, and then at further values in order of the
margins of the bits that they change, least certain bits first. The number of probes comes from a bounded sample
(``SAMPLE`` vectors by a hash of their ids): it retrieves ``SAMPLE_RECALL`` of the sample's true neighbours, which lie
farther apart than those of all rows. Queries that find fewer than k rows take eight times the probes, up to all values.

Index entries carry their vector in two bytes a component, with the error that this makes; of what a probe retrieves, a
task drops the rows that by these bounds can't be among the k best of its own rows, and hands on the others (query, row)
for the exact measure in double precision. The bounds are some 1e-5 apart, so that near copies are told apart too: what
leaves a task is in proportion to the queries, not to the rows retrieved.

Tasks hold ranges of a substring's values of about ``BLOCK`` entries each; ranges with more, such as one value that a
third of all rows has, are split by a hash of the row. Equal vectors are one entry that keeps its ``k + 1`` smallest
ids, found with ranks that are cut off before the shuffle.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than
most of the sample take no part; null ids take none; repeated ids count once with their smallest vector; ties go to
the smaller id; fewer candidates than k give all; an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import cut, table

K = 5
EVERY = 50
SAMPLE = 4096
SAMPLE_QUERIES = 96
SAMPLE_RECALL = 0.96
ROTATIONS = 4
DIMENSIONS = 64
STEPS = 20
SUBSTRING = 16
VALUES = 1 << SUBSTRING
BLOCK = 16_384
QUERY_BLOCK = 4_096
#: Probes are chosen among values up to so many bits away, or among all where that isn't enough.
FAR = 5


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("v")
    out = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return out.where(finite & F.exists(v, lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(rid, v, ids): each vector once, with its keep smallest ids in order; rid is the first of them."""
    one = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("key", F.xxhash64("v"))
    salted = Window.partitionBy("key", "v").orderBy("vec_id")
    first = one.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= keep)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rid"), "v", "ids")


def sample_of(rows: DataFrame, n: int) -> pd.DataFrame:
    """At most SAMPLE rows: those with the smallest hashes of their ids, which a bound on the hash finds first."""
    share = min(1.0, 1.5 * SAMPLE / max(1, n))
    low = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    found = low.select("vec_id", "v").toPandas()
    order = pd.util.hash_array(found["vec_id"].to_numpy(np.int64)).argsort(kind="stable")
    return found.iloc[order[:SAMPLE]]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def learn(sample: np.ndarray, rotations: int = ROTATIONS, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """(dimensions, bits): the learned rotations side by side. Of vectors with more than DIMENSIONS components the
    sample's leading principal ones are turned, so that a code's length doesn't grow with them."""
    rng = np.random.default_rng(seed)
    own, basis = unit(sample), None
    if own.shape[1] > DIMENSIONS:
        basis = np.linalg.eigh(own.T @ own)[1][:, ::-1][:, :DIMENSIONS]
        own = own @ basis
    out = []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(rng.standard_normal((own.shape[1], own.shape[1])))
        for _ in range(steps):
            signs = np.where(own @ turn >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(own.T @ signs)
            turn = u @ w
        out.append(turn if basis is None else basis @ turn)
    return np.concatenate(out, axis=1)


def margins(vectors: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """(rows, substrings, SUBSTRING): the turned vectors; a last substring is filled up with bits that are certain."""
    y = unit(vectors) @ turns
    y = np.pad(y, ((0, 0), (0, -y.shape[1] % SUBSTRING)), constant_values=1e9)
    return y.reshape(len(y), -1, SUBSTRING)


def values_of(y: np.ndarray) -> np.ndarray:
    """(rows, substrings): the substrings of the codes as integers."""
    return ((y >= 0) << np.arange(SUBSTRING)).sum(axis=-1).astype(np.int32)


def changes(far: int) -> tuple[np.ndarray, np.ndarray]:
    """All changes of up to far bits of a substring, fewest bits first: as integers, and as rows of bits."""
    masks = np.array([sum(1 << b for b in c) for r in range(far + 1) for c in combinations(range(SUBSTRING), r)], np.int32)
    return masks, (masks[:, None] >> np.arange(SUBSTRING) & 1).astype(np.float32)


NEAR = 1 + SUBSTRING


def costs(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """(rows, changes): the squared margins that a change goes against; up to one bit always comes first."""
    out = np.minimum(y.astype(np.float32) ** 2, 1e6) @ bits.T
    out[:, :NEAR] -= 1e9
    return out


def probes_of(y: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): the values that queries probe in one substring, in no order."""
    if n >= VALUES:
        return np.broadcast_to(np.arange(VALUES, dtype=np.int32), (len(y), VALUES))
    masks, bits = changes(FAR if n <= VALUES // 32 else SUBSTRING)
    return values_of(y)[:, None] ^ masks[np.argpartition(costs(y, bits), n - 1, axis=1)[:, :n]]


def probes_needed(sample: np.ndarray, turns: np.ndarray, k: int = K) -> int:
    """The number of probes in each index that retrieves SAMPLE_RECALL of the true k nearest of the sample."""
    own, y = unit(sample), margins(sample, turns)
    code = values_of(y)
    masks, bits = changes(FAR)
    place = np.full(VALUES, -1)
    place[masks] = np.arange(len(masks))
    need = []
    for i in range(min(SAMPLE_QUERIES, len(sample))):
        score = own @ own[i]
        score[i] = -2
        near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        least = np.full(len(near), VALUES)
        for j in range(code.shape[1]):
            at = place[code[near, j] ^ code[i, j]]
            cost = costs(y[i, j][None], bits)[0]
            rank = np.searchsorted(np.sort(cost), cost[at]) + 1
            least = np.minimum(least, np.where(at >= 0, rank, VALUES))
        need += least.tolist()
    found = int(np.quantile(need, SAMPLE_RECALL, method="higher")) if need else VALUES
    return max(NEAR, found if found <= VALUES // 32 else VALUES)


def cosine(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each row with its query, in double precision; scaled first, so that no square overflows or vanishes."""
    queries, rows = queries / np.abs(queries).max(axis=1, keepdims=True), rows / np.abs(rows).max(axis=1, keepdims=True)
    return (rows * queries).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((queries * queries).sum(axis=1)))


def to_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


INDEX = "j int, r int, rid long, value int, small binary, scale float, error float"
PROBES = "j int, r int, qid long, u binary, probes binary"
#: Rows of an Arrow batch that are worked on at a time.
STEP = 512


def _index(batches: Iterator[pa.RecordBatch], model: Broadcast, shift: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX.split(", ")]
    for batch in batches:
        for part in (batch.slice(a, STEP) for a in range(0, len(batch), STEP)):
            vectors = to_matrix(part.column(1))
            code = values_of(margins(vectors, model.value))
            u = unit(vectors)
            scale = (np.abs(u).max(axis=1) / 32767).astype(np.float32)
            small = np.rint(u / scale[:, None]).astype(np.int16)
            # a query's float32 components are off by 6e-8 of its length at most
            error = np.sqrt(((u - small * scale[:, None].astype(np.float64)) ** 2).sum(axis=1)) + 1e-6
            m = code.shape[1]
            over = lambda x: np.repeat(x, m)
            flat = code.ravel()
            packed = pa.array(np.repeat(np.array([x.tobytes() for x in small], object), m), pa.binary())
            columns = [np.tile(np.arange(m, dtype=np.int32), len(code)), flat >> shift, over(part.column(0).to_numpy()), flat]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), packed, pa.array(over(scale.astype(np.float32))), pa.array(over(error.astype(np.float32)))], names)


def _probes(batches: Iterator[pa.RecordBatch], model: Broadcast, shift: int, n: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PROBES.split(", ")]
    for batch in batches:
        for part in (batch.slice(a, 64) for a in range(0, len(batch), 64)):
            vectors = to_matrix(part.column(1))
            y, u = margins(vectors, model.value), unit(vectors).astype(np.float32)
            rows = []
            for j in range(y.shape[1]):
                for qid, own, found in zip(part.column(0).to_pylist(), u, probes_of(y[:, j], n), strict=True):
                    found = np.sort(found)
                    ranges = found >> shift
                    starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])).tolist()
                    rows += [(j, int(ranges[a]), qid, own.tobytes(), found[a:b].astype(np.uint16).tobytes()) for a, b in zip(starts, [*starts[1:], len(found)], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)


FOUND = "qid long, rid long, retrieved long"


def _look_up(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query the rows at its probes that by their bounds may be among its k + 1 best of this task's rows."""
    empty = pd.DataFrame({"qid": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64), "retrieved": np.zeros(0, np.int64)})
    if rows.empty or queries.empty:
        return empty
    rows = rows.sort_values(["value", "rid"], kind="stable")
    value, rid = rows["value"].to_numpy(), rows["rid"].to_numpy()
    small = np.frombuffer(b"".join(rows["small"]), np.int16).reshape(len(rows), -1)
    scale, error = rows["scale"].to_numpy().astype(np.float64), rows["error"].to_numpy().astype(np.float64)
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for qid, u, probes in zip(queries["qid"], queries["u"], queries["probes"], strict=True):
        asked = np.frombuffer(probes, np.uint16).astype(np.int32)
        a, b = np.searchsorted(value, asked), np.searchsorted(value, asked, side="right")
        a, n = a[b > a], (b - a)[b > a]
        if not len(a):
            continue
        hit = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        own = np.frombuffer(u, np.float32).astype(np.float64)
        about, off = (small[hit].astype(np.float64) @ own) * scale[hit], error[hit]
        keep = hit
        if len(hit) > k + 1:
            low = about - off
            keep = hit[about + off >= np.partition(low, len(low) - k - 1)[len(low) - k - 1]]
        out.append((np.full(len(keep), qid), rid[keep], len(hit)))
    if not out:
        return empty
    first = np.cumsum([0] + [len(x[1]) for x in out[:-1]])
    found = pd.DataFrame({"qid": np.concatenate([x[0] for x in out]), "rid": np.concatenate([x[1] for x in out]), "retrieved": 0})
    found.loc[first, "retrieved"] = [x[2] for x in out]
    return found.astype("int64")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = cosine(to_matrix(batch.column(3)), to_matrix(batch.column(2))) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(score)], ["qid", "ids", "retrieved", "score"])


OUT = "query_id long, rank int, vec_id long, score double, n_retrieved long"


class Index:
    """The (substring, value) indexes over entries (rid, v, ids), shuffled by ranges of values."""

    def __init__(self, entries: DataFrame, turns: np.ndarray, n: int, block: int = BLOCK):
        self.entries, self.n = entries, n
        self.model = entries.sparkSession.sparkContext.broadcast(turns)
        self.substrings = -(-turns.shape[1] // SUBSTRING)
        ranges = 1
        while ranges * block < n and ranges < VALUES:
            ranges *= 2
        self.shift = SUBSTRING - (ranges.bit_length() - 1)
        model, shift = self.model, self.shift
        index = entries.select("rid", "v").mapInArrow(lambda batches: _index(batches, model, shift), INDEX)
        # ranges with more entries than a block are split; there are at most substrings * n / block of them
        sizes = index.groupBy("j", "r").agg(F.ceil(F.count("*") / F.lit(2 * block)).cast("int").alias("parts"))
        self.split = cut(sizes.where("parts > 1"))
        small = self.split.count() <= 1_000_000
        self.index = index.join(F.broadcast(self.split) if small else self.split, ["j", "r"], "left").select("*", F.pmod(F.xxhash64("rid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
        self.hint = F.broadcast if small else (lambda x: x)

    def candidates(self, queries: DataFrame, n_queries: int, probes: int, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
        """(qid, rid, retrieved): what the probes of queries (qid, v) retrieve and the bounds let through."""
        model, shift = self.model, self.shift
        asked = queries.select("qid", "v").mapInArrow(lambda batches: _probes(batches, model, shift, probes), PROBES)
        asked = asked.join(self.hint(self.split), ["j", "r"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        # queries that meet in one range, in blocks; index entries go to each block
        ask_blocks = max(1, -(-n_queries // query_block))
        asked = asked.withColumn("a", F.pmod(F.xxhash64("qid"), F.lit(ask_blocks)).cast("int"))
        index = self.index.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(ask_blocks - 1)))).drop("parts")
        keys = ["j", "r", "part", "a"]
        found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(lambda rows, own: _look_up(rows, own, k), FOUND)
        return found.groupBy("qid", "rid").agg(F.sum("retrieved").alias("retrieved"))


def search(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, vec_id, score, n_retrieved): the k nearest of every row whose id every divides.

    n_retrieved counts index entries that the query's probes retrieved, a row once for each substring that found it.
    """
    spark = embeddings.sparkSession
    rows = valid(embeddings, id_col, vector_col)
    sample = sample_of(rows, rows.count())
    if sample.empty:
        return spark.createDataFrame([], OUT)
    lengths = sample["v"].map(len)
    usual = int(lengths.mode()[0])
    rows = rows.where(F.size("v") == usual)
    fitted = np.stack(sample["v"][lengths == usual].to_numpy())
    turns = learn(fitted)
    probes = probes_needed(fitted, turns, k)

    entries = cut(distinct_vectors(rows, k + 1))
    # the ids that ask; their number is a fixed share of the rows
    queries = cut(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("qid")).agg(F.min("v").alias("v")))
    n, open_ = entries.count(), queries.count()
    index = Index(entries, turns, n, block)
    left, rounds = queries, []
    while open_:
        pairs = index.candidates(left, open_, probes, k, query_block)
        joined = pairs.join(entries, "rid").join(queries.withColumnRenamed("v", "q"), "qid").select("qid", "ids", "v", "q", "retrieved")
        scored = joined.mapInArrow(_scores, "qid long, ids array<long>, retrieved long, score double")
        total = Window.partitionBy("qid")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        each = scored.withColumn("n_retrieved", F.sum("retrieved").over(total)).select(F.col("qid").alias("query_id"), F.explode("ids").alias("vec_id"), "score", "n_retrieved").where("vec_id <> query_id")
        best = cut(each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_retrieved"))
        if probes >= VALUES:
            rounds.append(best)
            break
        enough = best.where(F.col("rank") == k).select(F.col("query_id").alias("qid"))
        rounds.append(best.join(enough.withColumnRenamed("qid", "query_id"), "query_id", "left_semi"))
        left = cut(left.join(enough, "qid", "left_anti"))
        open_ = left.count()
        probes = min(VALUES, 8 * probes)
    out = rounds[0] if rounds else spark.createDataFrame([], OUT)
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_multi_index_hashing": op3}
SQL: dict[str, str] = {}
