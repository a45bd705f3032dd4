"""LM scoring by cross-entropy difference: a target and a background bigram model over one vocabulary.

The vocabulary is every word of the corpus, and one more for words never seen. Both models count unigrams and bigrams
of the same words in the same way: the target over the documents that ``targets`` names, the background over all
documents, scaled to the target's number of tokens, so that smoothing weighs alike in both ("matched"). 64-bit hashes
stand for words and for pairs of them. A document's score is the mean over its words of target loss less background
loss, in nats: the lower, the nearer to the target.

Counts are exact, whatever the corpus, and no one holds all of them. Texts are cut in chunks by their place in the
input; a chunk sends its distinct words and pairs, sorted and packed, to ranges of the hashes, whose number grows with
the corpus. A range adds up what all chunks sent and answers each chunk with the sums in the order of its question.
Texts then meet the answers to their chunk. Rows are numbered by their place, so inputs should be files; a chunk that
doesn't fit its answers is an error.

Defined cases: null, empty or blank texts have no tokens and score null; without target documents the two models are
equal and scores are 0; repeated rows count each for itself; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import cut, released, table
from lamella.llm.textkernels import mix64, text_slices, word_hashes

MIX, ADD = 0.6, 0.1
#: Bytes of text in a chunk, and for each range of hashes.
CHUNK_BYTES, RANGE_BYTES = 1 << 23, 1 << 22
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORD, PAIR = 0, 1
#: Bits of the sieve of target ids, in powers of two: 8 MB, whatever the corpus.
SIEVE_LOG2 = 26


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers by planes of bytes, the largest first; only planes that are in use, each as it is or
    deflated where that is shorter."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = [len(values).to_bytes(8, "little")]
    for i in range(8):
        if (own := np.ascontiguousarray(planes[:, i])).any():
            raw = own.tobytes()
            # the low planes of sorted hashes are noise
            small = zlib.compress(raw, 1) if len(zlib.compress(raw[:512], 1)) < 0.9 * len(raw[:512]) else raw
            small = small if len(small) < len(raw) else raw
            out += [i.to_bytes(1, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:8], "little"), 8
    planes = np.zeros((n, 8), np.uint8)
    while at < len(data):
        size = int.from_bytes(data[at + 1 : at + 9], "little")
        own = data[at + 9 : at + 9 + size]
        planes[:, data[at]] = np.frombuffer(own if size == n else zlib.decompress(own), np.uint8)
        at += 9 + size
    return planes.reshape(-1).view(np.uint64)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys, the places in it where a new one begins, and how often each occurs."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order, new, np.diff(np.append(new, len(keys)))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, the place of each text's first one and the end, and the hash of each word's pair with the
    word before it, of no use for a text's first word."""
    words, at, size = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, data, starts in text_slices(texts):
        own, place = word_hashes(data, starts)
        words.append(own)
        at.append(place[1:] + size)
        size += len(own)
    words, at = np.concatenate(words), np.concatenate(at)
    pairs = np.zeros_like(words)
    pairs[1:] = mix64(mix64(words[:-1] * _LEFT) + words[1:] * _RIGHT)
    return words, at, pairs


def _follows(at: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words has one before it in its text."""
    out = np.ones(n, bool)
    out[at[:-1][at[:-1] < at[1:]]] = False
    return out


def _range_ends(keys: np.ndarray, ranges_log2: int) -> np.ndarray:
    return np.searchsorted(keys >> np.uint64(64 - ranges_log2), np.arange((1 << ranges_log2) + 1, dtype=np.uint64))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch of (part, ..., text) and the chunk of each of its rows, whatever the batches."""
    before = 0
    for batch in batches:
        if not len(batch):
            continue
        size = batch.column(-1).cast(pa.large_string())
        ends = before + np.cumsum(pa.compute.fill_null(pa.compute.binary_length(size), 0).to_numpy(zero_copy_only=False))
        yield batch, (batch.column(0).to_numpy().astype(np.int64) << 32) + np.append(before, ends[:-1]) // CHUNK_BYTES
        before = int(ends[-1])


def _with_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's rows (doc_id, text), deflated many at a time."""
    for batch, chunk in _chunked(batches):
        cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
        packed = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema.remove(0), options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_batch(batch.slice(a, b - a).select([1, 2]))
            packed.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(chunk[cuts[:-1]]), pa.array(packed, pa.binary())], ["chunk", "rows"])


def _asked(batches: Iterator[pa.RecordBatch], side: int, ranges_log2: int) -> Iterator[pa.RecordBatch]:
    """What each chunk asks each range: its distinct words or pairs there, and how often it has them."""

    def out(chunk: int, texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        words, at, pairs = _tokens(pa.chunked_array(texts, pa.large_string()))
        for kind, keys in ((WORD, words), (PAIR, pairs[_follows(at, len(words))])):
            order, new, n = _counted(keys)
            keys = keys[order[new]]
            ends = _range_ends(keys, ranges_log2)
            rows = [(int(r), pack(_steps(keys[ends[r] : ends[r + 1]])), pack(n[ends[r] : ends[r + 1]])) for r in np.flatnonzero(np.diff(ends))]
            if rows:
                place, packed, counts = zip(*rows, strict=True)
                k = len(rows)
                yield pa.record_batch([pa.array([kind] * k, pa.int32()), pa.array(place, pa.int32()), pa.array([side] * k, pa.int32()), pa.array([chunk] * k, pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], ["kind", "place", "side", "chunk", "keys", "n"])

    now, held = None, []
    for batch, chunk in _chunked(batches):
        texts = batch.column(-1).cast(pa.large_string())
        cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and chunk[a] != now:
                yield from out(now, held)
                held = []
            now = int(chunk[a])
            held.append(texts.slice(a, b - a))
    if held:
        yield from out(now, held)


def _answered(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a range, in the order of each background chunk's keys; then a row with the number of keys and sums."""
    kind, place = (k.as_py() for k in key)
    asked, keys, counts = [], [], []
    for batch in group:
        for side, chunk, steps, n in zip(*(batch.column(c).to_pylist() for c in ("side", "chunk", "keys", "n")), strict=True):
            own = np.cumsum(unpack(steps), dtype=np.uint64)
            asked.append((side, chunk, len(own)))
            keys.append(own)
            counts.append(unpack(n))
    order, new, _ = _counted(np.concatenate(keys))
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    sums = [np.zeros(len(new), np.uint64), np.zeros(len(new), np.uint64)]
    at = 0
    for (side, _, k), n in zip(asked, counts, strict=True):
        sums[side][number[at : at + k]] += n  # a chunk's keys are distinct
        at += k
    names = ["kind", "place", "chunk", "n0", "n1", "check", "distinct", "tokens0", "tokens1"]
    at = 0
    for (side, chunk, k), own in zip(asked, keys, strict=True):
        if side == 0:
            mine = number[at : at + k]
            check = int(own.sum(dtype=np.uint64).view(np.int64))
            yield pa.record_batch(
                [pa.array([kind], pa.int32()), pa.array([place], pa.int32()), pa.array([chunk], pa.int64()), pa.array([pack(sums[0][mine])], pa.binary()), pa.array([pack(sums[1][mine])], pa.binary()), pa.array([check], pa.int64())]
                + [pa.nulls(1, pa.int64())] * 3,
                names,
            )
        at += k
    total = [len(new), int(sums[0].sum()), int(sums[1].sum())]
    yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([place], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), *(pa.array([t], pa.int64()) for t in total)], names)


def _sums(keys: np.ndarray, answers: list[tuple], ranges_log2: int) -> list[np.ndarray]:
    """The background's and the target's count of each key."""
    order, new, _ = _counted(keys)
    distinct = keys[order[new]]
    ends = _range_ends(distinct, ranges_log2)
    found = [np.zeros(len(distinct)), np.zeros(len(distinct))]
    missing = len(distinct)
    for place, n0, n1, check in answers:
        own = slice(int(ends[place]), int(ends[place + 1]))
        n = unpack(n0)
        if len(n) != own.stop - own.start or int(distinct[own].sum(dtype=np.uint64).view(np.int64)) != check:
            raise RuntimeError("the documents came in another order when they were read again; read them from files")
        found[0][own], found[1][own] = n, unpack(n1)
        missing -= len(n)
    if missing:
        raise RuntimeError("the documents came in another order when they were read again; read them from files")
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
    return [f[number] for f in found]


def _scores(texts: pa.Table, answers: pa.Table, ranges_log2: int, size: int, tokens: tuple[int, int]) -> pa.Table:
    """The scores of a chunk's documents."""
    texts = pa.concat_tables([pa.ipc.open_stream(rows.as_buffer()).read_all() for rows in texts.column("rows")])
    words, at, pairs = _tokens(texts.column("text").cast(pa.large_string()))
    follows = _follows(at, len(words))
    given: dict[int, list[tuple]] = {WORD: [], PAIR: []}
    for kind, *answer in zip(*(answers.column(c).to_pylist() for c in ("kind", "place", "n0", "n1", "check")), strict=True):
        given[kind].append(answer)
    single, pair = _sums(words, given[WORD], ranges_log2), _sums(pairs[follows], given[PAIR], ranges_log2)
    k, n = texts.num_rows, np.diff(at)
    owner = np.repeat(np.arange(k), n)
    means = []
    for side in (1 if tokens[1] else 0, 0):
        # the background is scaled to the target's number of tokens
        scale = tokens[1] / tokens[0] if side == 0 and tokens[1] else 1.0
        p = (single[side] * scale + ADD) / (tokens[side] * scale + ADD * (size + 1))
        context = single[side][np.flatnonzero(follows) - 1]
        ratio = np.divide(pair[side], context, out=np.zeros(len(context)), where=context > 0)
        p[follows] = np.where(context > 0, MIX * ratio + (1 - MIX) * p[follows], p[follows])
        means.append(np.divide(np.bincount(owner, -np.log(p), k), n, out=np.zeros(k), where=n > 0))
    columns = [pa.array(m, mask=n == 0) for m in (*means, means[0] - means[1])]
    return pa.table([texts.column("doc_id"), pa.array(n.astype(np.int64)), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def _sieve(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """The rows whose hash is marked, without it: all target documents and a few others."""
    marked = bits.value
    for batch in batches:
        at = batch.column(2).to_numpy().astype(np.int64)
        yield batch.select([0, 1]).filter(pa.array((marked[at >> 3] >> (at & 7)) & 1 == 1))


def target_texts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The texts of rows (doc_id, text) whose id is in targets (id). The ids' hashes mark a bitmap of fixed size, which
    holds back most other texts before rows and ids are joined; the join makes it exact."""
    marks = targets.select(F.col("id").cast(rows.schema["doc_id"].dataType).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SIEVE_LOG2)
    buckets = marks.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    bits = np.zeros(1 << (SIEVE_LOG2 - 3), np.uint8)
    for r in buckets.toLocalIterator():
        bits[r["bucket"] << 12 : (r["bucket"] + 1) << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string"
    near = rows.select("doc_id", "text", place.alias("at")).mapInArrow(partial(_sieve, bits=rows.sparkSession.sparkContext.broadcast(bits)), schema)
    return near.join(marks.hint("merge"), "doc_id", "left_semi").select("text")


def score(documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score); targets has the ids of the target corpus (column id)."""
    rows = documents.select(documents[id_col].alias("doc_id"), documents[text_col].cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges_log2 = max(3, (size // RANGE_BYTES).bit_length())
    part = F.spark_partition_id().alias("part")
    asked = lambda texts, side: texts.select(part, "text").mapInArrow(
        released(partial(_asked, side=side, ranges_log2=ranges_log2)), "kind int, place int, side int, chunk long, keys binary, n binary"
    )
    questions = asked(rows, 0).unionAll(asked(target_texts(rows, targets), 1))
    answers = cut(questions.groupBy("kind", "place").applyInArrow(_answered, "kind int, place int, chunk long, n0 binary, n1 binary, check long, distinct long, tokens0 long, tokens1 long"))
    words = answers.where(F.col("chunk").isNull() & (F.col("kind") == WORD))
    vocabulary, *tokens = (n or 0 for n in words.agg(F.sum("distinct"), F.sum("tokens0"), F.sum("tokens1")).first())
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.select(part, "doc_id", "text").mapInArrow(released(_with_chunk), "chunk long, rows binary").groupBy("chunk")
    given = answers.where(F.col("chunk").isNotNull()).select("chunk", "kind", "place", "n0", "n1", "check").groupBy("chunk")
    work = partial(_scores, ranges_log2=ranges_log2, size=vocabulary, tokens=tuple(tokens))
    # the engine reads a function's arguments to tell whether it wants the key
    return texts.cogroup(given).applyInArrow(lambda left, right: work(left, right), f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus is the documents whose quality is marked as good."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return score(documents, good.select(F.col("doc_id").alias("id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_lm_cross_entropy_difference": op4}
SQL: dict[str, str] = {}
