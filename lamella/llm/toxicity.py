"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

An n-gram is ``ORDERS`` characters of the lower-cased text in which each run of other characters than letters and
digits is one blank. Features are presence in the text; each is scaled by the logarithm of the ratio of its smoothed
frequencies in toxic and clean labelled texts, and a logistic regression is fitted on the scaled features. All of a
text is scored, batch by batch, with one table of weights of fixed size.

Bounds, all parameters of ``train``: it is fitted on at most ``max_toxic`` toxic and ``max_clean`` clean labelled
documents, picked by a hash of their ids, and keeps the at most ``features`` n-grams whose likelihood ratio statistic is
largest and at least ``evidence``. N-grams are counted in the tasks and chosen in Spark; of the documents only the kept
features reach the driver, however long the texts. Labels count only where crc32 of the id's text modulo ``FOLDS``
isn't 0. Nothing of the scoring is bounded: all of each text is scored.

Defined cases: null text scores as the empty text; null ids are scored, never learnt from, and count as held out by
no fold; labels that are null or contradict each other are left out; without labels of both kinds every score is the
constant 0; repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import cut, fresh, release, released, table
from lamella.llm.textkernels import mix64, sorted_unique

ORDERS = (4, 5, 6)
BITS = 20
FOLDS = 5
MAX_TOXIC = 2_000
MAX_CLEAN = 4_000
#: Features kept: those with so much evidence, and of them at most FEATURES; the rest only add noise to long texts.
EVIDENCE = 12.0
FEATURES = 20_000
EPOCHS = 300
L2 = 1e-4
SLICE_CHARS = 1 << 17
#: Rows of a batch that are worked on at a time.
STEP = 1024


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _classes() -> np.ndarray:
    """1 for code points of letters and digits; built once in each worker."""
    kept = np.zeros(0x110000, bool)
    for c in range(0x110000):
        if chr(c).isalnum():
            kept[c] = True
    return kept


_kept: list[np.ndarray] = []


def gram_slices(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, feature numbers, the text of each) for consecutive texts."""
    if not _kept:
        _kept.append(_classes())
    row = 0
    while row < len(texts):
        end, size = row, 0
        while end < len(texts) and (end == row or size + len(texts[end] or "") <= SLICE_CHARS):
            size += len(texts[end] or "")
            end += 1
        # a blank at both ends marks where words begin and end
        joined = "".join(f" {(t or '').lower()} " for t in texts[row:end])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len((t or "").lower()) + 2 for t in texts[row:end]])
        owner = np.repeat(np.arange(end - row), lengths)
        word = _kept[0][codes]
        stays = word.copy()
        stays[1:] |= word[:-1]  # of a run of others only the first stays, as a blank
        stays[np.cumsum(lengths) - lengths] = True
        codes, owner = np.where(word, codes, np.uint32(32))[stays].astype(np.uint64), owner[stays]
        numbers, owners = [], []
        for order in ORDERS:
            n = max(0, len(codes) - order + 1)
            h = np.full(n, np.uint64(order))
            for k in range(order):
                h = h * np.uint64(0x100000001B3) + codes[k : k + n]
            inside = owner[:n] == owner[order - 1 : order - 1 + n]
            numbers.append((mix64(h) >> np.uint64(64 - BITS))[inside].astype(np.int32))
            owners.append(owner[:n][inside].astype(np.int32))
        yield row, np.concatenate(numbers), np.concatenate(owners)
        row = end


def _presence(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its distinct features) of each text."""
    for row, numbers, owner in gram_slices(texts):
        pairs = sorted_unique(owner.astype(np.int64) << BITS | numbers)
        last = int(pairs[-1] >> BITS) + 1 if len(pairs) else 0
        ends = np.searchsorted(pairs, np.arange(1, last + 1, dtype=np.int64) << BITS).tolist()
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            yield row + i, pairs[a:b] & ((1 << BITS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, clean, toxic): in how many texts of each label of this task a feature is."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        labels = batch.column("toxic").to_pylist()
        for i, own in _presence(batch.column("text").to_pylist()):
            seen[labels[i], own] += 1
    feature = np.flatnonzero(seen.any(axis=0)).astype(np.int32)
    yield pa.record_batch([pa.array(feature), pa.array(seen[0, feature]), pa.array(seen[1, feature])], ["feature", "clean", "toxic"])


def _kept_features(batches: Iterator[pa.RecordBatch], kept) -> Iterator[pa.RecordBatch]:
    """(toxic, features): the places of a text's kept features in their list."""
    place = np.full(1 << BITS, -1, np.int32)
    place[kept.value] = np.arange(len(kept.value))
    for batch in batches:
        sets = [b""] * len(batch)
        for i, own in _presence(batch.column("text").to_pylist()):
            at = place[own]
            sets[i] = at[at >= 0].astype("<i4").tobytes()
        yield pa.record_batch([batch.column("toxic"), pa.array(sets, pa.binary())], ["toxic", "features"])


def fit(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept) from (label, places of its features) and the features' log-count ratios."""
    labels = np.array([y for y, _ in rows], np.float64)
    row = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    column = np.concatenate([x for _, x in rows])
    scaled = ratio[column]
    weight, bias = np.zeros(len(ratio)), 0.0
    step_w, step_b = np.zeros(len(ratio)), 0.0
    for _ in range(EPOCHS):  # full-batch AdaGrad: deterministic
        margin = np.clip(bias + np.bincount(row, scaled * weight[column], len(rows)), -30, 30)
        slope = (1 / (1 + np.exp(-margin)) - labels) / len(rows)
        grad = np.bincount(column, scaled * slope[row], len(ratio)) + L2 * weight
        step_w += grad**2
        step_b += slope.sum() ** 2
        weight -= 0.3 * grad / np.sqrt(step_w + 1e-12)
        bias -= 0.3 * slope.sum() / np.sqrt(step_b + 1e-12)
    return weight * ratio, float(bias)


def evidence_of(clean: Column, toxic: Column, n_clean: int, n_toxic: int) -> Column:
    """Twice the log likelihood ratio of a feature's counts against the same share in both labels."""
    both, total = clean + toxic, float(n_clean + n_toxic)
    term = lambda seen, n: F.when(seen > 0, seen * F.ln(seen / (both * F.lit(n / total)))).otherwise(0.0)
    return 2 * (term(clean, n_clean) + term(toxic, n_toxic))


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
    folds: int = FOLDS, evidence: float = EVIDENCE, features: int = FEATURES,
) -> tuple[np.ndarray, float] | None:
    """The classifier, from labelled documents outside the held-out fold; None without both labels."""
    key = F.col("key")
    one = labels.select(labels[id_col].alias("key"), labels[label_col].cast("int").alias("toxic")).where("toxic IN (0, 1) AND key IS NOT NULL")
    one = one.where(~held_out(key, folds)).groupBy("key").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    mixed = F.md5(key.cast("string"))
    ids = one.where("toxic = 1").orderBy(mixed, "key").limit(max_toxic).union(one.where("toxic = 0").orderBy(mixed, "key").limit(max_clean))
    # at most max_toxic + max_clean ids; equal texts of one label count once
    texts = documents.select(documents[id_col].alias("key"), F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"))
    rows = cut(texts.join(F.broadcast(ids), "key").select("toxic", "text").distinct())
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    counts = rows.mapInArrow(released(_counts), "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    told = F.round(evidence_of(F.col("clean"), F.col("toxic"), n[0], n[1]), 9)
    # 2 ** BITS features at most, of which `features` come to the driver
    kept = counts.withColumn("e", told).where(F.col("e") >= evidence).orderBy(F.col("e").desc(), "feature").limit(features).toPandas()
    if kept.empty:
        return None
    ratio = np.log((kept["toxic"].to_numpy() + 0.5) / (n[1] + 1)) - np.log((kept["clean"].to_numpy() + 0.5) / (n[0] + 1))
    shared = documents.sparkSession.sparkContext.broadcast(kept["feature"].to_numpy())
    found = rows.mapInArrow(released(partial(_kept_features, kept=shared)), "toxic int, features binary")
    gathered = sorted((r["toxic"], bytes(r["features"])) for r in found.toLocalIterator())
    weight, bias = fit([(y, np.frombuffer(x, "<i4")) for y, x in gathered], ratio)
    del gathered
    out = np.zeros(1 << BITS, np.float32)
    out[kept["feature"].to_numpy()] = weight
    release()
    return out, bias


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    weight, bias = model.value
    for batch in (whole.slice(a, STEP) for whole in batches for a in range(0, len(whole), STEP)):
        margin = np.full(len(batch), bias)
        for row, numbers, owner in gram_slices(batch.column(batch.num_columns - 1).to_pylist()):
            hit = weight[numbers] != 0
            # presence, not counts: each feature of a text once
            pairs = sorted_unique(owner[hit].astype(np.int64) << BITS | numbers[hit])
            sums = np.bincount(pairs >> BITS, weight[pairs & ((1 << BITS) - 1)])
            margin[row : row + len(sums)] += sums
        score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])


def score(documents: DataFrame, model: tuple[np.ndarray, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row of documents."""
    rows = documents.select(documents[id_col].alias("doc_id"), documents[text_col].cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(released(partial(_scores, model=shared)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """documents without those that score threshold or more; columns and rows otherwise as they are."""
    model = train(documents, labels, id_col, text_col)
    if model is None:
        return documents
    names = [f"c{i}" for i in range(len(documents.columns))]
    copy = fresh(documents, "_text")
    rows = documents.withColumn(copy, documents[text_col].cast("string")).toDF(*names, "t")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, documents.schema, strict=True))
    scored = rows.mapInArrow(released(partial(_scores, model=shared)), f"{kinds}, score double")
    return scored.where(F.col("score") < threshold).drop("score").toDF(*documents.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_toxicity": op5}
SQL: dict[str, str] = {}
