"""Multi-index hashing against brute force, on plain, repeated and crowded vectors."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lamella.llm import mih


def vectors(n, d, seed):
    r = np.random.default_rng(seed)
    return [[float(v) for v in row] for row in r.standard_normal((n, d)).astype(np.float32)]


def recall(got, good, every=50, k=5):
    """The share of true neighbours found; ranks, scores and queries are checked on the way."""
    found = {}
    for x in got:
        found.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    hit = total = 0
    for q in (i for i in good if i % every == 0):
        ids = [i for i in good if i != q]
        score = {i: float(good[q] @ good[i] / math.sqrt(good[q] @ good[q]) / math.sqrt(good[i] @ good[i])) for i in ids}
        near = sorted(ids, key=lambda i: (-round(score[i], 12), i))[:k]
        own = sorted(found.pop(q))
        assert [x[0] for x in own] == list(range(1, min(k, len(ids)) + 1))
        assert [(-round(s, 12), i) for _, i, s in own] == sorted((-round(s, 12), i) for _, i, s in own)
        for _, i, s in own:
            assert s == pytest.approx(score[i], abs=1e-9)
        hit += len({i for _, i, _ in own} & set(near))
        total += len(near)
    assert not found
    return hit / total


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")


def test_nearest_neighbours(spark):
    rows = list(enumerate(vectors(1500, 24, 3)))
    rows += [(5000 + i, rows[50][1]) for i in range(40)]  # many copies of a query's vector
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (2050, [float("inf")] * 24), (2100, [None] * 24), (None, rows[0][1]), rows[7]]
    good = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)}
    df = frame(spark, rows).repartition(3)
    got = mih.search(df, block=128, query_block=7).collect()
    assert recall(got, good) >= 0.9
    # the index does the work: what the probes retrieve is well under all rows
    assert np.mean([x.n_retrieved for x in got]) < 0.6 * len(good)
    assert mih.search(df.limit(0)).collect() == []
    assert len(mih.search(df.where("vec_id < 3")).collect()) == 2


def test_crowd_of_near_copies_and_extreme_lengths(spark):
    """A third of the rows lies about one vector, in one value of most substrings; lengths from tiny to huge."""
    r = np.random.default_rng(8)
    base = r.standard_normal(16)
    rows = [(i, (base + 0.01 * r.standard_normal(16)).tolist()) for i in range(0, 400)]
    rows += [(i, (r.standard_normal(16) * 10.0 ** r.integers(-150, 150)).tolist()) for i in range(400, 1200)]
    got = mih.search(frame(spark, rows), block=64).collect()
    assert recall(got, {i: np.array(v) / np.abs(v).max() for i, v in rows}) >= 0.9


def test_long_vectors(spark):
    """Far more dimensions than rows of a sample; codes stay as long as others."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 512))
    rows = [(i, (centres[i % 12] + 0.3 * r.standard_normal(512)).tolist()) for i in range(150)]
    got = mih.search(frame(spark, rows)).collect()
    assert recall(got, {i: np.array(v) for i, v in rows}) >= 0.9


def test_few_rows_give_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (50, [0.0, -1.0])]
    got = mih.search(frame(spark, rows)).collect()
    assert recall(got, {i: np.array(v) for i, v in rows}) == 1
    assert len(got) == 6


def test_probes_hold_all_codes_of_the_radius():
    """Each index is probed at all values up to one bit away, so codes within 2 * substrings - 1 bits are retrieved."""
    r = np.random.default_rng(1)
    y = r.standard_normal((20, 4, 16))
    code = mih.values_of(y)
    for n in (mih.NEAR, 100, mih.VALUES):
        found = [[set(x.tolist()) for x in mih.probes_of(y[:, j], n)] for j in range(4)]
        assert all(len(x) == n for own in found for x in own)
        for _ in range(200):
            flips = np.zeros((4, 16), bool)
            flips.ravel()[r.choice(64, r.integers(0, 8), replace=False)] = True
            other = code ^ (flips << np.arange(16)).sum(axis=1)
            assert all(any(int(other[i, j]) in found[j][i] for j in range(4)) for i in range(20))


def test_near_copies_do_not_all_leave_a_task():
    """A query amid 900 near copies hands on about as many rows as one amid scattered rows, the best ones among them."""
    r = np.random.default_rng(4)
    base = r.standard_normal(64)
    rows = np.concatenate([base + 0.1 * r.standard_normal((900, 64)), r.standard_normal((900, 64))])
    model = type("Model", (), {"value": mih.learn(rows, rotations=1)})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["rid", "v"])
    index = pa.Table.from_batches(mih._index([batch], model, 16)).to_pandas()
    asked = base + 0.1 * r.standard_normal((3, 64))
    own = pd.DataFrame({"qid": range(3), "u": [x.tobytes() for x in mih.unit(asked).astype(np.float32)], "probes": [np.arange(mih.VALUES, dtype=np.uint16).tobytes()] * 3})
    found = mih._look_up(index[index["j"] == 0], own, 5)
    assert len(found) <= 3 * 12
    for q in range(3):
        best = np.argsort(-(mih.unit(rows) @ mih.unit(asked)[q]))[:6]
        assert set(best) <= set(found["rid"][found["qid"] == q])
