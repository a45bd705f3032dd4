"""All stages of the corpus pipeline on small tables, written and read between each other, against plain code."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "lorem ipsum dolor sit amet consec tetur elit sed eius tempor labore magna aliqua enim minim veniam quis".split()


def corpus(seed=3):
    """(rows, labels): labelled plain and rude texts, near copies, frequent lines, repeated rows, and nulls."""
    r = random.Random(seed)
    plain = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        text = plain(r.randrange(20, 60))
        if i % 4 == 0:
            text += " grumblor snarfit " + plain(3)
        if i % 3 == 0:
            text = "Shared line of all\n" + text
        rows.append((i, text, "en", "ab"[i % 5 == 0], len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    long = plain(300)
    rows += [(1000 + k, long + f" end{k}", "en", "a", 1) for k in range(5)]
    rows += [rows[1], rows[1], (None, None, None, None, None), (None, plain(30), None, None, 3), (2000, "", "en", "b", 0), (2001, "é 日本語 " * 20, "ja", None, 1)]
    return rows, labels


def stages(spark, folder, rows, labels, extra=False):
    """Each stage's rows, as run makes them."""
    docs = spark.createDataFrame(rows, DOCS)
    if extra:
        docs = docs.selectExpr("*", "doc_id AS k", "text AS taken", "source AS c0", "n_chars AS _row")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_stages_do_their_part(spark, tmp_path):
    import tiktoken

    from lamella.llm import bpe

    rows, labels = corpus()
    toxic, lines, single, mixed, ids = ([tuple(x) for x in df.collect()] for df in stages(spark, tmp_path, rows, labels))
    # rude texts go, all others stay
    assert sorted(map(str, toxic)) == sorted(str(x) for x in rows if "grumblor" not in (x[1] or ""))
    # the frequent line goes, in every document; nothing else does
    expected = ["\n".join(x for x in (t or "").split("\n") if x != "Shared line of all") for _, t, *_ in toxic]
    assert sorted(x[1] for x in lines) == sorted(expected)
    assert all(x[4] == len(x[1]) for x in lines)
    # one of each group of near copies and of equal rows; texts without words stay
    kept = sorted(str(x[0]) for x in single)
    assert kept == sorted([*{str(x[0]) for x in lines if x[0] not in (1001, 1002, 1003, 1004, None)}, "None", "None"])
    assert {x[0] for x in single if x[0] and 1000 <= x[0] < 1005} == {1000}
    assert sum(x[0] == 1 for x in single) == 1
    # sources come near their budgets: a weighs 3, b 1, null 2 of 150 %, none above twice itself
    size = lambda some, s: sum(len((x[1] or "").split()) for x in some if x[3] == s)
    own = {s: size(single, s) for s in ("a", "b", None)}
    for s in own:
        assert 0 <= size(mixed, s) <= 2 * own[s]
    assert sum(size(mixed, s) for s in own) == pytest.approx(1.5 * sum(own.values()), abs=3)
    # ids are the library's
    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path)) if t}, special_tokens={})
    digest = lambda text: hashlib.sha256(np.array(library.encode_ordinary(text or ""), "<u4").tobytes()).hexdigest()
    assert sorted((str(x[0]), x[2]) for x in ids) == sorted((str(x[0]), digest(x[1])) for x in mixed)


def test_columns_of_clashing_names_pass_through(spark, tmp_path):
    rows, labels = corpus(5)
    out = stages(spark, tmp_path, rows[:120] + rows[-10:], labels, extra=True)
    names = ["doc_id", "text", "lang", "source", "n_chars", "k", "taken", "c0", "_row"]
    for df in out[:-1]:
        assert df.columns == names
        for x in df.collect():
            assert x.k == x.doc_id
            assert x.c0 == x.source
    assert out[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_on_empty_tables_and_without_labels(spark, tmp_path):
    rows, _ = corpus()
    for name, some in (("none", []), ("few", rows[:30])):
        spark.createDataFrame(some, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    out = corpus_pipeline.run(spark, f"{tmp_path}/few")
    assert {x.doc_id for x in out.collect()} <= {x[0] for x in rows[:30]}
    assert out.count() > 0
