"""TIFF, nearest neighbours, LM scoring, toxicity, byte-level BPE and HTML on small inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import bpe, lm_scoring, media_tiff, textkernels, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def test_word_kernels():
    import pyarrow as pa

    texts = ["A b\tc", None, "", "tail", "next", "  x  ", "é É", "a b c d e f a b c d e f"]
    kept = {}
    for row, data, starts in textkernels.text_slices(pa.array(texts)):
        words, at = textkernels.word_hashes(data, starts)
        for i, t in enumerate(texts[row : row + len(starts) - 1]):
            own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
            assert at[i + 1] - at[i] == len(own)
            for w, h in zip(own, words[at[i] : at[i + 1]].tolist(), strict=True):
                assert kept.setdefault(w, h) == h
    assert len(set(kept.values())) == len(kept)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 300, 5000, 40_000])
def test_codecs_round_trip(n):
    r = random.Random(n)
    for pool in (b"a", b"ab", b"the of and ", bytes(range(256))):
        data = bytes(r.choice(pool) for _ in range(n))
        assert media_tiff.unpack_bits(media_tiff.pack_bits(data)) == data
        assert media_tiff.lzw_decode(media_tiff.lzw_encode(data)) == data


def plain_lzw(data):
    """TIFF's LZW as the specification tells it, bit by bit."""
    bits = "".join(f"{b:08b}" for b in data)
    table, width, at, old, out = None, 9, 0, None, b""
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, width, old = {i: bytes([i]) for i in range(256)} | {256: b"", 257: b""}, 9, None
            continue
        word = table[code] if code in table else old + old[:1]
        if old is not None:
            table[len(table)] = old + word[:1]
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
        out, old = out + word, word


def plain_pack_bits(data):
    out, i = b"", 0
    while i < len(data):
        n = data[i] - 256 if data[i] > 127 else data[i]
        out += data[i + 1 : i + 2 + n] if n >= 0 else data[i + 1 : i + 2] * (1 - n)
        i += 2 + n if n >= 0 else 2
    return out


def plain_tiff(data):
    """(compression, tiled, predictor, samples) of each page, read by the specification, sample by sample."""
    import struct

    at = struct.unpack("<I", data[4:8])[0]
    while at:
        n = struct.unpack("<H", data[at : at + 2])[0]
        tags = {}
        for tag, kind, count, value in struct.iter_unpack("<HHII", data[at + 2 : at + 2 + 12 * n]):
            size = {3: 2, 4: 4}[kind] * count
            raw = struct.pack("<I", value)[:size] if size <= 4 else data[value : value + size]
            tags[tag] = struct.unpack(f"<{count}{'HI'[kind == 4]}", raw)
        at = struct.unpack("<I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
        (width,), (height,), (how,), tiled = tags[256], tags[257], tags[259], 322 in tags
        wide, high = (tags[322][0], tags[323][0]) if tiled else (width, tags[278][0])
        image = bytearray(width * height * 3)
        across = -(-width // wide)
        for k, (offset, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
            piece = bytearray({5: plain_lzw, 8: zlib.decompress, 32773: plain_pack_bits}[how](data[offset : offset + size]))
            for row in range(len(piece) // (3 * wide)):
                if tags[317] == (2,):
                    for i in range(3 * wide * row + 3, 3 * wide * (row + 1)):
                        piece[i] = (piece[i] + piece[i - 3]) % 256
                y, x = k // across * high + row, k % across * wide
                if y < height:
                    image[3 * (y * width + x) : 3 * (y * width + x + wide)] = piece[3 * wide * row : 3 * wide * (row + 1)]
        yield how, tiled, tags[317][0], bytes(image)


@pytest.mark.parametrize("n", [0, 1, 2, 129, 5000, 20_000])
def test_codecs_against_plain_ones(n):
    r = random.Random(n)
    for pool in (b"a", b"ab", b"the of and ", bytes(range(256))):
        data = bytes(r.choice(pool) for _ in range(n))
        assert plain_lzw(media_tiff.lzw_encode(data)) == data
        assert plain_pack_bits(media_tiff.pack_bits(data)) == data


def test_every_way_to_store_covers_its_share_at_every_size():
    r = random.Random(2)
    shares, sizes = Counter(), Counter()
    for size in (1, 2, 5, 13, 40, 700):
        for _ in range(60 if size < 100 else 8):
            payload = "".join(r.choice("abc dé\n") for _ in range(192 * size)).encode()[: 192 * size]
            read = list(plain_tiff(media_tiff.store(payload)))
            assert b"".join(x[3] for x in read) == payload
            for how, tiled, predictor, part in read:
                shares[how, tiled, predictor] += len(part)
                sizes[how, size] += 1
    total = sum(shares.values())
    print({k: round(v / total, 3) for k, v in shares.items()})
    assert set(shares) == set(media_tiff.WAYS)
    for how, least in ((media_tiff.LZW, 0.25), (media_tiff.PACKBITS, 0.1), (media_tiff.DEFLATE, 0.25)):
        assert sum(v for k, v in shares.items() if k[0] == how) / total > least
        assert all(sizes[how, size] for size in (1, 2, 5, 13, 40, 700))
    for tiled in (True, False):
        assert sum(v for k, v in shares.items() if k[1] == tiled) / total > 0.3


def test_tiff(spark):
    r = random.Random(1)
    texts = ["", None, "short", "short", "é" * 200, "x" * 192, *("".join(r.choice("abc dé\n") for _ in range(n)) for n in (191, 193, 500, 900, 120_000, 250_000))]
    df = docs(spark, texts).withColumnRenamed("lang", "media")
    media = media_tiff.encode_texts(df)
    got = {x.doc_id: x for x in media_tiff.digests(media).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert got[i].n_bytes == len(data)
        assert got[i].payload_bytes == len(payload)
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(payload[-16:])
    assert got[2].media_sha256 == got[3].media_sha256
    rows = media_tiff.pages(media, "id", "media").orderBy("id", "page").collect()
    whole = {}
    for x in rows:
        assert x.error is None
        whole[x.id] = whole.get(x.id, b"") + bytes(x.pixels)
    assert all(whole[i].rstrip(b" ") == (t or "").encode().rstrip(b" ") for i, t in enumerate(texts))
    assert {x.compression for x in rows} == {media_tiff.DEFLATE, media_tiff.LZW, media_tiff.PACKBITS}
    assert {x.tiled for x in rows} == {True, False}
    assert media_tiff.digests(media_tiff.encode_texts(df.limit(0))).collect() == []


def test_broken_tiff_files_give_error_rows(spark):
    good = media_tiff.store(bytes(range(192)) * 4)
    files = [b"", b"no file", good[:40], good[:-30], good.replace(b"II*", b"MM*"), None]
    df = spark.createDataFrame(list(enumerate(files)), "id int, media binary")
    rows = media_tiff.pages(df, "id", "media").collect()
    assert {x.id for x in rows if x.error} == set(range(len(files)))


def test_lm_scores_against_plain_counts(spark):
    texts = ["a b c a b c", "a b c d", "x y z x y", "x y", None, "", "A  B\tc", "a b c a b c", "unseen"]
    targets = {0, 1, 6}
    df = docs(spark, texts).withColumnRenamed("lang", "target")
    ids = spark.createDataFrame([(i,) for i in targets], "id long")
    got = {x.doc_id: x for x in lm_scoring.score(df, ids).collect()}
    words = [(t or "").lower().split() for t in texts]
    singles = [Counter(w for i in own for w in words[i]) for own in (targets, range(len(texts)))]
    pairs = [Counter(p for i in own for p in zip(words[i], words[i][1:], strict=False)) for own in (targets, range(len(texts)))]
    size = len(singles[1]) + 1
    total = [sum(s.values()) for s in singles]
    for i, own in enumerate(words):
        if not own:
            assert got[i].n_tokens == 0
            assert got[i].score is None
            continue
        loss = []
        for k in (0, 1):
            scale = 1.0 if k == 0 else total[0] / total[1]
            p = [(singles[k][w] * scale + lm_scoring.ADD) / (total[k] * scale + lm_scoring.ADD * size) for w in own]
            for j in range(1, len(own)):
                if singles[k][own[j - 1]]:
                    p[j] = lm_scoring.MIX * pairs[k][own[j - 1], own[j]] / singles[k][own[j - 1]] + (1 - lm_scoring.MIX) * p[j]
            loss.append(-sum(map(math.log, p)) / len(p))
        assert got[i].score == pytest.approx(loss[0] - loss[1], abs=1e-5)
    assert got[0].score < got[2].score
    assert lm_scoring.score(df.limit(0), ids).collect() == []


def test_lm_packing():
    r = np.random.Generator(np.random.PCG64(1))
    for values in (np.zeros(0, np.uint64), np.ones(3, np.uint64), np.zeros(9, np.uint64), r.integers(0, 2**63, 5000, dtype=np.uint64), r.integers(1, 3, 5000, dtype=np.uint64), r.integers(0, 2**43, 1, dtype=np.uint64)):
        assert lm_scoring.unpack(lm_scoring.pack(values)).tolist() == values.tolist()


def test_lm_counts_have_no_cap(spark):
    """More distinct words than 65,536, each in pairs of its own, over several ranges."""
    n = 70_000
    texts = [" ".join(f"w{i}" for i in range(k, k + 700)) for k in range(0, n, 700)] + ["w1 w2"] * 3
    df = docs(spark, texts)
    got = {x.doc_id: x for x in lm_scoring.score(df, spark.createDataFrame([(0,)], "id long")).collect()}
    total, size, scale = n + 6, n + 1, 700 / (n + 6)
    # the last text of unrepeated words: each pair once in the background, none in the target
    target = lm_scoring.ADD / (700 + lm_scoring.ADD * size)
    prior = (scale + lm_scoring.ADD) / (total * scale + lm_scoring.ADD * size)
    follows = lm_scoring.MIX + (1 - lm_scoring.MIX) * prior
    assert got[99].target_loss == pytest.approx(-math.log(target), abs=1e-5)
    assert got[99].background_loss == pytest.approx(-(math.log(prior) + 699 * math.log(follows)) / 700, abs=1e-5)


def test_toxicity(spark):
    r = random.Random(6)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "consec", "tetur", "elit", "sed", "eius"]
    rude = ["grumblor", "snarfit"]
    texts, labels = [], []
    for i in range(600):
        own = [r.choice(plain) + r.choice(plain) for _ in range(r.randrange(5, 60))]
        if toxic := i % 4 == 0:
            own.insert(r.randrange(len(own)), r.choice(rude) + r.choice(["", "en", "s"]))
        texts.append(" ".join(own))
        labels.append((i, 1, int(toxic)))
    texts += ["", None, "word " * 30_000 + "grumblor"]
    df = docs(spark, texts).withColumnRenamed("lang", "toxic")
    marks = spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, marks)
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.97
    assert got[600] == got[601] < 0.5 <= got[602]
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    none = toxicity.train(df, marks.limit(0))
    assert none is None
    assert {x.score for x in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).collect() == []
    # a row without an id is scored and held out by no fold
    loose = spark.createDataFrame([(None, "grumblor " * 9, "en", "s", 0)], DOCS)
    assert toxicity.score(loose, model).first().score >= 0.5
    assert not loose.select(toxicity.held_out(F.col("doc_id"))).first()[0]
    marked = {x.doc_id: x.h for x in df.select("doc_id", toxicity.held_out(df.doc_id).alias("h")).collect()}
    assert all(marked[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))


TEXTS = [
    "", None, "a", " ", " \n\n  a", "it's we'll 'S don't 'tis o'''s  's", "aaaa" * 100, "日本語テスト 🎉👍🏽", "x\x1c\x1dy\x85z 　w", "12345 １２３ ²½ 4th",
    "<|endoftext|>", "ab" * 700, "zqxj" * 200, "tab\t\t end  \r\n", "plain words and more plain words", "é ñ ß ﬁ",
]


def test_bpe(spark):
    import tiktoken

    path, pattern = bpe.vocabulary()
    tokens = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    df = docs(spark, TEXTS).withColumnRenamed("lang", "ids")
    got = {x.doc_id: x for x in bpe.digests(df).collect()}
    encoded = bpe.encode(df)
    for x in bpe.decode(encoded, encoded.columns[-1]).collect():
        text = TEXTS[x.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert x[-2] == ids
        assert x[-1] == text
        assert got[x.doc_id].n_tokens == len(ids)
        assert got[x.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[x.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(df.limit(0)).collect() == []


def test_bpe_long_words():
    """Unbroken words in time that grows with their length, equal to the library's."""
    import time

    import tiktoken

    path, pattern = bpe.vocabulary()
    own = bpe.Codec(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.rank, special_tokens={})
    r = random.Random(4)
    letters = lambda pool, n: "".join(r.choice(pool) for _ in range(n))
    words = [
        "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(100_000)), letters("日本語中国人大小山川", 20_000), letters("abcdefghijklmnopqrstuvwxyz", 60_000),
        "a" * 60_000, "ab" * 30_000, letters("thes", 8_000), letters("tanrdi", 8_000), letters(".-=*", 8_000), letters("01", 20_000),
    ]
    for word in words:
        start = time.time()
        ids, data = next(own.encode([word]))
        assert time.time() - start < 30
        assert data == word.encode()
        assert np.frombuffer(ids, "<u4").tolist() == library._core_bpe.encode_single_piece(word.encode())


def test_bpe_contractions_one_by_one_or_together(monkeypatch):
    """Words of a few letters, so that equal, overlapping and dangerous pairs abound."""
    import tiktoken

    path, pattern = bpe.vocabulary()
    own = bpe.Codec(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.rank, special_tokens={})
    r = random.Random(5)
    words = ["".join(r.choice(pool) for _ in range(r.randrange(1, 60))).encode() for pool in ("a", "an", "the", "stanri", "esinghtd", "é", "日本", "ss ") for _ in range(300)]
    for least in (1, 1000):
        monkeypatch.setattr(bpe, "LONG_WORD", least)
        w, ids = own.contract(words)
        for i, word in enumerate(words):
            assert ids[w == i].tolist() == library._core_bpe.encode_single_piece(word)


def test_words_of_all_characters():
    import regex

    _, pattern = bpe.vocabulary()
    assert pattern == bpe.KNOWN_PATTERN
    kinds = bpe.character_kinds()
    r = random.Random(8)
    pool = [*" '\n\t s re ve ll d m t 1a!é", " ", "　", "日", "²", "😀", "́"]
    for _ in range(1500):
        texts = ["".join(r.choice(pool) for _ in range(r.randrange(0, 14))) for _ in range(3)]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0] + [len(t) for t in texts])[:-1]
        expected = [b + m.start() for b, t in zip(begin.tolist(), texts, strict=True) for m in regex.finditer(pattern, t)]
        full = np.array([len(t) > 0 for t in texts], bool)
        assert bpe.word_starts(codes, begin[full], kinds).tolist() == expected, texts


def test_cache_starts_anew_when_it_is_full(monkeypatch):
    path, pattern = bpe.vocabulary()
    own = bpe.Codec(path, pattern)
    texts = [t for t in TEXTS if t] * 2
    expected = list(own.encode(texts))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 30)
    monkeypatch.setattr(bpe, "CALL_BYTES", 20)
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    own.clear()
    assert list(own.encode(texts)) == expected
