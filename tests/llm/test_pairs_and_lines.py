"""Near duplicates, lines, mixing and secrets against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from lamella.llm import line_dedup, mixing, ngram_join, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)] if s else i) for k, (i, s) in enumerate(sets))


def corpus(seed, groups=12, loners=30):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randrange(60))
    passage = [word() for _ in range(40)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(r.randrange(5, 120))]
        for _ in range(r.randrange(1, 2 + 5 * g)):
            own = list(base)
            for _ in range(r.randrange(0, 3)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own) if r.random() < 0.8 else "  ".join(own).upper())
    texts += [" ".join([*passage, *(word() for _ in range(r.randrange(1, 30)))]) for _ in range(loners)]
    texts += ["", " \n\t", "one", "one", "One", "one two", "a b c d e", "a b c d e f", None, "nb sp x y", "É é", "é É"]
    r.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("seed", "tile", "hot"), [(1, 128, 1 << 17), (2, 2, 1 << 17), (3, 3, 2)])
def test_components(spark, seed, tile, hot, monkeypatch):
    rows = corpus(seed)
    if tile < 100:
        monkeypatch.setattr(ngram_join, "SIEVE_TILE", 4)
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.components(df, tile=tile, hot_list=hot)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_components_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.components(df).collect()), key=str)
    assert got == sorted([(4, 1, 4), (4, 1, 4), (5, 0, 5), (None, 1, 4)], key=str)
    assert ngram_join.components(df.limit(0)).collect() == []


def test_rows_without_id_link(spark):
    """A class of null ids alone links, and chains of other documents run through it."""
    words = [f"w{i}" for i in range(64)]
    texts = [(7, words[:50]), (None, words[5:55]), (9, words[10:60]), (None, ["x", *words[:50]]), (None, ["far", "from", "all", "these", "texts", "here"])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.components(df).collect()), key=str)
    assert got == sorted([(7, 46, 7), (None, 46, 7), (9, 46, 7), (None, 47, 7), (None, 2, None)], key=str)


def test_long_text_and_kept_rows(spark):
    r = random.Random(5)
    long = " ".join(str(r.randrange(10**6)) for _ in range(60_000))
    rows = [(1, long, "en", "s", 1), (2, long + " tail", "en", "s", 1), (3, "other words that stand alone here", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "_kept")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == [1, 3]


def test_one_row_of_each_component_stays(spark):
    """Rows of one id with other texts, equal rows, and null ids: one row of each component, and all rows without words."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a + " end", "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "t", 2), (3, b, "en", "u", 2)]
    rows += [(None, "alone among all of these texts", "en", "s", 1)] * 3 + [(None, b + " x", "en", "s", 1)] + [(7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "copies").withColumnRenamed("source", "rid")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=str)
    firsts = [x for x in got if x[0] == 1 and x[1] in (a, a + " end")]
    assert len(firsts) == 1
    got.remove(firsts[0])
    assert got == sorted([(1, b), (None, "alone among all of these texts"), (7, ""), (7, ""), (None, None)], key=str)


def test_large_blocks_are_sieved_in_bands(spark, monkeypatch):
    """A block of many tiles and sizes: texts that share a passage, among them near copies of all sizes."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for k in range(120):
        base = passage + [f"own{k}x{i}" for i in range(r.randrange(0, 60))]
        for _ in range(r.choice([1, 1, 2, 3])):
            rows.append((len(rows), " ".join(base + [f"tail{len(rows)}" for _ in range(r.randrange(0, 2))])))
    monkeypatch.setattr(ngram_join, "SIEVE_TILE", 5)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile=4)
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_facing_bitmaps_find_what_all_pairs_find():
    import numpy as np

    r = np.random.default_rng(6)
    sets = []
    for _ in range(40):
        base = r.integers(0, 2**63, int(r.integers(1, 300)), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base, r.integers(0, 2**63, int(r.integers(0, 9)), dtype=np.uint64)])) for _ in range(2)]
    bits, sizes, side = [np.frombuffer(ngram_join.parities(x), np.uint8) for x in sets], np.array([len(x) for x in sets]), r.integers(0, 2, len(sets))
    pairs = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and side[i] != side[j] and ngram_join.near([bits[i], bits[j]], sizes[[i, j]], 80).all()}
    assert ngram_join.near(bits, sizes, 80, side).tolist() == [any(i == a for a, _ in pairs) for i in range(len(sets))]


def test_parity_bitmaps_never_lose_a_link():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 400))
        a = np.sort(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(n * 0.95))], r.integers(0, 2**63, int(r.integers(0, max(1, n // 6))), dtype=np.uint64)]))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 80 * (len(a) + len(b) - o):
            bits = [np.frombuffer(ngram_join.parities(x), np.uint8) for x in (a, b)]
            assert ngram_join.near(bits, np.array([len(a), len(b)]), 80).all()


def test_line_dedup(spark):
    r = random.Random(2)
    common = ["  Shared LINE ", "shared line", "other\tline", ""]
    rows = [(i, "\n".join(r.choice([*common, f"own {i} {k}"]) for k in range(r.randrange(1, 6))), "en", "s", 0) for i in range(40)]
    rows += [(40, None, "en", None, 0), (41, "", "en", "s", 0), (7, rows[7][1], "en", "s", 0), (42, "shared line", "en", "s", 0)]
    key = lambda x: lower(x).strip(" \t\n\v\f\r")
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    expected = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < 10]
        expected.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "_line").repartition(3)
    for few in (250_000, -1):
        line_dedup.BROADCAST_ROWS = few
        out = line_dedup.line_table(df)
        assert sorted(map(tuple, out.select("doc_id", "n_lines", "n_dropped", "kept").collect())) == sorted(expected)
    line_dedup.BROADCAST_ROWS = 250_000
    whole = line_dedup.dedup(df)
    assert whole.columns == df.columns
    assert sorted((x.doc_id, x.text, x.n_chars) for x in whole.collect()) == sorted((i, t, len(t)) for i, _, _, t in expected)
    assert line_dedup.line_table(df.limit(0)).collect() == []


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, list(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return target


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(0, 30))), "en", r.choice(["b", "b", "b", "a", None, "c", "É"]), 0) for i in range(300)]
    rows += [(300, None, "en", "empty", 0), rows[5], rows[5], (None, "x y z", "en", "a", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(sizes)
    taken = defaultdict(int)
    for x in out:
        assert x.source_size == sizes[x.source]
        assert x.target == pytest.approx(target[x.source])
        assert 0 <= x.taken <= 2 * x["size"]
        taken[x.source] += x.taken
    for s in sizes:
        assert taken[s] == pytest.approx(int(target[s]), abs=1)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    words = defaultdict(int)
    for x in mixed.collect():
        words[x.source] += len((x.text or "").split())
        assert x.n_chars == len(x.text)
    for s in sizes:
        assert words[s] == taken[s]
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_of_equal_ids_at_the_cut(spark):
    """A third of the rows has no id, another third one id: budgets are met to the word, rows are taken one by one."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, "one two three" if i % 2 else f"a b {i}", "en", "ab"[i % 5 == 0], 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "before").withColumnRenamed("n_chars", "row").repartition(5)
    out = mixing.mix(df).collect()
    target = brute_targets({s: sum(len(t.split()) for _, t, _, u, _ in rows if u == s) for s in "ab"})
    assert len(out) == 900
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    texts = mixed.collect()
    for s in "ab":
        assert sum(x.taken for x in out if x.source == s) == int(target[s])
        assert sum(len(x.text.split()) for x in texts if x.source == s) == int(target[s])


def test_secrets_without_source_are_owners_of_their_own(spark, tmp_path):
    """The query against its SQL, with null sources and ids, columns of clashing names, and a very long text."""
    import duckdb

    secret = "token=abcdefgh12345678"
    rows = [(1, secret, None, 0), (2, secret, None, 0), (3, "secret: zzzzzzzzzzzz", None, 0), (4, "secret: yyyyyyyyyyyy", "s", 0), (5, "secret: yyyyyyyyyyyy", "s", 0), (6, "secret: yyyyyyyyyyyy", "s", 0), (None, "token=onlyhere1", None, 0)]
    rows += [(8, "word " * 50_000 + secret + " A1b2" + "Zz9" * 12, "t", 0), (9, None, None, 0), (9, "", "q", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, value int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = db.execute(secrets.SQL["op7_secret_scan"])
    names = [c[0] for c in result.description]
    got = secrets.op7(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, result.fetchall()))
    live = {x.doc_id: x.n_live for x in got.collect() if x.doc_id in (1, 3, 4, 8)}
    assert live == {1: 0, 3: 1, 4: 1, 8: 0}


def test_secrets(spark):
    hexed, key = "0123456789abcdef" * 2, "AKIA" + "Q" * 16
    texts = [
        f"password = '{hexed}' then token:abc and SECRET:\"longenough1\"",
        f"é😀 api_key={key} api-key=zzzzzzzzzz Apikey : abcdefgh",
        f"secret: token: abcdefghij {key}{key} AKIAshort",
        "passwd=ſecret password=short ſecret=abcdefghi tokenK=abcdefgh",
        "A1" + "b" * 30 + " plain " + hexed.upper(),
        "\n".join(["token=12345678"] * 50),
        "", None,
    ]
    rows = [(i, t, "en", f"s{i % 3}" if i else None, 0) for i, t in enumerate(texts * 2)]
    kinds = (
        ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    df = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in secrets.scan(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        # of other alphabets' letters, only what Python folds into ASCII would differ
        plain = (t or "").replace("ſ", "\u0001").replace("K", "\u0002")
        spans = sorted((m.start(), o, m.end(), k) for o, (k, p, fits) in enumerate(kinds) for m in p.finditer(plain) if fits(m))
        base = [(s.start, s.ord, s.end, s.kind) for s in got[i].spans if s.kind != "key"]
        assert base == spans, (i, t)
    assert all(s.live == (s.owners <= 1) for x in got.values() for s in x.spans)
    assert secrets.scan(df.limit(0)).collect() == []
    assert hashlib.sha256(b"").hexdigest()


def test_the_driver_lets_go_of_finished_stages(spark):
    """The driver's heap is collected as a whole while links become components, before it is full."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "u long, v long")
    assert {tuple(r) for r in ngram_join.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert whole() > before
