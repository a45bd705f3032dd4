"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A rank file gives each token's bytes and its rank, which is its id. The merge table has a row for every way to put a
token together from two. Texts split into words by the tokenizer's pattern; a word that is a token is encoded as
such. The others become rows (word, position, token); the recursive step joins neighbours with the merge table,
finds each word's lowest rank and contracts its leftmost pair of that rank, until no word has a pair left. Decoding
joins ids with the tokens' bytes and aggregates them in order of position.

Words of over ``LONG_WORD`` bytes are first cut where no token of the vocabulary occurs across: no contraction can
cross there, so the pieces are words of their own. Pieces that are still longer go through a second form of the query
with the same results, whose steps return only rows that changed, so that work and memory are in proportion to a
word's length: a step contracts all pairs of a word's lowest rank that don't overlap, from the left, where that is what
one at a time would do, that is unless a token so made has, with a neighbour, a pair of a still lower rank. Words with
such a pair (the table ``danger`` knows them) contract their leftmost pair only.

A task meets a word's query once: results stay in a cache of ``CACHE_WORDS`` words.

Defined cases: null text is empty; empty text has no ids and decodes to nothing; special tokens are ordinary text;
repeated rows are encoded alike; any length is encoded whole, a slice of texts in memory at a time; further columns
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lamella.llm.common import fresh, released, table
from lamella.llm.textkernels import span_hashes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 300_000
SLICE_CHARS = 500_000
#: Words, and bytes of words, in one recursive query; a longer word has a query of its own.
CALL_WORDS, CALL_BYTES = 8_000, 200_000
#: DuckDB's memory in MB, and how many bytes more it may take for each byte of a word beyond CALL_BYTES.
MEMORY_MB, MEMORY_BYTE = 300, 1_000
LONG_WORD = 32
#: Rows of a batch that are worked on at a time.
ROWS = 1024

#: Positions number the bytes of all words of a call; np and nid are the place and id of the neighbour to the right.
#: For words of up to LONG_WORD bytes: each step contracts one pair and returns all rows of words that had one.
SHORT_STEP = """
WITH RECURSIVE t(step, w, p, id, np, nid) AS (
  SELECT 0, w, p, id, np, nid FROM state
  UNION ALL
  SELECT step + 1, t.w, t.p, CASE WHEN t.p = best THEN merged ELSE id END, CASE WHEN t.p = best THEN x_np ELSE np END,
    CASE WHEN t.p = best THEN x_nid WHEN np = best THEN merged ELSE nid END
  FROM t JOIN (
    SELECT q.w, (k & 4294967295)::INT AS best, nb, (k >> 32)::INT AS merged, x.np AS x_np, x.nid AS x_nid
    FROM (
      SELECT w, min(k) AS k, arg_min(np, k) AS nb
      FROM (SELECT w, np, (merged::BIGINT << 32) | p AS k FROM t JOIN merges m ON m.ab = (t.id::BIGINT << 32) | t.nid) GROUP BY w
    ) q JOIN t x ON x.p = q.nb
  ) q ON t.w = q.w
  WHERE t.p <> nb
), u AS MATERIALIZED (SELECT step, w, p, id FROM t)
SELECT u.w, u.id FROM u JOIN (SELECT w, max(step) AS last FROM u GROUP BY w) l ON u.w = l.w AND u.step = l.last ORDER BY p
"""
#: For longer words: each step contracts all pairs that it may and returns the rows that changed; merged is what a row
#: and its neighbour make. A row that was contracted into its left neighbour has no id any more.
LONG_STEP = """
WITH RECURSIVE t(p, w, id, np, nid, merged) USING KEY (p) AS (
  SELECT p, w, id, np, nid, merged FROM state LEFT JOIN merges ON ab = (id::BIGINT << 32) | nid
  UNION (
    WITH lowest AS (SELECT w, min(merged) AS r FROM recurring.t WHERE merged IS NOT NULL GROUP BY w),
    found AS (
      SELECT x.w, x.p, x.np AS q, l.r, lag(x.np) OVER (PARTITION BY x.w ORDER BY x.p) IS DISTINCT FROM x.p AS first
      FROM recurring.t x JOIN lowest l ON x.w = l.w AND x.merged = l.r
    ),
    chained AS (SELECT *, sum(first::INT) OVER (PARTITION BY w ORDER BY p) AS chain FROM found),
    apart AS (
      SELECT w, p, q, r, row_number() OVER (PARTITION BY w, chain ORDER BY p) AS k, row_number() OVER (PARTITION BY w ORDER BY p) AS n
      FROM chained QUALIFY k % 2 = 1
    ),
    pairs AS (SELECT e.w, e.p, e.q, e.r, e.n, y.np AS after, y.nid AS follows FROM apart e JOIN recurring.t y ON y.p = e.q),
    before AS (SELECT e.w, z.p, z.id, z.np, e.r FROM recurring.t z JOIN apart e ON z.np = e.p),
    unsafe AS (
      SELECT w FROM (
        SELECT w, r, (r::BIGINT << 32) | follows AS ab FROM pairs
        UNION ALL SELECT w, r, (id::BIGINT << 32) | r FROM before
        UNION ALL SELECT w, r, (r::BIGINT << 32) | r FROM pairs
      ) made JOIN danger ON danger.ab = made.ab AND danger.part = made.r GROUP BY w
    ),
    chosen AS (SELECT * FROM pairs WHERE n = 1 OR w NOT IN (SELECT w FROM unsafe)),
    changed AS (
      SELECT c.p, c.w, c.r AS id, c.after AS np, CASE WHEN h.p IS NULL THEN c.follows ELSE c.r END AS nid FROM chosen c LEFT JOIN chosen h ON h.p = c.after
      UNION ALL
      SELECT z.p, z.w, z.id, z.np, z.r FROM before z JOIN chosen c ON c.p = z.np LEFT JOIN chosen gone ON gone.q = z.p WHERE gone.q IS NULL
      UNION ALL
      SELECT q, w, NULL, NULL, NULL FROM chosen
    )
    SELECT p, w, id, np, nid, merged FROM changed LEFT JOIN merges ON ab = (id::BIGINT << 32) | nid
  )
)
SELECT w, id FROM t WHERE id IS NOT NULL ORDER BY p
"""
#: One string for all sequences of a call, in order; it is cut where the sequences' token lengths end.
DECODE = "SELECT string_agg(hex, '' ORDER BY p) AS hex FROM ids JOIN tokens USING (id)"


LETTER, NUMBER, SPACE, OTHER = range(4)
#: The split pattern that word_starts follows: contractions, then letters, numbers or others with one blank before
#: them, then white space, whose last character goes apart where a word follows.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ONE, TWO = tuple(map(ord, "stmd")), tuple(tuple(map(ord, x)) for x in ("re", "ve", "ll"))


def character_kinds() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
        elif kind == "Z" or 9 <= c <= 13 or c == 0x85:
            out[c] = SPACE
    return out


def word_starts(codes: np.ndarray, texts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pattern's words begin in the code points of joined texts; texts: where each (not empty) one begins."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind, blank = kinds[codes], codes == 32
    first = np.zeros(n + 4, bool)
    first[texts] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | first[1:n]
    # white space before a word: its last character is the word's own blank, or a word by itself
    space = kind == SPACE
    before = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    new[before] = True
    new[before[blank[before]] + 1] = False
    # contractions begin where no word is open
    at = np.flatnonzero(codes == 39)
    open_ = ~first[at] & ((kind[at - 1] == OTHER) | blank[at - 1])
    at = at[~open_]
    padded = np.append(codes, np.zeros(3, codes.dtype))
    inside = lambda k: ~first[at + k] & (at + k < n)
    one = np.isin(padded[at + 1], ONE) & inside(1)
    two = np.zeros(len(at), bool)
    for a, b in TWO:
        two |= (padded[at + 1] == a) & (padded[at + 2] == b)
    two &= inside(1) & inside(2)
    new[at[one | two] + 1] = False
    ends = np.concatenate([at[one] + 2, at[two] + 3])
    new[ends[ends < n]] = True
    # the letter after a contraction's only letter is no word's beginning unless it was said above
    return np.flatnonzero(new)


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Codec:
    """The DuckDB side: a connection of one thread with the merge table and the tokens."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens) if t}
        self.pattern = None if pattern == KNOWN_PATTERN else regex.compile(pattern)
        self.kinds = character_kinds()
        ab, merged, risk, part = [], [], [], []
        self.ordered = sorted(self.rank)
        for i, token in enumerate(self.tokens):
            for k in range(1, len(token)):
                left, right = self.rank.get(token[:k]), self.rank.get(token[k:])
                if left is not None and right is not None:
                    ab.append(left << 32 | right)
                    merged.append(i)
                    for own in {left, right}:
                        if i < own:
                            risk.append(ab[-1])
                            part.append(own)
        self.byte = np.array([self.rank[bytes((i,))] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self._table("merges", ab=np.array(ab, np.int64), merged=np.array(merged, np.int32))
        self._table("danger", ab=np.array(risk, np.int64), part=np.array(part, np.int32))
        self.db.register("given", pa.table({"id": pa.array(range(len(self.tokens)), pa.int32()), "hex": [t.hex() for t in self.tokens]}))
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.clear()

    def clear(self) -> None:
        """The cache: hashes in order, and for each its ids and its bytes in two flat arrays."""
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat = [np.zeros(0, np.uint32), np.zeros(0, np.uint8)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def borders(self, word: bytes) -> list[int]:
        """Where a word can be cut: no token of the vocabulary occurs in it across these places."""
        out, reach = [0], 0
        for p in range(len(word)):
            if p >= reach and p:
                out.append(p)
            # tokens that begin here, by ever longer prefixes in the ordered list
            for k in range(2, len(word) - p + 1):
                part = word[p : p + k]
                at = bisect_left(self.ordered, part)
                if at == len(self.ordered) or not self.ordered[at].startswith(part):
                    break
                if self.ordered[at] == part:
                    reach = max(reach, p + k)
        return [*out, len(word)]

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word, id) of the words' tokens, in order."""
        pieces, owner = [], []
        for i, word in enumerate(words):
            cuts = self.borders(word) if len(word) > LONG_WORD else [0, len(word)]
            pieces += [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            owner += [i] * (len(cuts) - 1)
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        short = np.array([len(x) <= LONG_WORD for x in pieces], bool)
        for query, chosen in ((SHORT_STEP, np.flatnonzero(short).tolist()), (LONG_STEP, np.flatnonzero(~short).tolist())):
            at = 0
            while at < len(chosen):
                end, size = at, 0
                while end < len(chosen) and (end == at or (end - at < CALL_WORDS and size + len(pieces[chosen[end]]) <= CALL_BYTES)):
                    size += len(pieces[chosen[end]])
                    end += 1
                w, ids = self._contract([pieces[i] for i in chosen[at:end]], size, query)
                done.append((np.array(chosen[at:end], np.int64)[w], ids))
                at = end
        piece, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(piece, kind="stable")
        return np.array(owner, np.int64)[piece[order]], ids[order]

    def _contract(self, words: list[bytes], size: int, query: str) -> tuple[np.ndarray, np.ndarray]:
        w = np.repeat(np.arange(len(words), dtype=np.int32), [len(x) for x in words])
        p = np.arange(len(w), dtype=np.int32)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        last = np.append(w[1:] != w[:-1], True)
        more = max(0, size - CALL_BYTES) * MEMORY_BYTE // 1_000_000
        if more:
            self.db.execute(f"SET memory_limit = '{MEMORY_MB + more}MB'")
        self._table("state", w=w, p=p, id=ids, np=pa.array(np.append(p[1:], p[:1]), mask=last), nid=pa.array(np.append(ids[1:], ids[:1]), mask=last))
        out = self.db.execute(query).fetchnumpy()
        self.db.execute("DROP TABLE state")
        if more:
            self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        return np.asarray(out["w"]), np.asarray(out["id"])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each sequence; ends are where the sequences end in ids."""
        if not len(ids):
            return [b""] * len(ends)
        self._table("ids", p=np.arange(len(ids)), id=ids.astype(np.int32))
        data = bytes.fromhex(self.db.execute(DECODE).fetchall()[0][0])
        at = np.append(0, np.cumsum(self.length[ids]))[np.append(0, ends)].tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        """Puts words into the cache; keys are their hashes."""
        whole = np.fromiter((self.rank.get(x, -1) for x in raw), np.int64, len(raw))
        split = np.flatnonzero(whole < 0)
        w, ids = self.contract([raw[i] for i in split])
        single = np.flatnonzero(whole >= 0)
        w, ids = np.concatenate([split[w], single]), np.concatenate([ids, whole[single]])
        order = np.argsort(w, kind="stable")  # positions already ascend inside each word
        w, ids = w[order], ids[order]
        ends = np.searchsorted(w, np.arange(1, len(raw) + 1))
        texts = self.decode(ids, ends)
        made = [ids.astype(np.uint32), np.frombuffer(b"".join(texts), np.uint8)]
        for i, lengths in enumerate((np.diff(ends, prepend=0), np.array([len(x) for x in texts], np.int64))):
            self.flat[i] = np.concatenate([self.flat[i], made[i]])
            self.ends[i] = np.concatenate([self.ends[i], self.ends[i][-1] + np.cumsum(lengths)])
        slot = np.concatenate([self.slot, len(self.slot) + np.arange(len(raw))])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Whether the cache has each key."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _gather(self, i: int, slot: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The ids (0) or bytes (1) of words one after another, and where each word's end."""
        start, length = self.ends[i][slot], self.ends[i][slot + 1] - self.ends[i][slot]
        ends = np.cumsum(length)
        return self.flat[i][np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)].tobytes(), ends

    def _starts(self, joined: str, codes: np.ndarray, texts: list[str], begin: np.ndarray) -> np.ndarray:
        if self.pattern is None:
            return word_starts(codes, begin[np.array([len(t) > 0 for t in texts], bool)], self.kinds)
        return np.array([b + m.start() for b, t in zip(begin.tolist(), texts, strict=True) for m in self.pattern.finditer(t)], np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, the bytes they decode to) of each text."""
        row = 0
        while row < len(texts):
            end, size = row, 0
            while end < len(texts) and (end == row or size < SLICE_CHARS):
                size += len(texts[end] or "")
                end += 1
            part = [t or "" for t in texts[row:end]]
            yield from self._slice(part)
            row = end

    def _slice(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lengths) - lengths
        starts = self._starts(joined, codes, texts, begin)
        stops = np.append(starts[1:], len(codes)) if len(starts) else starts
        keys = span_hashes(codes, starts, stops)
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
        distinct, example = ordered[new], order[new]
        missing = ~self._find(distinct)
        if len(self.keys) + int(missing.sum()) > CACHE_WORDS:
            self.clear()
            missing[:] = True
        todo, where = distinct[missing], example[missing]
        for k in range(0, len(todo), CALL_WORDS):
            own = where[k : k + CALL_WORDS]
            self.learn(todo[k : k + CALL_WORDS], [joined[a:b].encode() for a, b in zip(starts[own].tolist(), stops[own].tolist(), strict=True)])
        slot = np.empty(len(keys), np.int64)
        slot[order] = self.slot[np.searchsorted(self.keys, distinct)][np.cumsum(new) - 1] if len(keys) else 0
        upto = np.append(0, np.searchsorted(starts, np.append(begin[1:], len(codes)))).tolist()
        (ids, id_ends), (data, data_ends) = self._gather(0, slot), self._gather(1, slot)
        id_ends, data_ends = np.append(0, id_ends) * 4, np.append(0, data_ends)
        for text, a, b in zip(texts, upto[:-1], upto[1:], strict=True):
            out = ids[id_ends[a] : id_ends[b]], data[data_ends[a] : data_ends[b]]
            if out[1] != text.encode():
                raise ValueError("two words share a hash, or the pattern leaves characters out")
            yield out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, len(whole), ROWS)):
        rows = [(len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for a, b in own.encode(batch.column(1).to_pylist())]
        n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in batches:
        for start in range(0, len(batch), 64):
            part = batch.slice(start, 64)
            ids = [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in own.encode(part.column(part.num_columns - 1).to_pylist())]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*part.schema.names[:-1], "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in batches:
        for start in range(0, len(batch), 64):
            part = batch.slice(start, 64)
            lists = [x or [] for x in part.column(part.num_columns - 1).to_pylist()]
            ids = np.array([i for x in lists for i in x], np.int64)
            texts = [data.decode("utf-8", "replace") for data in own.decode(ids, np.cumsum([len(x) for x in lists]))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "text"])


def _with(df: DataFrame, source: str, work, name: str, kind: str) -> DataFrame:
    """df with the column name added, which work makes of the column source; other columns pass through by place."""
    path, pattern = vocabulary()
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.withColumn(fresh(df, "_source"), df[source]).toDF(*names, "source")
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True)), f"{work.keywords['name']} {kind}"])
    made = rows.mapInArrow(released(partial(work.func, path=path, pattern=pattern)), schema)
    return made.toDF(*df.columns, fresh(df, name))


def encode(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with the column ids (array of int) added."""
    return _with(documents, text_col, partial(_encoded, name="ids"), "ids", "array<int>")


def decode(encoded: DataFrame, ids_col: str = "ids") -> DataFrame:
    """encoded with the column decoded (string) added."""
    return _with(encoded, ids_col, partial(_decoded, name="text"), "decoded", "string")


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path, pattern = vocabulary()
    rows = documents.select(documents[id_col].alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return rows.mapInArrow(released(partial(_digests, path=path, pattern=pattern)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_byte_bpe": op9}
SQL: dict[str, str] = {}
