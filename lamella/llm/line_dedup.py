"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position.

All of it is DataFrame functions. A document's distinct line hashes are formed inside its row, so counting documents
needs no distinct over the corpus, only sums that are formed before the shuffle. Frequent hashes are broadcast when
they have been counted to be few; else a sort-merge join takes them, which Spark splits at hot lines.

Rows are numbered by their place in the input's files, so documents should come from files, as a stage's do.

Defined cases: each row is a document, also where rows or ids repeat; null or empty text is one empty line; empty
keys never drop; with every line dropped the text is empty; an empty table gives an empty result; of the input's
columns only the id and the text are read by ``line_table``, and ``dedup`` keeps all columns as they are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import SPACES, ascii_lower, cut, fresh, table

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Up to so many frequent hashes (32 bytes each) are broadcast.
BROADCAST_ROWS = 250_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def line_hash(key: Column) -> Column:
    """128 bits, so that no two keys of a corpus meet by chance."""
    return F.unhex(F.md5(key))


def frequent_lines(lines: DataFrame, min_documents: int) -> DataFrame:
    """Hashes that stand in at least min_documents rows of ``lines`` (column hashes: a row's distinct hashes)."""
    each = lines.select(F.explode("hashes").alias("hash"))
    return each.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("hash")


def line_table(documents: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """documents with the columns n_lines, n_dropped and kept (the text without frequent lines) added."""
    row, text, line, pos, hash_, n, mark = (fresh(documents, f"_{c}") for c in ("row", "text", "line", "pos", "hash", "n", "mark"))
    base = documents.withColumn(text, F.coalesce(documents[text_col].cast("string"), F.lit("")))
    lines = F.split(F.col(text), "\n", -1)
    keys = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_chars)
    hashed = base.select(F.array_distinct(F.transform(keys, line_hash)).alias("hashes"))
    frequent = cut(frequent_lines(hashed, min_documents).select(F.col("hash").alias(hash_), F.lit(True).alias(mark)))
    few = frequent.count() <= BROADCAST_ROWS

    kept_columns = [c for c in documents.columns if c != text_col]
    numbered = base.withColumn(row, F.monotonically_increasing_id())
    exploded = numbered.select(row, *(F.col(f"`{c}`") for c in kept_columns), F.posexplode(lines).alias(pos, line))
    key = line_key(F.col(line))
    exploded = exploded.withColumn(hash_, F.when(F.length(key) >= min_chars, line_hash(key)))
    marked = exploded.join(F.broadcast(frequent) if few else frequent.hint("merge"), hash_, "left")
    stays = F.col(mark).isNull()
    again = marked.groupBy(row).agg(
        *(F.first(F.col(f"`{c}`")).alias(c) for c in kept_columns),
        F.count("*").alias("n_lines"),
        F.count(mark).alias("n_dropped"),
        F.sort_array(F.collect_list(F.when(stays, F.struct(F.col(pos), F.col(line))))).alias(n),
    )
    return again.withColumn("kept", F.array_join(F.transform(n, lambda x: x[line]), "\n")).drop(row, n)


def dedup(documents: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """documents without their frequent lines: the same columns, n_chars (where there is one) recounted."""
    out = line_table(documents, text_col, min_documents)
    columns = [F.col("kept").alias(c) if c == text_col else F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns]
    return out.select(*columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_line_dedup": op8}
SQL = {
    "op8_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT r, doc_id, string_split(text, chr(10)) AS x FROM d)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r
"""
}
