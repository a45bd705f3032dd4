"""Mixing sources to target weights: hash-random keys, a range sort within each source, distributed prefix sums of
word counts, and a cut at each source's exact budget, with whole epochs before it where the budget asks for them.

All of it is DataFrame functions. Rows are range-sorted by (source, key, id, size, place in the input): a source lies in
as many partitions as its share of the rows asks for, and so do rows that share an id, or have none. Sums run inside a
partition, those of the partitions before come from a table with a row for each partition and source in it; its number
of rows is counted before it is broadcast. The table of sources is worked on in the same way.

Defined cases: null text counts no words; null sources are one source, the last; sources without words get nothing;
repeated rows count each for itself, and so do rows of one id or of none; documents with equal keys follow their id and
size; an empty table gives an empty result. The cut falls on a word: one document of each source may be taken in part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import SPACE_CLASS, WORD_PATTERN, cut, table
from lamella.plans.prefix import running

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Tables of sources that are counted to have no more rows are broadcast.
BROADCAST_ROWS = 100_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, docs) with target: weighted shares of the whole, none above most times its source.

    The excess of capped sources goes to the others by weight; the level at which that ends is found with running
    sums over the sources in the order in which they reach their caps. The table has a row for each source.
    """
    ranked = running(sizes, [], [F.col("source").isNull(), "source"], {"place": F.lit(1)})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ranked = running(ranked, [], [F.col("cap") / F.col("weight"), "place"], {"cap_below": "cap", "weight_below": "weight"})
    whole = ranked.agg((F.sum("source_size") * F.lit(float(share))).alias("total"), F.sum("weight").alias("weights"))
    level = (F.col("total") - F.col("cap_below")) / (F.col("weights") - F.col("weight_below"))
    open_ = cut(ranked.crossJoin(whole).withColumn("level", level))
    # the first source in that order which stays below its cap sets the level of all such
    stays = F.col("cap") / F.col("weight") > F.col("level")
    first = open_.agg(F.min(F.when(stays, F.struct((F.col("cap") / F.col("weight")).alias("at"), "place", "level")))["level"].alias("final"))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return open_.crossJoin(first).select("source", "source_size", target.alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """rows (id, source, size and any others) with source_size, target and taken: how many of a row's words the mix
    takes, whole epochs included."""
    budgets = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    budget = F.floor("target")
    sources = budgets.select(
        F.struct("source").alias("s"), "source_size", "target", budget.alias("budget"),
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"),
    )
    few = sources.count() <= BROADCAST_ROWS
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    placed = running(rows.withColumn("row", F.monotonically_increasing_id()), ["source"], [key, "id", "size", "row"], {"before": "size"})
    joined = placed.withColumn("s", F.struct("source")).join(F.broadcast(sources) if few else sources.hint("merge"), "s")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return joined.withColumn("taken", taken.cast("long")).select(*rows.columns, "source_size", "target", "taken")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row: its id, source, size, its source's size and target, and how many of its words the mix takes."""
    rows = documents.select(documents[id_col].alias("id"), documents[source_col].alias("source"), words_of(documents[text_col]).alias("size"))
    return plan(cut(rows)).withColumnRenamed("id", "doc_id")


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"([{SPACE_CLASS}]*{WORD_PATTERN})"), F.lit(1)), F.lit(1), n.cast("int")), "")


def apply_mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: a row for each epoch that takes a document, the last one cut at the budget's last word."""
    names = [f"c{i}" for i in range(len(documents.columns))]
    own = dict(zip(documents.columns, names, strict=True))
    rows = documents.toDF(*names)
    rows = rows.select("*", F.col(own[id_col]).alias("id"), F.col(own[source_col]).alias("source"), words_of(F.col(own[text_col])).alias("size"))
    taken = plan(rows).where("taken > 0")
    epochs = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    each = taken.withColumn("k", F.explode(epochs))
    part = F.least(F.col("size"), F.col("taken") - F.col("k") * F.col("size"))
    text = own[text_col]
    out = each.withColumn(text, F.when(part < F.col("size"), leading_words(F.col(text), part)).otherwise(F.col(text)))
    return out.select(*(F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(n).alias(c) for c, n in own.items()))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_mix_to_weights": op6}
SQL = {
    "op6_mix_to_weights": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap, sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
o AS (SELECT level FROM l WHERE cap / weight > level ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM o) IS NULL THEN cap ELSE least(cap, (SELECT level FROM o) * weight) END AS target FROM l),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size
  - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(rest, size)) AS BIGINT) AS taken FROM p
"""
}
