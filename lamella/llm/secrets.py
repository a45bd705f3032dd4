"""Secret scans: spans that look like credentials, and how many repositories and owners hold each of them.

All of it is DataFrame functions. One pass over the texts finds the spans with their places; nothing of the texts
goes further. Candidate hashes are counted by distinct repositories (``repo_col``) and owners (``owner_col``), in
sums that are formed before the shuffle, and each candidate becomes ``copied`` (held by more than ``max_owners``
owners: an example or a test value) or ``live`` (specific to its owners). Besides the base kinds the method adds
spans of kind ``key``: long mixed runs without any word before them, where the counts show them to be live.

Defined cases: null text is empty; each row is scanned for itself, also where rows repeat; a null owner or
repository counts as one of its own; rows without candidates have counts of 0 and empty lists; an empty table gives
an empty result. Places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import cut, table


def either_case(word: str) -> str:
    """The pattern of word with A-Z and a-z alike, and no letter of another alphabet."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


WORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
#: kind -> (pattern, the group that holds the value)
KINDS: dict[str, tuple[str, int]] = {
    "assign": (rf"(?:{WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1),
    "access": (r"AKIA[A-Z0-9]{12,}", 0),
    "hex": (r"[0-9a-f]{32,}", 0),
    "key": (r"[A-Za-z0-9_]{24,}", 0),
}
#: What a value of a kind must hold besides.
HOLDS = {"key": ("[0-9]", "[a-z]", "[A-Z]")}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 8
MAX_OWNERS = 1
SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:binary>>"


def matches(text: Column, kind: str) -> Column:
    """The leftmost non-overlapping matches of a kind, with places, in order: what lies before each match is matched
    along with it, from the end of the one before, so that places are sums of lengths."""
    pattern, group = KINDS[kind]
    ord_ = list(KINDS).index(kind)
    whole = rf"(?s)\G(.*?)({pattern})"
    gaps = F.regexp_extract_all(text, F.lit(whole), F.lit(1))
    spans = F.regexp_extract_all(text, F.lit(whole), F.lit(2))
    values = F.regexp_extract_all(text, F.lit(whole), F.lit(2 + group))
    parts = F.arrays_zip(gaps.alias("gap"), spans.alias("span"), values.alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["span"])
        value = F.unhex(F.md5(part["value"]))
        one = F.array(F.struct(start.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))).cast(SPAN)
        fits = F.length(part["value"]) >= LEAST_VALUE
        for held in HOLDS.get(kind, ()):
            fits &= part["value"].rlike(held)
        found = F.when(fits, F.concat(state["found"], one)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    found = F.aggregate(parts, empty, add, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def digest_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """candidates (value, repo, owner) -> (value, repos, owners, live). Distinct counts in two sums, whatever a value's rows."""
    each = candidates.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    whole = by_owner.groupBy("value").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.sum("n").alias("occurrences"))
    return whole.withColumn("live", F.col("owners") <= max_owners)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """For each row: id, base spans and added spans (start, kind, end, live, owners, repos), in order."""
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    owner = F.coalesce(documents[owner_col].cast("string"), F.concat(F.lit("\0"), F.coalesce(documents[repo_col].cast("string"), F.lit(""))))
    rows = documents.select(documents[id_col].alias("doc_id"), owner.alias("owner"), F.coalesce(documents[repo_col].cast("string"), F.lit("\0")).alias("repo"), text.alias("text"))
    found = rows.select("doc_id", "owner", "repo", F.concat(*(matches(F.col("text"), k) for k in KINDS)).alias("found"))
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    each = found.where(F.size("found") > 0).select("row", "doc_id", "owner", "repo", F.explode("found").alias("s"))
    each = each.select("row", "doc_id", "owner", "repo", F.col("s.value").alias("value"), "s")
    known = ownership(each.select("value", "repo", "owner"), max_owners)
    judged = each.join(known.hint("merge"), "value")
    inner = F.struct(F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "live", "owners", "repos")
    kept = judged.where(F.col("s.kind").isin(*BASE) | F.col("live"))
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(inner)).alias("spans"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,live:boolean,owners:bigint,repos:bigint>>")
    return found.select("row", "doc_id").join(spans.hint("merge"), "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    live = F.size(F.filter(base, lambda s: s["live"])).cast("long")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(digest_of(base), 256).alias("base_sha256"), digest_of(F.col("spans")).alias("spans"), live.alias("n_live"), (F.size(base).cast("long") - live).alias("n_copied"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_secret_scan": op7}
def _kind_sql(ord_: int, kind: str) -> str:
    """DuckDB's form of one kind; its patterns are linear, so no anchor is needed."""
    pattern, group = KINDS[kind]
    quoted = f"(?s)(.*?)({pattern})".replace("'", "''")
    fits = " AND ".join(["length(value) >= 8", *(f"regexp_matches(value, '{x}')" for x in HOLDS.get(kind, ()))])
    lists = ", ".join(f"unnest(regexp_extract_all(text, '{quoted}', {g})) AS {n}" for g, n in ((1, "gap"), (2, "span"), (2 + group, "value")))
    return f"""SELECT r, {ord_} AS ord, '{kind}' AS kind, value, CAST(e - length(span) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
  SELECT *, sum(length(gap) + length(span)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
    SELECT r, generate_subscripts(regexp_extract_all(text, '{quoted}', 1), 1) AS i, {lists} FROM d)) WHERE {fits}"""


SQL = {
    "op7_secret_scan": "WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),\nm AS ("
    + "\nUNION ALL ".join(_kind_sql(i, k) for i, k in enumerate(KINDS))
    + """),
o AS (SELECT value, count(DISTINCT coalesce(source, chr(1) || coalesce(CAST(doc_id AS VARCHAR), ''))) <= 1 AS live FROM m JOIN d USING (r) GROUP BY value),
j AS (SELECT m.*, o.live FROM m JOIN o USING (value) WHERE kind <> 'key' OR o.live),
g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS h,
  count(*) FILTER (WHERE kind <> 'key' AND live) AS n_live, count(*) FILTER (WHERE kind <> 'key' AND NOT live) AS n_copied,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE kind <> 'key'), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM j GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (r)
"""
}
