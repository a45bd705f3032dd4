"""Turning rows to columns and back, sets of rows, lists, digests and audits.

Values that become columns are named by the caller, so no query first runs over the data to find them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.plans import table


def wider(rows: DataFrame, keys: list[str], name: str, value: str, names: list[str], prefix: str = "") -> DataFrame:
    """One row a key with a column for each of names; an error where a key has a name twice, null where it has none."""

    def cell(n: str) -> Column:
        own = F.col(name) == n
        return F.when(F.count_if(own) > 1, F.raise_error(F.lit(f"{n} comes twice for a key"))).otherwise(F.max(F.when(own, F.col(value)))).alias(prefix + n)

    return rows.groupBy(*keys).agg(*map(cell, names))


def longer(rows: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """A row for each key and column; the values are read as doubles, nulls stay."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return rows.select(*keys, F.inline(F.array(*pairs)))


def one_hot(rows: DataFrame, key: str, value: str, categories: list[str], missing: str = "error") -> DataFrame:
    """A 0/1 column for each category, in the order given. missing: what a null or unknown value means, "error",
    "drop" (the row goes) or "keep" (the column __missing__)."""
    known = F.coalesce(F.col(value).isin(categories), F.lit(False))
    columns = [F.coalesce((F.col(value) == c).cast("int"), F.lit(0)).alias(c) for c in categories]
    if missing == "drop":
        return rows.where(known).select(key, *columns)
    if missing == "keep":
        return rows.select(key, *columns, (~known).cast("int").alias("__missing__"))
    checked = F.when(known, F.col(key)).otherwise(F.raise_error(F.lit(f"{value} has a missing or unknown category")))
    return rows.select(checked.alias(key), *columns)


def distinct_list(rows: DataFrame, keys: list[str], value: str, separator: str = " | ") -> DataFrame:
    """The sorted distinct values of each key, joined, and how many there are; nulls and blanks are left out."""
    kept = rows.where(F.col(value).isNotNull() & (F.trim(value) != "")).select(*keys, value).distinct()
    return kept.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(value)), separator).alias("members"), F.count("*").alias("n"))


def aligned_union(parts: dict[str, DataFrame], label: str = "part") -> DataFrame:
    """All rows of the parts under the union of their columns; what a part doesn't have is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(n)) for n, df in parts.items()])


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the stated order, by one aggregation: nothing is sorted."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in [*order, *rest]))


def shared_members(sets: list[DataFrame], key: str) -> DataFrame:
    """The members that all sets have; each set shrinks to its distinct members first."""
    return reduce(lambda a, b: a.join(b, key, "left_semi"), [s.select(key).where(F.col(key).isNotNull()).distinct() for s in sets])


def cover(inventory: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """For each key of the inventory or of a part: whether the inventory lists it, how many parts have it, and status
    ok (exactly one), missing (none), repeated (several) or unlisted."""
    claimed = reduce(DataFrame.unionAll, [df.select(key).distinct() for df in parts.values()]).groupBy(key).agg(F.count("*").alias("claims"))
    both = inventory.select(key).distinct().withColumn("listed", F.lit(True)).join(claimed, key, "full_outer")
    listed, claims = F.coalesce("listed", F.lit(False)), F.coalesce("claims", F.lit(0)).cast("long")
    status = F.when(~listed, "unlisted").when(claims == 0, "missing").when(claims == 1, "ok").otherwise("repeated")
    return both.select(key, listed.alias("listed"), claims.alias("claims"), status.alias("status"))


def repeated_ids(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Rows of each group beyond the first of their id."""
    return rows.groupBy(group).agg(F.count(key).alias("n"), F.countDistinct(key).alias("ids")).withColumn("repeated", F.col("n") - F.col("ids"))


def canonical_json(columns: dict[str, str]) -> Column:
    """A JSON object with sorted keys and no blanks, from column names by key; nulls are written as null."""

    def cell(name: str) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(F.get_json_object(F.to_json(F.struct(F.col(columns[name]).alias("v"))), "$.v"), F.lit("null")))

    return F.concat(F.lit("{"), F.concat_ws(",", *(cell(k) for k in sorted(columns))), F.lit("}"))


def tree_digest(files: DataFrame, group: str, path: str, digest: str) -> DataFrame:
    """SHA-256 over the sorted paths of each group, each followed by NUL, the file's digest and a line feed. A group is
    one tree's listing, not its files' bytes."""
    line = F.concat(F.col(path), F.lit("\x00"), F.col(digest), F.lit("\n"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l"))))
    return files.groupBy(group).agg(listed.alias("f")).select(group, F.sha2(F.array_join(F.col("f.l"), "").cast("binary"), 256).alias("tree"), F.size("f").cast("long").alias("files"))


def audit(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each check: how many rows were looked at, how many fail it (null fails), PASS or FAIL. One pass."""
    counted = rows.agg(F.count("*").alias("n"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    pairs = [F.struct(F.lit(k).alias("check"), F.col("n").alias("rows"), F.col(k).alias("failed")) for k in checks]
    return counted.select(F.inline(F.array(*pairs))).withColumn("status", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def compared(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """For each shared column of two tables with one row a key: values on both sides, on one only, the largest difference."""
    both = longer(left, [key], columns, value="a").join(longer(right, [key], columns, value="b"), [key, "name"])
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("name").agg(
        F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("largest")
    )


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def _spending(s, d):
    sums = table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return wider(sums, ["o_custkey"], "o_orderstatus", "total", ["F", "O", "P"], "status_")


def _union(s, d):
    customers = table(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return aligned_union({"customer": customers, "supplier": suppliers})


def _shared(s, d):
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderpriority")
    return shared_members([orders.where(F.col("o_orderpriority") == p) for p in PRIORITIES], "custkey")


def _cover(s, d):
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus")
    inventory = table(s, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("custkey"))
    return cover(inventory, {x: orders.where(F.col("o_orderstatus") == x) for x in ("F", "P")}, "custkey")


def _digest(s, d):
    fields = {"segment": "c_mktsegment", "nation": "c_nationkey", "id": "c_custkey"}
    return table(s, d, "customer").select("c_custkey", F.sha2(canonical_json(fields).cast("binary"), 256).alias("digest"))


def _tree(s, d):
    files = table(s, d, "part").select("p_brand", F.concat_ws("/", "p_type", F.col("p_partkey").cast("string")).alias("path"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha"))
    return tree_digest(files, "p_brand", "path", "sha")


def _audit(s, d):
    return audit(table(s, d, "lineitem"), {"quantity is positive": F.col("l_quantity") > 0, "tax is below 8 percent": F.col("l_tax") < 0.08, "flag is known": F.col("l_returnflag").isin("A", "N", "R")})


def _compared(s, d):
    sides = [table(s, d, "orders").where(F.col("o_orderstatus") == x).groupBy("o_custkey").agg(F.round(F.max("o_totalprice"), 2).alias("most"), F.when(F.count("*") > 3, F.round(F.min("o_totalprice"), 2)).alias("least")) for x in ("F", "O")]
    return compared(*sides, "o_custkey", ["most", "least"])


QUERIES = {
    "pivot_wider": _spending,
    "pivot_longer": lambda s, d: longer(table(s, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"]),
    "one_hot": lambda s, d: one_hot(table(s, d, "customer"), "c_custkey", "c_mktsegment", SEGMENTS, "keep"),
    "distinct_list": lambda s, d: distinct_list(table(s, d, "part"), ["p_brand"], "p_type"),
    "aligned_union": _union,
    "first_of_each": lambda s, d: first_of_each(table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"]),
    "shared_members": _shared,
    "disjoint_cover": _cover,
    "repeated_ids": lambda s, d: repeated_ids(table(s, d, "lineitem"), "l_suppkey", "l_partkey"),
    "canonical_digest": _digest,
    "tree_digest": _tree,
    "audit_rows": _audit,
    "sheet_comparison": _compared,
}
SQL = {
    "pivot_wider": """
SELECT o_custkey, max(total) FILTER (WHERE o_orderstatus = 'F') AS "status_F", max(total) FILTER (WHERE o_orderstatus = 'O') AS "status_O",
  max(total) FILTER (WHERE o_orderstatus = 'P') AS "status_P"
FROM (SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2) GROUP BY o_custkey
""",
    "pivot_longer": """
SELECT p_partkey, 'p_size' AS name, p_size::DOUBLE AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part
""",
    "one_hot": """
SELECT c_custkey, coalesce((c_mktsegment = 'AUTOMOBILE')::INT, 0) AS "AUTOMOBILE", coalesce((c_mktsegment = 'BUILDING')::INT, 0) AS "BUILDING",
  coalesce((c_mktsegment = 'FURNITURE')::INT, 0) AS "FURNITURE", coalesce((c_mktsegment = 'HOUSEHOLD')::INT, 0) AS "HOUSEHOLD",
  1 - coalesce((c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD'))::INT, 0) AS "__missing__"
FROM customer
""",
    "distinct_list": "SELECT p_brand, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS members, count(DISTINCT p_type) AS n FROM part WHERE trim(p_type) <> '' GROUP BY p_brand",
    "aligned_union": """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS part, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, 'supplier', s_acctbal FROM supplier
""",
    "first_of_each": """
SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1
""",
    "shared_members": " INTERSECT ".join(f"SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '{p}'" for p in PRIORITIES),
    "disjoint_cover": """
WITH i AS (SELECT c_custkey AS custkey FROM customer WHERE c_custkey % 10 <> 3),
c AS (SELECT o_custkey AS custkey, count(DISTINCT o_orderstatus) AS claims FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1)
SELECT coalesce(i.custkey, c.custkey) AS custkey, i.custkey IS NOT NULL AS listed, coalesce(claims, 0) AS claims,
  CASE WHEN i.custkey IS NULL THEN 'unlisted' WHEN claims IS NULL THEN 'missing' WHEN claims = 1 THEN 'ok' ELSE 'repeated' END AS status
FROM i FULL JOIN c ON i.custkey = c.custkey
""",
    "repeated_ids": "SELECT l_suppkey, count(l_partkey) AS n, count(DISTINCT l_partkey) AS ids, count(l_partkey) - count(DISTINCT l_partkey) AS repeated FROM lineitem GROUP BY 1",
    "canonical_digest": """
SELECT c_custkey, sha256('{"id":' || c_custkey || ',"nation":' || c_nationkey || ',"segment":' || c_mktsegment || '}') AS digest FROM customer
""",
    "tree_digest": """
SELECT p_brand, sha256(string_agg(path || chr(0) || sha256(p_name) || chr(10), '' ORDER BY path)) AS tree, count(*) AS files
FROM (SELECT p_brand, p_type || '/' || p_partkey AS path, p_name FROM part) GROUP BY p_brand
""",
    "audit_rows": """
SELECT "check", (SELECT count(*) FROM lineitem) AS rows, failed, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'quantity is positive' AS "check", count(*) FILTER (WHERE NOT coalesce(l_quantity > 0, false)) AS failed FROM lineitem
  UNION ALL SELECT 'tax is below 8 percent', count(*) FILTER (WHERE NOT coalesce(l_tax < 0.08, false)) FROM lineitem
  UNION ALL SELECT 'flag is known', count(*) FILTER (WHERE NOT coalesce(l_returnflag IN ('A', 'N', 'R'), false)) FROM lineitem)
""",
    "sheet_comparison": """
WITH t AS (SELECT o_custkey, o_orderstatus AS s, round(max(o_totalprice), 2) AS most, CASE WHEN count(*) > 3 THEN round(min(o_totalprice), 2) END AS least FROM orders GROUP BY 1, 2),
u AS (SELECT o_custkey, s, 'most' AS name, most AS v FROM t UNION ALL SELECT o_custkey, s, 'least', least FROM t)
SELECT a.name, count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NOT NULL) AS n_both, count(*) FILTER (WHERE a.v IS NOT NULL AND b.v IS NULL) AS a_only,
  count(*) FILTER (WHERE a.v IS NULL AND b.v IS NOT NULL) AS b_only, round(max(abs(a.v - b.v)), 6) AS largest
FROM u a JOIN u b ON a.o_custkey = b.o_custkey AND a.name = b.name AND a.s = 'F' AND b.s = 'O' GROUP BY a.name
""",
}
