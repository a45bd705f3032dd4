"""Linking tables by exact identifiers: joins that report what didn't match, and never guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.text import as_bool, capped_ratio, first_rule, normalise, simplify, slug
from lamella.plans import table
from lamella.plans.prefix import kept


def grain_audit(rows: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Rows and distinct units of each key; a key with several rows is ambiguous and stays unpooled."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct(unit).alias("n_units")).withColumn("status", F.when(F.col("n_rows") == 1, "single_row").otherwise("ambiguous"))


def unmatched_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The distinct keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").select(key, F.lit(side).alias("only_in"))
    return only(a, b, "left").union(only(b, a, "right"))


def membership_flags(rows: DataFrame, key: str, members: dict[str, DataFrame]) -> DataFrame:
    """rows with a flag for each set (a table with the same key) that says whether the key is in it."""
    for name, own in members.items():
        rows = rows.join(own.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def simultaneous_coverage(rows: DataFrame, unit: str, part: str) -> DataFrame:
    """Units that have every part (relational division)."""
    pairs = rows.select(unit, part).distinct()
    needed = pairs.select(F.countDistinct(part).alias("needed"))
    return pairs.groupBy(unit).agg(F.count("*").alias("n_parts")).crossJoin(needed).where("n_parts = needed").select(unit, "n_parts")


def complete_grid(rows: DataFrame, first: str, second: str, value: str, fill: float) -> DataFrame:
    """Every pair of the values of two dimensions, with fill where rows have none. Both dimensions are small by kind."""
    grid = rows.select(first).distinct().crossJoin(rows.select(second).distinct())
    sums = rows.groupBy(first, second).agg(F.sum(value).alias(value))
    return grid.join(sums, [first, second], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def resolve_exact(requests: DataFrame, items: DataFrame, request: str, symbol: str, identifier: str) -> DataFrame:
    """Items whose symbol or identifier equals the request; two equi-joins, so nothing is compared pairwise."""
    by = lambda c, flag: requests.join(items, requests[request] == items[c]).select(request, symbol, identifier, F.lit(flag).alias("by"))
    both = by(symbol, "symbol").union(by(identifier, "id"))
    kinds = both.groupBy(request, symbol, identifier).agg(F.sort_array(F.collect_set("by")).alias("k"))
    return kinds.select(request, symbol, identifier, F.when(F.size("k") == 2, "symbol_and_id").when(F.col("k")[0] == "id", "gene_id").otherwise("symbol").alias("match_type"))


def replicate_pairs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """All unordered pairs of a key's rows, first by order, with the difference of their values."""
    a = rows.select(*keys, F.col(order).alias("first"), F.col(value).alias("a"))
    b = rows.select(*keys, F.col(order).alias("second"), F.col(value).alias("b"))
    return a.join(b, keys).where("first < second").select(*keys, "first", "second", F.round(F.col("b") - F.col("a"), 6).alias("difference"))


def band_pairs(rows: DataFrame, key: str, item: str, value: str, width: float) -> DataFrame:
    """Pairs of one key whose values lie within width: an equi-join on the key and the value's band and its next."""
    band = F.floor(F.col(value) / width)
    a = rows.select(key, F.col(item).alias("a"), F.col(value).alias("va"), band.alias("band"))
    b = rows.select(key, F.col(item).alias("b"), F.col(value).alias("vb"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    return a.join(b, [key, "band"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("va") - F.col("vb")) <= width)).select(key, "a", "b")


def value_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows with a value, distinct values, share that looks like a long number."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), normalise(F.col(c)).alias("value")) for c in columns))).alias("x")).select("x.*")
    share = F.round(F.avg(F.when(F.col("value").rlike("^[0-9]{4,}$"), 1.0).otherwise(0.0)), 6)
    return long.groupBy("column").agg(F.count("value").alias("n_present"), F.countDistinct("value").alias("n_distinct"), share.alias("long_numeric"))


#: The order decides.
ROLES = [("manifest", "manifest"), (r"\.html?($|[?#])", "page"), (r"\?", "query"), ("/en/", "english"), ("#", "anchor")]


def role_of(path: Column) -> Column:
    return first_rule(path, ROLES, "other")


def q_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", simplify(F.col("p_type")).alias("simple"), slug(F.col("p_name"), "field").alias("slug"), normalise(F.col("p_brand")).alias("brand"), as_bool(F.col("p_size") % 2).alias("odd"), F.round(capped_ratio(F.col("p_retailprice"), 1500.0), 6).alias("ratio"))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("gene_id")).distinct()
    asked = items.select(F.col("symbol").alias("request")).union(items.select(F.col("gene_id").alias("request"))).union(items.select(F.lower("symbol").alias("request"))).distinct()
    return asked, items


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


QUERIES = {
    "grain_audit": lambda s, d: grain_audit(_lines(s, d), ["l_orderkey", "l_returnflag"], "l_partkey"),
    "unmatched_audit": lambda s, d: unmatched_audit(table(s, d, "customer").select(F.col("c_custkey").alias("key")), _orders(s, d).select((F.col("o_custkey") + 3).alias("key")), "key"),
    "membership_flags": lambda s, d: membership_flags(table(s, d, "customer").select("c_custkey"), "c_custkey", {"ordered": _orders(s, d).select(F.col("o_custkey").alias("c_custkey")), "urgent": _orders(s, d).where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))}),
    "simultaneous_coverage": lambda s, d: simultaneous_coverage(_orders(s, d), "o_custkey", "o_orderpriority"),
    "grid_completion": lambda s, d: complete_grid(_lines(s, d).select("l_returnflag", (F.col("l_suppkey") % 50).alias("site"), "l_quantity"), "l_returnflag", "site", "l_quantity", 0.0),
    "gene_resolution": lambda s, d: resolve_exact(*_items(s, d), "request", "symbol", "gene_id"),
    "replicate_pairs": lambda s, d: replicate_pairs(_lines(s, d), ["l_orderkey", "l_returnflag"], "l_linenumber", "l_quantity"),
    "band_self_join": lambda s, d: band_pairs(_orders(s, d), "o_custkey", "o_orderkey", "o_totalprice", 5000.0),
    "value_profile": lambda s, d: value_profile(table(s, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"]),
    "text_rules": q_text_rules,
    "file_role": lambda s, d: table(s, d, "pages").select("page_id", role_of(F.col("url")).alias("role")),
    "full_outer_counts": lambda s, d: table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers")).join(table(s, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")), "nation", "full").select("nation", "customers", "suppliers"),
    "ontology_closure": lambda s, d: ontology(table(s, d, "region"), table(s, d, "nation"), table(s, d, "supplier")),
}


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a forest given as (node, parent): rounds of joins until none adds a row. A node given
    twice fails, and so does a cycle; a parent that is no node itself is a root."""
    if twice := edges.groupBy("node").count().where("count > 1").first():
        raise ValueError(f"node {twice['node']!r} is given twice")
    up = kept(edges.select(F.col("node").alias("ancestor"), F.col("parent").alias("next")).where("next IS NOT NULL"))
    step = kept(edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    found = step
    while not step.isEmpty():
        if loop := step.where("node = ancestor").first():
            raise ValueError(f"node {loop['node']!r} is its own ancestor")
        step = kept(step.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + 1).alias("depth")))
        found = found.union(step)
    return found


def ontology(regions: DataFrame, nations: DataFrame, suppliers: DataFrame) -> DataFrame:
    edges = nations.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    edges = edges.union(suppliers.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    return closure(edges.union(regions.select(F.concat(F.lit("r"), "r_regionkey"), F.lit(None).cast("string"))))


SQL = {
    "grain_audit": "SELECT l_orderkey, l_returnflag, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_units, CASE WHEN count(*) = 1 THEN 'single_row' ELSE 'ambiguous' END AS status FROM lineitem GROUP BY 1, 2",
    "unmatched_audit": "WITH a AS (SELECT DISTINCT c_custkey AS key FROM customer), b AS (SELECT DISTINCT o_custkey + 3 AS key FROM orders) SELECT key, 'left' AS only_in FROM (SELECT key FROM a EXCEPT SELECT key FROM b) UNION ALL SELECT key, 'right' FROM (SELECT key FROM b EXCEPT SELECT key FROM a)",
    "membership_flags": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ordered, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AS urgent FROM customer",
    "simultaneous_coverage": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
    "grid_completion": "WITH r AS (SELECT l_returnflag, l_suppkey % 50 AS site, l_quantity FROM lineitem), g AS (SELECT * FROM (SELECT DISTINCT l_returnflag FROM r) CROSS JOIN (SELECT DISTINCT site FROM r)) SELECT l_returnflag, site, coalesce(sum(l_quantity), 0.0) AS l_quantity FROM g LEFT JOIN r USING (l_returnflag, site) GROUP BY 1, 2",
    "gene_resolution": "WITH i AS (SELECT DISTINCT p_brand AS symbol, p_type AS gene_id FROM part), q AS (SELECT symbol AS request FROM i UNION SELECT gene_id FROM i UNION SELECT lower(symbol) FROM i) SELECT request, symbol, gene_id, CASE WHEN request = symbol AND request = gene_id THEN 'symbol_and_id' WHEN request = gene_id THEN 'gene_id' ELSE 'symbol' END AS match_type FROM q JOIN i ON request = symbol OR request = gene_id",
    "replicate_pairs": "SELECT a.l_orderkey, a.l_returnflag, a.l_linenumber AS first, b.l_linenumber AS second, round(b.l_quantity - a.l_quantity, 6) AS difference FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber",
    "band_self_join": "SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) <= 5000",
    "value_profile": "SELECT \"column\", count(v) AS n_present, count(DISTINCT v) AS n_distinct, round(avg(CASE WHEN regexp_matches(v, '^[0-9]{4,}$') THEN 1.0 ELSE 0.0 END), 6) AS long_numeric FROM (SELECT \"column\", CASE WHEN lower(trim(x)) NOT IN ('nan', 'none', 'null', '') THEN trim(x) END AS v FROM (SELECT 'c_custkey' AS \"column\", CAST(c_custkey AS VARCHAR) AS x FROM customer UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)) GROUP BY 1",
    "text_rules": "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g') AS simple, coalesce(nullif(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'field') AS slug, CASE WHEN lower(trim(p_brand)) NOT IN ('nan', 'none', 'null', '') THEN trim(p_brand) END AS brand, p_size % 2 = 1 AS odd, round(greatest(0.0, least(p_retailprice / 1500.0, 1.0)), 6) AS ratio FROM part",
    "file_role": "SELECT page_id, CASE WHEN lower(url) LIKE '%manifest%' THEN 'manifest' WHEN regexp_matches(lower(url), '\\.html?($|[?#])') THEN 'page' WHEN lower(url) LIKE '%?%' THEN 'query' WHEN lower(url) LIKE '%/en/%' THEN 'english' WHEN lower(url) LIKE '%#%' THEN 'anchor' ELSE 'other' END AS role FROM pages",
    "full_outer_counts": "SELECT coalesce(a.n, b.n) AS nation, customers, suppliers FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.n = b.n",
    "ontology_closure": "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), t(node, ancestor, depth) AS (SELECT node, parent, 1 FROM e UNION ALL SELECT t.node, e.parent, depth + 1 FROM t JOIN e ON t.ancestor = e.node) SELECT * FROM t",
}
