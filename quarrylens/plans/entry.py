"""Queries through the engine's entry and over the smaller column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens import report
from quarrylens.engine import Engine, found_by_name
from quarrylens.functions import names, strings, text
from quarrylens.operators import graph
from quarrylens.plans.base import EDGES, query, supply_edges
from quarrylens.plans.graphs import hierarchy

BY_BRAND = "SELECT p_brand, count(*) AS parts, max(p_retailprice) AS dearest FROM part GROUP BY p_brand"


@query("engine_sql", BY_BRAND)
def engine_sql(t):
    return Engine(t.spark, {"part": t.part}).query(BY_BRAND + ";")


@query("native_method_find", "SELECT p_partkey, p_name, CASE WHEN starts_with(p_name, 'g') THEN 2 ELSE 1 END AS rank FROM part WHERE contains(p_name, 'g')")
def native_method_find(t):
    return found_by_name(t.part.select("p_partkey", "p_name"), "p_name", "g")


@query("valid_identifiers", "SELECT p_name AS name, regexp_full_match(p_name, '[A-Za-z_$][A-Za-z0-9_$]*') AS valid, count(*) AS n FROM part GROUP BY p_name")
def valid_identifiers(t):
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("valid", names.valid_identifier(F.col("name")))


WRAPPED = "CASE WHEN ({0}) & 4294967295 >= 2147483648 THEN (({0}) & 4294967295) - 4294967296 ELSE ({0}) & 4294967295 END"
A, B = WRAPPED.format("l_orderkey * 40503 - 1000000"), "(l_partkey * 977 - 20000)"


@query("folded_ints", f"SELECT l_orderkey, l_linenumber, {WRAPPED.format('a + b')} AS plus, {WRAPPED.format('a * b')} AS times, CASE WHEN b <> 0 THEN a // b END AS over, CASE WHEN b <> 0 THEN a % b END AS rest, {WRAPPED.format('a * 256')} AS shifted FROM (SELECT *, {A} AS a, {B} AS b FROM lineitem)")
def folded_ints(t):
    a, b = names.wrap32(F.col("l_orderkey") * 40503 - 1000000), F.col("l_partkey") * 977 - 20000
    rows = t.lineitem
    fold = lambda op, y: names.fold_int(op, a, y)
    return rows.select("l_orderkey", "l_linenumber", fold("+", b).alias("plus"), fold("*", b).alias("times"), fold("/", b).alias("over"), fold("%", b).alias("rest"), fold("<<", F.lit(8).cast("long")).alias("shifted"))


@query("hex_dump", "SELECT p_partkey, o AS off, hex(substr(p_name, o + 1, 16)) AS hex, substr(p_name, o + 1, 16) AS text FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name), 16)) AS o FROM part)")
def hex_dump(t):
    rows = t.part.select("p_partkey", F.explode(names.hex_rows(F.encode("p_name", "UTF-8"))).alias("r"))
    return rows.select("p_partkey", F.col("r.off").cast("long").alias("off"), "r.hex", "r.text")


@query("setops_intersect_all", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def setops_intersect_all(t):
    part = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return part("R").intersectAll(part("A"))


@query("like_wildcards", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
def like_wildcards(t):
    return t.part.where(F.col("p_name").like("%a_e%")).select("p_partkey", "p_name")


@query(
    "analysis_report",
    f"""WITH x AS (SELECT p_brand AS so, p_name AS name FROM part), c(place, label, n) AS (
    SELECT 0, 'Java methods', (SELECT count(*) FROM customer) UNION ALL SELECT 1, 'Call edges', (SELECT count(*) FROM ({EDGES})) UNION ALL SELECT 2, 'Native libraries', (SELECT count(DISTINCT so) FROM x)
    UNION ALL SELECT 3, 'Native exports', (SELECT count(*) FROM x) UNION ALL SELECT 4, 'Native references', (SELECT count(*) FROM lineitem) UNION ALL SELECT 5, 'Native imports', (SELECT count(*) FROM supplier) UNION ALL SELECT 6, 'Native entries', (SELECT count(*) FROM orders))
    SELECT 'overview' AS section, place, label, CAST(n AS VARCHAR) AS value FROM c
    UNION ALL SELECT 'node types', row_number() OVER (ORDER BY k) - 1, CAST(k AS VARCHAR), CAST(n AS VARCHAR) FROM (SELECT c_nationkey % 2 AS k, count(*) AS n FROM customer GROUP BY 1)
    UNION ALL SELECT 'libraries', row_number() OVER (ORDER BY n DESC, so) - 1, so, CAST(n AS VARCHAR) FROM (SELECT so, count(*) AS n FROM x GROUP BY so) QUALIFY row_number() OVER (ORDER BY n DESC, so) <= 10
    UNION ALL SELECT 'exports', row_number() OVER (ORDER BY so, name) - 1, so, name FROM x QUALIFY row_number() OVER (ORDER BY so, name) <= 200
    UNION ALL SELECT 'urls', row_number() OVER (ORDER BY url) - 1, url, '' FROM (SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '^(https?|ftps?)://')) QUALIFY row_number() OVER (ORDER BY url) <= 50""",
)
def analysis_report(t):
    nodes, exports = t.customer.select((F.col("c_nationkey") % 2).alias("node_type")), t.part.select(F.col("p_brand").alias("so_name"), F.col("p_name").alias("name"))
    urls = t.pages.select(F.col("url").alias("str"), strings.is_url(F.col("url")).alias("is_url"))
    return report.sections(nodes, supply_edges(t), exports, t.lineitem, t.supplier, t.orders, urls)


@query("csv_bytes", "SELECT page_id, md5(regexp_replace(html, '[\\x00-\\x1f]', ' ', 'g')) AS clean FROM pages")
def csv_bytes(t):
    return t.pages.select("page_id", F.md5(text.csv_bytes(F.encode("html", "UTF-8"))).alias("clean"))


@query("encodings", "SELECT p_partkey, base64(encode(p_name)) AS b64, lower(hex(encode(p_name))) AS hex, p_name AS text FROM part")
def encodings(t):
    data = F.encode("p_name", "UTF-8")
    return t.part.select("p_partkey", names.encoded(data, "base64").alias("b64"), names.encoded(data, "hex").alias("hex"), names.encoded(data, "text").alias("text"))


@query("override_notes", "SELECT 'c/' || c_custkey AS owner, 'c/' || c_custkey || '->m()' AS id, 1 AS flags, '@Override // ' || CASE WHEN n_nationkey % 2 = 0 THEN 'n.' || n_nationkey ELSE 'r.' || n_regionkey END || '.m' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n/' || n_nationkey, 'n/' || n_nationkey || '->m()', 1, '@Override // r.' || n_regionkey || '.m' FROM nation WHERE n_nationkey % 2 = 0")
def override_notes(t):
    """Nations with an odd key declare the method as private, which takes no part."""
    own = t.customer.select(F.concat(F.lit("c/"), "c_custkey").alias("owner"), F.lit(1).alias("flags"))
    own = own.union(t.nation.select(F.concat(F.lit("n/"), "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(2))).union(t.region.select(F.concat(F.lit("r/"), "r_regionkey"), F.lit(1)))
    methods = own.select(F.concat("owner", F.lit("->m()")).alias("id"), "owner", F.lit("m()").alias("suffix"), F.lit("m").alias("name"), "flags")
    return graph.override_notes(methods, graph.overrides(methods.select("owner", "suffix", "flags"), graph.closure(hierarchy(t))))
