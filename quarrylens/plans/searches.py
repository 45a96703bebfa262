"""Search through the gram index and over several scopes under one limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrylens.operators import scopes
from quarrylens.operators.gram_index import GramIndex
from quarrylens.plans.base import query
from quarrylens.plans.texts import hit_sql


@query("search_pruned", hit_sql("instr(lower(line), 'license')", "7"))
def search_pruned(t):
    return GramIndex.of(t.documents).search("license", limit=None)


@query("search_indexed_limited", f'SELECT * FROM ({hit_sql("instr(line, chr(84) || chr(104) || chr(101) || chr(32))", "4")}) ORDER BY doc_id, line_no LIMIT 500')
def search_indexed_limited(t):
    """A frequent phrase: only the first parts of the index are opened."""
    return GramIndex.of(t.documents, part_chars=1 << 20).search("The ", case=True, limit=500)


@query("index_counters", "SELECT count(*) FILTER (text IS NOT NULL AND hit) AS at_least, count(*) FILTER (text IS NULL) AS missing, count(*) AS total FROM (SELECT text, contains(lower(text), 'license') AS hit FROM documents)")
def index_counters(t):
    """The index lets through at least the texts that match; what it lets through beyond them is no error, so hits among them are counted."""
    index = GramIndex.of(t.documents)
    seen = index.counters("license")
    hits = index.search("license", limit=None).select("doc_id").distinct().count()
    if not hits <= seen["scanned"]:
        raise AssertionError("the index left out a text that matches")
    return t.spark.createDataFrame([(hits, seen["missing"], sum(seen.values()))], "at_least long, missing long, total long")


def fixture(t) -> dict[str, DataFrame]:
    """Pages as resources, parts and nations as symbols, suppliers as annotated methods, documents as sources of classes with inner ones."""
    brand = F.concat(F.lit("shop/B"), F.substring("p_brand", 7, 9))
    parts = t.part.select(F.concat(F.lit("L"), brand, F.lit(";->f"), "p_partkey", F.lit(":I")).alias("id"), F.col("p_name").alias("name"), brand.alias("owner"), F.lit("field").alias("kind"), F.lit("").alias("descriptor"))
    nations = t.nation.select(F.concat(F.lit("Lred/N"), "n_nationkey", F.lit(";")).alias("id"), F.concat(F.lit("N"), "n_nationkey").alias("name"), F.concat(F.lit("red/N"), "n_nationkey").alias("owner"), F.lit("class").alias("kind"), F.lit("").alias("descriptor"))
    name = F.concat(F.lit("docs/D"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    outer = t.documents.select(name.alias("name"), "doc_id")
    inner = outer.where("doc_id % 3 = 0").select(F.concat("name", F.lit("$1")).alias("name"), "doc_id")
    third = outer.where("doc_id % 6 = 0").select(F.concat("name", F.lit("$1$2")).alias("name"), "doc_id")
    texts = t.documents.select(name.alias("name"), "text")
    return {
        "resources": t.pages.select(F.format_string("res/%09d.html", "page_id").alias("name"), F.col("html").alias("text")),
        "symbols": parts.unionByName(nations),
        "aliases": parts.where("length(name) % 5 = 0").select("id", F.concat(F.lit("kept_"), F.length("name")).alias("alias")),
        "notes": t.supplier.select(F.concat(F.lit("shop/S"), "s_nationkey").alias("owner"), F.concat(F.lit("m"), "s_suppkey").alias("id"), F.concat(F.lit("@Override // required by "), "s_name").alias("text")),
        "classes": outer.unionByName(inner).unionByName(third).select("name"),
        "sources": texts.unionByName(texts.select(F.concat("name", F.lit("$1")).alias("name"), "text")),
        "second": t.pages.select(F.format_string("docs/D%09d", "page_id").alias("name"), F.col("html").alias("text")),
    }


def line_hits(source: str, number: int, scope: str, kind: str, q: str) -> str:
    """SQL for matching lines of (name, text)."""
    cut = f"SELECT name, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT name, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT name, text, string_split(text, chr(10)) AS l FROM ({source}) WHERE text IS NOT NULL))"
    at, node = f"instr(lower(line), '{q}')", "replace(name, '/', '.')" if kind == "code" else "name"
    return f"""SELECT {number} AS scope_no, '{scope}' AS scope, name AS owner, {node} AS node, '{kind}' AS kind, CAST(line_no AS INTEGER) AS line_no, CAST({at} AS INTEGER) AS "column", {len(q)} AS length, CAST(occ AS INTEGER) AS line_occurrence,
    substr(line, CAST(greatest(1, {at} - 200) AS BIGINT), 1200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY name, line ORDER BY line_no) - 1 AS occ FROM ({cut})) WHERE {at} > 0"""


def name_hits(rows: str, number: int, scope: str, q: str) -> str:
    """SQL for matching names of (owner, node, kind, shown, text)."""
    return f"""SELECT {number} AS scope_no, '{scope}' AS scope, owner, node, kind, 0 AS line_no, CAST(instr(lower(shown), '{q}') AS INTEGER) AS "column", {len(q)} AS length, 0 AS line_occurrence, text FROM ({rows}) WHERE contains(lower(shown), '{q}')"""


def scopes_sql(q: str, limit: int, second: bool) -> str:
    shown = "CASE WHEN length(p_name) % 5 = 0 THEN 'kept_' || length(p_name) ELSE p_name END"
    docs = "SELECT 'docs/D' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, text FROM documents"
    parts = [
        line_hits("SELECT printf('res/%09d.html', page_id) AS name, html AS text FROM pages", 0, "resources", "resource", q),
        name_hits(f"SELECT 'shop/B' || substr(p_brand, 7) AS owner, 'shop.B' || substr(p_brand, 7) || '.' || {shown} AS node, 'field' AS kind, {shown} AS shown, {shown} AS text FROM part UNION ALL SELECT 'red/N' || n_nationkey, 'red.N' || n_nationkey, 'class', 'red.N' || n_nationkey, 'red.N' || n_nationkey FROM nation", 1, "symbols", q),
        name_hits("SELECT 'shop/S' || s_nationkey AS owner, 'm' || s_suppkey AS node, 'code' AS kind, '@Override // required by ' || s_name AS shown, '@Override // required by ' || s_name AS text FROM supplier", 2, "annotations", q),
        line_hits(docs, 3, "code", "code", q),
    ]
    if second:
        classes = f"SELECT name FROM ({docs}) UNION ALL SELECT 'docs/D' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '$1' FROM documents WHERE doc_id % 3 = 0"
        parts.append(line_hits(f"SELECT printf('docs/D%09d', page_id) AS name, html AS text FROM pages SEMI JOIN ({classes}) c ON c.name = printf('docs/D%09d', page_id)", 4, "assembly", "code", q))
    return f"""SELECT * FROM ({' UNION ALL '.join(parts)}) ORDER BY scope_no, owner, node, line_no, "column", text LIMIT {limit}"""


def over_all(t, text: str, limit: int, second: bool) -> scopes.Found:
    f, q = fixture(t), scopes.Query(text)
    order = [scopes.resource_scope(f["resources"], q), scopes.symbol_scope(f["symbols"], f["aliases"], q, {"class", "method", "field"}), scopes.annotation_scope(f["notes"], q), scopes.source_scope(f["classes"], f["sources"], q)]
    again = [scopes.source_scope(f["classes"], f["second"], q, name="assembly", inner=True)] if second else None
    return scopes.search_scopes(t.spark, order, q, limit, again)


@query("search_scopes", scopes_sql("red", 2000, True))
def search_scopes(t):
    """The limit is full before the second source, which stays unread."""
    return over_all(t, "red", 2000, True).hits


@query("search_second_source", scopes_sql("license", 2000, True))
def search_second_source(t):
    """Few hits in the first scopes: the second source is searched with what is left of the limit."""
    return over_all(t, "license", 2000, True).hits
