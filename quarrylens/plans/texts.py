"""String, name, line and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.functions import names, strings, text
from quarrylens.operators import search
from quarrylens.plans.base import query

OCTET = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
FLAGS = {
    "is_url": "regexp_matches(s, '^(https?|ftps?|rtsp|mms|wss?|content|file|socket)://')",
    "is_uuid": "regexp_full_match(s, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')",
    "is_so_name": "regexp_matches(s, '(^|/)[A-Za-z0-9_+.\\-]+\\.so\\z')",
    "is_ipv4": f"regexp_full_match(s, '({OCTET}\\.){{3}}{OCTET}')",
    "is_internal_class_desc": "contains(s, '$')",
    "is_enc_dec": "(s IN (" + ", ".join(f"'{a}'" for a in strings.ALGORITHMS) + ") OR regexp_matches(s, '^(AES|DES|DESede|RSA|EC|SM2|SM4|ChaCha20)/'))",
    "is_pem_key": "(regexp_matches(s, 'BEGIN (RSA PUBLIC KEY|PUBLIC KEY|PRIVATE KEY|RSA PRIVATE KEY|EC PRIVATE KEY|ENCRYPTED PRIVATE KEY|CERTIFICATE|OPENSSH PRIVATE KEY)') OR (strlen(s) >= 128 AND regexp_matches(s, '^MII[B-F]')))",
}
FLAG_SQL = ", ".join(f"{v} AS {k}" for k, v in FLAGS.items())


def flagged(df):
    found = strings.flags(F.col("s"))
    return df.select("s", *[found[k].alias(k) for k in FLAGS])


@query("url_flags", f"SELECT s, {FLAG_SQL} FROM (SELECT DISTINCT url AS s FROM pages)")
def url_flags(t):
    return flagged(t.pages.select(F.col("url").alias("s")).distinct())


GATED = ", ".join(f"{v} AND p % 3 <> 0 AS {k}" if k != "is_internal_class_desc" else f"{v} AS {k}" for k, v in FLAGS.items())


@query("gated_flags", f"SELECT p AS page_id, {GATED}, p % 3 = 0 AS is_method_name FROM (SELECT page_id AS p, url AS s FROM pages)")
def gated_flags(t):
    """A third of the literals are marked as names of methods, and not tested for content."""
    found = strings.flags(F.col("url"), F.when(F.col("page_id") % 3 == 0, strings.METHOD_NAME).otherwise(0))
    return t.pages.select("page_id", *[found[k].alias(k) for k in (*FLAGS, "is_method_name")])


@query("token_flags", f"SELECT s, {FLAG_SQL} FROM (SELECT DISTINCT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS s FROM documents) WHERE s <> ''")
def token_flags(t):
    rows = t.documents.select(F.explode(F.split(F.translate("text", "\n", " "), " ")).alias("s")).where("s <> ''").distinct()
    return flagged(rows)


@query("package_tree", "SELECT regexp_extract(regexp_extract(url, '^[a-z]+://(.*)$', 1), '^(.*)/[^/]*$', 1) AS package, count(*) AS n FROM pages GROUP BY 1")
def package_tree(t):
    return t.pages.groupBy(names.package_of(F.regexp_extract("url", "^[a-z]+://(.*)$", 1)).alias("package")).agg(F.count(F.lit(1)).alias("n"))


@query("package_filter", "SELECT p_partkey FROM part WHERE starts_with(replace(p_name, ' ', '/'), 'small/')")
def package_filter(t):
    return t.part.where(names.in_package(F.translate("p_name", " ", "/"), "small.")).select("p_partkey")


@query("package_exclusion", "SELECT p_partkey FROM part WHERE NOT (starts_with(replace(p_type, ' ', '/'), 'STANDARD/') OR starts_with(replace(p_type, ' ', '/'), 'SMALL/PLATED/') OR replace(p_type, ' ', '/') IN ('STANDARD', 'SMALL/PLATED'))")
def package_exclusion(t):
    return t.part.where(~names.excluded(F.translate("p_type", " ", "/"), "STANDARD;SMALL.PLATED")).select("p_partkey")


@query("hex_address", "SELECT p_partkey, printf('%x', p_partkey) AS hex FROM part")
def hex_address(t):
    return t.part.select("p_partkey", names.hex_address(F.col("p_partkey")).alias("hex"))


@query("parse_address", "SELECT o_orderkey, o_orderkey AS address FROM orders")
def parse_address(t):
    return t.orders.select("o_orderkey", names.address(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("0x"), names.hex_address(F.col("o_orderkey")))).otherwise(F.col("o_orderkey").cast("string"))).alias("address"))


@query("jni_prefix", "SELECT p_partkey, 'Java_' || replace(replace(p_brand, '#', '_'), '.', '_') || '_' AS prefix FROM part")
def jni_prefix(t):
    return t.part.select("p_partkey", names.jni_prefix(F.concat(F.translate("p_brand", "#", "."), F.lit("."), F.translate("p_name", " ./", "___"))).alias("prefix"))


@query("descriptor_types", "SELECT p_partkey, 'int[],com.' || replace(p_brand, '#', '') || '.C' || p_size || ',boolean' AS types FROM part")
def descriptor_types(t):
    d = F.concat(F.lit("([ILcom/"), F.translate("p_brand", "#", ""), F.lit("/C"), "p_size", F.lit(";Z)V"))
    return t.part.select("p_partkey", F.array_join(names.descriptor_types(d), ",").alias("types"))


@query("descriptor_classes", "SELECT p_partkey, 'a/B' || p_size || ',c/D' AS classes FROM part")
def descriptor_classes(t):
    return t.part.select("p_partkey", F.array_join(names.descriptor_classes(F.concat(F.lit("(La/B"), "p_size", F.lit("<Lc/D;>;I)V"))), ",").alias("classes"))


@query("class_kinds", "SELECT o_orderkey, CASE WHEN o_orderkey & 8192 <> 0 THEN 'annotation' WHEN o_orderkey & 16384 <> 0 THEN 'enum' WHEN o_orderkey & 512 <> 0 THEN 'interface' WHEN o_orderkey & 1024 <> 0 THEN 'abstract' ELSE 'class' END AS kind FROM orders")
def class_kinds(t):
    return t.orders.select("o_orderkey", names.class_kind(F.col("o_orderkey")).alias("kind"))


@query("suspicious_names", "SELECT p_partkey, length(p_name) <= 1 OR length(p_name) > 64 OR NOT regexp_full_match(p_name, '[A-Za-z_$][A-Za-z0-9_$]*') OR regexp_full_match(p_name, '[O0oIl1|]{3,}') AS bad FROM part")
def suspicious_names(t):
    return t.part.select("p_partkey", names.suspicious_name(F.col("p_name")).alias("bad"))


@query("path_stem", "SELECT p_partkey, lower(hex(p_brand)) AS stem FROM part")
def path_stem(t):
    return t.part.select("p_partkey", names.path_stem(F.col("p_brand")).alias("stem"))


@query("java_hash", "SELECT p_partkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM (SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_brand, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS h FROM part)")
def java_hash(t):
    return t.part.select("p_partkey", names.java_hash(F.col("p_brand")).alias("h"))


@query("fnv1a", "SELECT p_partkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(p_brand, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) % 4294967296) AS h FROM part")
def fnv1a(t):
    return t.part.select("p_partkey", names.fnv1a(F.col("p_brand")).alias("h"))


@query("trigram_bits", "SELECT p_partkey, CAST(list_sum(list_distinct(list_transform(range(1, length(p_type) - 1), lambda i: (unicode(lower(p_type)[i]) * 63001 + unicode(lower(p_type)[i + 1]) * 251 + unicode(lower(p_type)[i + 2])) % 8192))) AS BIGINT) AS total FROM part")
def trigram_bits(t):
    return t.part.select("p_partkey", F.aggregate(text.gram_bits(F.col("p_type")), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


LINES = "SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) OR text = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


@query("line_explode", f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line FROM ({LINES})")
def line_explode(t):
    return search.explode_lines(t.documents.select("doc_id", "text")).select("doc_id", "line_no", F.md5("line").alias("line"))


def hit_sql(at: str, length: str) -> str:
    return f"""SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST({at} AS INTEGER) AS "column", CAST({length} AS INTEGER) AS length, CAST(occ AS INTEGER) AS line_occurrence,
    substr(line, CAST(greatest(1, {at} - 200) AS BIGINT), 1200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) - 1 AS occ FROM ({LINES})) WHERE {at} > 0"""


@query("search_literal", hit_sql("instr(lower(line), 'license')", "7"))
def search_literal(t):
    return search.search(t.documents, "license", limit=None)


@query("search_case", hit_sql("instr(line, 'The ')", "4"))
def search_case(t):
    return search.search(t.documents, "The ", case=True, limit=None)


@query("search_regex", hit_sql("CASE WHEN regexp_matches(line, '[0-9]+[.][0-9]+') THEN instr(line, regexp_extract(line, '[0-9]+[.][0-9]+')) ELSE 0 END", "length(regexp_extract(line, '[0-9]+[.][0-9]+'))"))
def search_regex(t):
    return search.search(t.documents, "[0-9]+[.][0-9]+", regex=True, limit=None)


@query("search_limited", f'SELECT doc_id, line_no FROM ({hit_sql("instr(lower(line), chr(116) || chr(104) || chr(101))", "3")}) ORDER BY doc_id, line_no LIMIT 1000')
def search_limited(t):
    return search.search(t.documents, "the", limit=1000).select("doc_id", "line_no")


@query("comment_mask")
def comment_mask(t):
    return t.pages.select("page_id", F.md5(text.masked(F.col("html"), code=True, comments=False)).alias("code"), F.md5(text.masked(F.col("html"), code=False, comments=True)).alias("comments"))


@query("link_extract", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def link_extract(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("csv_clean", "SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x1f]', ' ', 'g')) AS clean FROM documents")
def csv_clean(t):
    return t.documents.select("doc_id", F.md5(text.clean_csv_text(F.col("text"))).alias("clean"))
