"""Search over several scopes in a fixed order under one limit: resources, symbols, annotations, source text, then a second source.

A scope is a name and a function that gives its hits. The function is called only if the scopes before have left room, so a scope after a
full limit costs nothing: its tables are not even listed. Each scope hands on at most what is left of the limit, in its own order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.functions import names
from quarrylens.operators import references, search as lines
from quarrylens.operators.gram_index import GramIndex
from quarrylens.storage import materialise

#: Columns of every hit; line is 0 for a name. Hits of a scope come in order of owner, node and line.
HIT = "owner string, node string, kind string, line_no int, `column` int, length int, line_occurrence int, text string"
FIELDS = ["owner", "node", "kind", "line_no", "column", "length", "line_occurrence", "text"]
ORDER = ["owner", "node", "line_no", "column", "text"]
#: File endings of resources whose text is searched.
TEXT_ENDINGS = ["xml", "arsc", "txt", "json", "html", "js", "css", "properties", "csv", "yaml", "yml"]


@dataclass(frozen=True)
class Query:
    text: str
    regex: bool = False
    case: bool = False
    package: str | None = None

    def matches(self, c: Column) -> Column:
        return F.coalesce(self.place(c)[0] > 0, F.lit(False))

    def place(self, c: Column) -> tuple[Column, Column]:
        return lines.first_match(c, self.text, self.regex, self.case)

    def in_package(self, owner: str = "owner") -> Column:
        return F.lit(True) if self.package is None else names.in_package(F.col(owner), self.package)

    def hits_in(self, docs: DataFrame | GramIndex, key: str, body: str, limit: int | None, **scope) -> DataFrame:
        """Lines of texts that match, from a table or through an index of it."""
        if isinstance(docs, GramIndex):
            return docs.search(self.text, self.regex, self.case, limit=limit, **scope)
        return lines.search(docs, self.text, self.regex, self.case, limit=limit, key=key, body=body, **scope)


@dataclass(frozen=True)
class Scope:
    """hits(left): at least the first `left` hits in ORDER, all if left is None."""

    name: str
    hits: Callable[[int | None], DataFrame]


@dataclass
class Found:
    """hits (scope_no, scope, FIELDS), whether the limit was reached, and hits of each scope that was searched, in order."""

    hits: DataFrame
    truncated: bool
    searched: dict[str, int | None] = field(default_factory=dict)


def search_scopes(spark, scopes: list[Scope], query: Query, limit: int | None = 1000, second: list[Scope] | None = None) -> Found:
    """Hits of the scopes in order until the limit is full, then of the second source's with what is left.

    A limit that is reached exactly counts as truncated. An empty query finds nothing; an invalid expression raises before any scope is opened.
    Without a limit nothing is written and every scope is searched.
    """
    out = spark.createDataFrame([], f"scope_no int, scope string, {HIT}")
    if not query.text:
        return Found(out, False)
    if query.regex:
        lines.check_expression(spark, query.text)
    searched: dict[str, int | None] = {}
    for number, scope in enumerate([*scopes, *(second or [])]):
        left = None if limit is None else limit - sum(searched.values())
        if left is not None and left <= 0:
            break
        rows = scope.hits(left).select(F.lit(number).alias("scope_no"), F.lit(scope.name).alias("scope"), *FIELDS)
        if left is None:
            searched[scope.name] = None
        else:
            rows = materialise(rows.orderBy(*ORDER).limit(left), "hits")
            searched[scope.name] = rows.count()
        out = out.unionByName(rows)
    return Found(out, limit is not None and sum(searched.values()) >= limit, searched)


def named(rows: DataFrame, query: Query, shown: Column, node: Column, kind: Column, text: Column) -> DataFrame:
    """Hits on names: one for each row whose shown name matches."""
    at, length = query.place(shown)
    rows = rows.where(query.in_package() & query.matches(shown))
    return rows.select("owner", node.alias("node"), kind.alias("kind"), F.lit(0).alias("line_no"), at.cast("int").alias("column"), length.cast("int").alias("length"), F.lit(0).alias("line_occurrence"), text.alias("text"))


def symbol_scope(symbols: DataFrame, aliases: DataFrame, query: Query, kinds: set[str]) -> Scope:
    """Classes by dotted name, members by shown name. symbols: as references.symbols; kinds: any of class, method, field."""

    def hits(_: int | None) -> DataFrame:
        member = F.col("kind").isin("method", "field")
        rows = symbols.where(F.when(member, F.col("kind").isin(sorted(kinds & {"method", "field"}))).otherwise(F.lit("class" in kinds)))
        rows = references.with_alias(rows, aliases)
        dotted = F.translate("owner", "/", ".")
        shown = F.when(member, F.col("shown")).otherwise(F.when(F.col("shown") == F.col("name"), dotted).otherwise(F.col("shown")))
        node = F.when(member, F.concat(dotted, F.lit("."), "shown", "descriptor")).otherwise(dotted)
        return named(rows, query, shown, node, F.col("kind"), F.concat(shown, "descriptor"))

    return Scope("symbols", hits)


def annotation_scope(notes: DataFrame, query: Query, code: bool = True, comments: bool = True) -> Scope:
    """Annotations (owner, id, text) with a trailing comment; the parts outside the scope are not searched."""

    def hits(_: int | None) -> DataFrame:
        before, after = F.trim(F.regexp_extract("text", r"(?s)^(.*?)(//.*)?$", 1)), F.regexp_extract("text", r"(?s)^.*?(//.*)$", 1)
        shown = F.array_join(F.filter(F.array(*([before] if code else []), *([after] if comments else [])), lambda p: p != ""), " ")
        return named(notes.where(F.col("text").isNotNull()), query, shown, F.col("id"), F.lit("code"), F.col("text"))

    return Scope("annotations", hits)


def resource_scope(entries: DataFrame, query: Query) -> Scope:
    """Archive entries (name, text) of any package: by name, and by line if their ending says that they are text."""

    def hits(left: int | None) -> DataFrame:
        names_only = replace(query, package=None)
        by_name = named(entries.select(F.col("name").alias("owner")), names_only, F.col("owner"), F.col("owner"), F.lit("resource"), F.substring("owner", 1, lines.CROP))
        readable = entries.where(F.lower(F.substring_index("name", ".", -1)).isin(TEXT_ENDINGS) & F.col("name").contains("."))
        rows = query.hits_in(readable, "name", "text", left)
        by_line = rows.select(F.col("name").alias("owner"), F.col("name").alias("node"), F.lit("resource").alias("kind"), "line_no", "column", "length", "line_occurrence", "text")
        return by_name.unionByName(by_line)

    return Scope("resources", hits)


def source_scope(classes: DataFrame, sources: DataFrame | GramIndex, query: Query, code: bool = True, comments: bool = True, name: str = "code", inner: bool = False) -> Scope:
    """Lines of source text (name, text). An inner class is searched in the source of its outermost class, once; with inner each class has its own.

    classes: (name). Sources of names that no class leads to are not searched.
    """

    def hits(left: int | None) -> DataFrame:
        own = classes.where(query.in_package("name")).select("name")
        if not inner:
            own = references.outer_class(classes).join(own, "name", "left_semi").select(F.col("outer").alias("name"))
        wanted = own.distinct()
        if isinstance(sources, GramIndex):
            rows = query.hits_in(sources.only(wanted), "name", "text", left, code=code, comments=comments)
        else:
            rows = query.hits_in(sources.join(wanted, "name", "left_semi"), "name", "text", left, code=code, comments=comments)
        return rows.select(F.col("name").alias("owner"), F.translate("name", "/", ".").alias("node"), F.lit("code").alias("kind"), "line_no", "column", "length", "line_occurrence", "text")

    return Scope(name, hits)
