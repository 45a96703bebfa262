"""The entry for users: read-only SQL over registered relations, and named tools with strict arguments."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.functions import names
from quarrylens.operators import graph, references

#: Rows a tool gives back at most, and bytes of its rendered rows; both are limits of the interface, never of an operator.
MAX_ROWS, MAX_BYTES = 1000, 4 << 20


class Engine:
    """Relations by name (symbols, edges, nodes, and any others), queried by SQL or by tools.

    symbols: (id, name, owner, kind, flags, descriptor); edges: (src_id, dst_id).
    """

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame]):
        self.spark, self.relations = spark, relations

    def query(self, sql: str) -> DataFrame:
        """The rows of one SQL query over the relations, and over nothing else.

        The text is parsed once, before anything runs: it must be one query, its tables must be relations of this engine or names of its own WITH, and
        functions that reach outside the query are refused. Views of the session keep their names and content.
        """
        text = (sql or "").strip().rstrip(";")
        if not text.strip():
            raise ValueError("empty query")
        used = checked(self.spark, text, set(self.relations))
        with VIEWS:
            before = {n: self.spark.table(n) for n in used if self.spark.catalog.tableExists(n)}
            try:
                for n in used:
                    self.relations[n].createOrReplaceTempView(n)
                return self.spark.sql(text)
            finally:
                for n in used:
                    self.spark.catalog.dropTempView(n)
                for n, view in before.items():
                    if not self.spark.catalog.tableExists(n):
                        view.createOrReplaceTempView(n)

    def tools(self) -> dict[str, tuple[Callable[..., DataFrame], dict[str, type], set[str]]]:
        """name -> (function, types of its arguments, those that must be given)."""
        return {
            "get_all_classes": (self.classes, {"offset": int, "count": int}, set()),
            "get_methods_of_class": (lambda class_name, **p: self.members("method", class_name, **p), {"class_name": str, "offset": int, "count": int}, {"class_name"}),
            "get_fields_of_class": (lambda class_name, **p: self.members("field", class_name, **p), {"class_name": str, "offset": int, "count": int}, {"class_name"}),
            "search_method_by_name": (lambda name, **p: self.search("method", name, **p), {"name": str, "offset": int, "count": int}, {"name"}),
            "search_classes_by_keyword": (lambda keyword, **p: self.search("class", keyword, **p), {"keyword": str, "offset": int, "count": int}, {"keyword"}),
            "native_method_find": (self.native_methods, {"name": str, "offset": int, "count": int}, {"name"}),
            "get_call_graph": (self.neighbours, {"id": int, "depth": int}, {"id"}),
            "cg_query": (lambda sql: self.query(sql), {"sql": str}, {"sql"}),
        }

    def call(self, tool: str, **given) -> DataFrame:
        """Run a tool; unknown tools and missing, unknown or wrongly typed arguments are errors."""
        if tool not in self.tools():
            raise ValueError(f"unknown tool {tool}")
        f, kinds, needed = self.tools()[tool]
        if missing := sorted(needed - set(given)):
            raise ValueError(f"{tool} needs {', '.join(missing)}")
        for k, v in given.items():
            if k not in kinds:
                raise ValueError(f"{tool} knows no argument {k}")
            if type(v) is not kinds[k]:
                raise TypeError(f"{tool}: {k} must be {kinds[k].__name__}")
        return f(**given)

    def rendered(self, tool: str, **given) -> list[dict]:
        """A tool's rows as dictionaries, MAX_ROWS at most; more bytes than MAX_BYTES are an error that asks for a smaller page."""
        rows = [r.asDict() for r in self.call(tool, **given).limit(MAX_ROWS).collect()]
        if sum(len(str(r).encode()) for r in rows) > MAX_BYTES:
            raise ValueError("the answer is too large: ask for fewer rows")
        return rows

    def classes(self, offset: int = 0, count: int = 100) -> DataFrame:
        rows = self.relations["symbols"].where("id not like '%->%'")
        return references.page(rows.select("id", "name", "kind", "flags"), ["id"], offset, count)

    def members(self, kind: str, class_name: str, offset: int = 0, count: int = 100) -> DataFrame:
        rows = self.relations["symbols"].where((F.col("kind") == kind) & (F.col("owner") == names.normalise_class(F.lit(class_name))))
        return references.page(rows.select("id", "name", "flags", "descriptor"), ["id"], offset, count)

    def search(self, kind: str, text: str, offset: int = 0, count: int = 100) -> DataFrame:
        """Names that begin with a text, then those that hold it."""
        rows = self.relations["symbols"].where((F.col("kind") == "method") if kind == "method" else ~F.col("id").contains("->"))
        return references.page(found_by_name(rows, "name", text).select("id", "name", "owner", "rank"), [F.desc("rank"), "id"], offset, count).drop("rank")

    def native_methods(self, name: str, offset: int = 0, count: int = 100) -> DataFrame:
        """Methods with the native flag whose id or JNI symbol the name begins or is part of."""
        rows = self.relations["symbols"].where((F.col("kind") == "method") & (F.col("flags").bitwiseAND(F.lit(names.ACC_NATIVE)) > 0))
        rows = rows.withColumn("symbol", F.concat(names.jni_prefix(F.col("owner")), "name"))
        hit = F.greatest(names.prefix_or_part(F.col("symbol"), name), names.prefix_or_part(F.col("name"), name))
        return references.page(rows.withColumn("rank", hit).where("rank > 0").select("id", "symbol", "rank"), [F.desc("rank"), "id"], offset, count).drop("rank")

    def neighbours(self, id: int, depth: int = 1) -> DataFrame:
        """The edges around a node, in both directions."""
        return graph.neighbourhood(self.relations["edges"], id, depth)[1]


class NotAllowed(AnalysisException):
    """A query that would leave the relations it is given."""


#: Names of temporary views belong to the session, so one query at a time sets them.
VIEWS = threading.Lock()
#: What a query may be made of: the parser's plan nodes besides expressions and unresolved names. Commands are not among them.
QUERY_NODES = frozenset(
    "Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation OneRowRelation Offset Pivot Project Repartition RepartitionByExpression "
    "RebalancePartitions Sample Sort SubqueryAlias Union Unpivot UnpivotTransformer Window WithWindowDefinition".split()
)
#: Functions that read files, call Java, or tell of the session; and the only table functions that are let through.
REFUSED = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog current_database current_schema "
    "version spark_partition_id monotonically_increasing_id raise_error assert_true identifier getvariable".split()
)
TABLE_FUNCTIONS = frozenset("explode explode_outer posexplode posexplode_outer inline inline_outer stack range".split())


def checked(spark: SparkSession, sql: str, relations: set[str]) -> set[str]:
    """The relations a query names; NotAllowed for anything that it may not hold, ParseException for what is no query."""
    root = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    known, used, own = {r.lower(): r for r in relations}, set(), set()
    parts = lambda v: [p.strip() for p in v.strip("[]").split(",")]
    todo, named = [root], []
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += x
            continue
        if not isinstance(x, dict):
            continue
        todo += x.values()
        package, _, kind = x.get("class", "").rpartition(".")
        if kind == "UnresolvedWith":
            own |= {c["_1"].lower() for c in x["cteRelations"]}
        elif kind == "UnresolvedRelation":
            named.append(parts(x["multipartIdentifier"]))
        elif kind == "UnresolvedFunction":
            if len(name := parts(x["nameParts"])) > 1 or name[0].lower() in REFUSED:
                raise NotAllowed(f"the function {'.'.join(name)} is not allowed")
        elif "TableValuedFunction" in kind or kind == "UnresolvedTVFAliases":
            name = parts(x["name"]) if "name" in x else [""]
            if "name" in x and (len(name) > 1 or name[0].lower() not in TABLE_FUNCTIONS):
                raise NotAllowed(f"the table function {'.'.join(name)} is not allowed")
        elif "class" in x and (not package.startswith("org.apache.spark.sql.catalyst.") or package.endswith("plans.logical") and kind not in QUERY_NODES and not kind.startswith("Unresolved")):
            raise NotAllowed(f"{kind} is not allowed in a query")
        elif any(word in kind for word in ("Identifier", "Namespace", "Variable")):
            raise NotAllowed(f"{kind} is not allowed in a query")
    for name in named:
        one = name[0].lower()
        if len(name) > 1 or not (one in known or one in own):
            raise NotAllowed(f"{'.'.join(name)} is no relation of this engine")
        if one in known:
            used.add(known[one])
        elif spark.catalog.tableExists(name[0]):
            raise NotAllowed(f"{name[0]} is also a table of the session")
    return used


def found_by_name(rows: DataFrame, column: str, text: str) -> DataFrame:
    """rows whose column begins with the text (rank 2) or holds it (rank 1)."""
    return rows.withColumn("rank", names.prefix_or_part(F.col(column), text)).where("rank > 0")


def report(title: str, sections: dict[str, DataFrame], rows: int = 20) -> str:
    """Markdown of small results: a table for each section, of its first rows in its own order."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        found = df.limit(rows + 1).collect()
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(map(cell, r)) + " |" for r in found[:rows]] + (["", "More rows are left out here."] if len(found) > rows else []) + [""]
    return "\n".join(out)
