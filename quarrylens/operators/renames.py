"""Renaming symbols: checks, undo, replay of a whole alias table, projects that remember their inputs.

Symbols are rows (id, name, ...): classes `Lpackage/Name;`, members `Lpackage/Name;->...` (methods with a parenthesis), and
variables of methods `<method id>@local:<...>:<name>`. Names must be unique in a scope: classes in a package, methods and fields
(apart) in a class, variables in a method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrylens.functions import names
from quarrylens.storage import materialise

#: Renames that can be undone, and steps kept on the driver before the older ones go into the alias table.
UNDO, KEPT = 100, 1000
USER, IMPORTED = "user rename", "imported rename mapping"
ALIASES = "id string, alias string, reason string"
DOCUMENT = "version int, input string, size double, modified string, aliases map<string,string>, inputs array<struct<path:string,size:double,modified:string>>, renameReasons map<string,string>"


def is_local(symbol: Column) -> Column:
    return symbol.contains("@local:")


def method_of(symbol: Column) -> Column:
    """The method id of a variable's id."""
    return F.substring_index(symbol, "@local:", 1)


def scope(symbol: Column) -> Column:
    """In what a symbol's name must be unique."""
    member = F.concat(F.substring_index(symbol, "->", 1), F.when(F.substring_index(symbol, "->", -1).contains("("), "()").otherwise("."))
    return F.when(is_local(symbol), method_of(symbol)).when(symbol.contains("->"), member).otherwise(F.concat(F.lit("package "), names.package_of(F.regexp_replace(symbol, "^L|;$", ""))))


def named(symbols: DataFrame, variables: DataFrame | None, ids: DataFrame) -> DataFrame:
    """(id, name) of symbols, of known variables, and of the variables among ids whose method is a symbol."""
    rows = symbols.select("id", "name")
    if variables is not None:
        rows = rows.unionByName(variables.select("id", "name"))
    local = ids.where(is_local(F.col("id"))).select("id", method_of(F.col("id")).alias("__method"))
    local = local.join(symbols.select(F.col("id").alias("__method")), "__method", "left_semi")
    return rows.unionByName(local.select("id", F.substring_index("id", ":", -1).alias("name"))).groupBy("id").agg(F.min("name").alias("name"))


def fault(known: Column, n: Column, name: Column, alias: Column, taken: Column) -> Column:
    """Why a rename is refused, null if it is not: the first of these that holds."""
    return (
        F.when(~known, "unknown symbol")
        .when(n > 1, "repeated symbol")
        .when(alias.isNull() | ~names.valid_identifier(alias), "no identifier")
        .when(name.startswith("<"), "constructors are named by their class")
        .when(taken, "name is taken in this scope")
    )


def replay(symbols: DataFrame, entries: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(id, alias, error) of each id of entries (id, alias), renamed one after the other in order of id from no aliases at all.

    An entry meets the aliases of smaller ids and the own names of the others. What a scope holds under a name is summed up in a row
    (a symbol that keeps it, the largest id still to be renamed from it, the smallest renamed to it), so that the join adds no rows.
    The errors of all entries come back; the earliest is that of a replay that stops there. An id given twice is an error; null ids are unknown.
    """
    asked = entries.groupBy("id").agg(F.max("alias").alias("alias"), F.count(F.lit(1)).alias("n"))
    rows = named(symbols, variables, asked).join(asked, "id", "full").withColumn("scope", scope(F.col("id")))
    rows = materialise(rows, "renames")
    renamed = F.col("n").isNotNull()
    old = rows.where("name is not null").groupBy("scope", F.col("name").alias("word")).agg(F.max(~renamed).alias("kept"), F.max(F.when(renamed, F.col("id"))).alias("last"))
    new = rows.where(renamed & F.col("name").isNotNull() & F.col("alias").isNotNull()).groupBy("scope", F.col("alias").alias("word")).agg(F.min("id").alias("first"))
    held = old.join(new, ["scope", "word"], "full").select(F.col("scope").alias("__scope"), "word", "kept", "last", "first")
    out = rows.where(renamed).join(held, (F.col("scope") == F.col("__scope")) & (F.col("alias") == F.col("word")), "left")
    taken = F.coalesce("kept", F.lit(False)) | F.coalesce(F.col("last") > F.col("id"), F.lit(False)) | F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    return out.select("id", "alias", fault(F.col("name").isNotNull(), F.col("n"), F.col("name"), F.col("alias"), taken).alias("error"))


def adopt(symbols: DataFrame, entries: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(id, alias, reason): the alias table of entries (id, alias, reason); ValueError, and no table, if any entry is refused.

    An alias that is the symbol's own name leaves no entry.
    """
    found = materialise(replay(symbols, entries, variables), "replayed")
    bad = found.where("error is not null").agg(F.min_by(F.struct("id", "error"), "id").alias("first"), F.count(F.lit(1)).alias("n")).first()
    if bad["n"]:
        at = bad["first"] or found.where("error is not null").select("id", "error").first()
        raise ValueError(f"{at['id']}: {at['error']}")
    own = named(symbols, variables, found).withColumnRenamed("id", "__id")
    kept = found.join(own, F.col("id") == F.col("__id")).where("alias <> name").select("id", "alias")
    return kept.join(entries.select("id", "reason"), "id").select("id", "alias", F.coalesce("reason", F.lit(IMPORTED)).alias("reason"))


class Renames:
    """An alias table under single renames by a user, the last UNDO of which can be undone.

    The steps of a user are kept here; the table itself stays a DataFrame (id, alias, reason).
    """

    def __init__(self, symbols: DataFrame, aliases: DataFrame | None = None, variables: DataFrame | None = None):
        self.spark, self.symbols, self.variables = symbols.sparkSession, symbols, variables
        self.base = aliases if aliases is not None else self.spark.createDataFrame([], ALIASES)
        self.steps: list[tuple[str, str | None]] = []
        self.left = 0

    def _table(self, steps: list[tuple[str, str | None]]) -> DataFrame:
        last = self.spark.createDataFrame([(k, v, USER) for k, v in dict(steps).items()], ALIASES)
        rest = self.base.select("id", "alias", "reason").join(last.select("id"), "id", "left_anti")
        return rest.unionByName(last.where("alias is not null"))

    def aliases(self) -> DataFrame:
        return self._table(self.steps)

    def rename(self, symbol: str, alias: str) -> None:
        """Give a symbol another name, or its own again; ValueError if that is refused."""
        one = self.spark.createDataFrame([(symbol, alias)], "id string, alias string")
        table = self.aliases()
        rows = named(self.symbols, self.variables, one.select("id").unionByName(table.select("id")))
        rows = rows.join(table.select("id", F.col("alias").alias("now")), "id", "left").where(scope(F.col("id")) == scope(F.lit(symbol)))
        here = F.col("id") == F.lit(symbol)
        seen = rows.agg(F.max(F.when(here, F.col("name"))).alias("name"), F.coalesce(F.max(~here & (F.coalesce("now", "name") == F.lit(alias))), F.lit(False)).alias("taken"))
        why = fault(F.col("name").isNotNull(), F.lit(1), F.col("name"), F.lit(alias), F.col("taken"))
        found = seen.select("name", why.alias("error")).first()
        if found["error"]:
            raise ValueError(f"{symbol}: {found['error']}")
        self.steps.append((symbol, None if alias == found["name"] else alias))
        self.left = min(UNDO, self.left + 1)
        if len(self.steps) >= KEPT + UNDO:
            self.base = materialise(self._table(self.steps[:KEPT]), "aliases")
            self.steps = self.steps[KEPT:]

    def undo(self) -> bool:
        """Take the last rename back; False if there is none left."""
        if not self.left:
            return False
        self.steps.pop()
        self.left -= 1
        return True


def identity(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(position, path, size, modified) of the files of each input path; their content is not read."""
    out = spark.createDataFrame([], "position int, path string, size long, modified timestamp")
    for k, path in enumerate(paths):
        found = spark.read.format("binaryFile").load(path)
        out = out.unionByName(found.select(F.lit(k).alias("position"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
    return out


def save_project(path: str, aliases: DataFrame, inputs: list[str]) -> None:
    """Write the alias table and the inputs' identity as Parquet below path, which must not hold a project yet; the identity comes last and makes it whole."""
    aliases.select("id", "alias", "reason").write.parquet(f"{path}/aliases")
    identity(aliases.sparkSession, inputs).write.parquet(f"{path}/inputs")


def load_project(path: str, symbols: DataFrame, inputs: list[str], variables: DataFrame | None = None) -> DataFrame:
    """The alias table of a saved project; ValueError if an input has changed or any alias is refused."""
    spark = symbols.sparkSession
    saved, now = spark.read.parquet(f"{path}/inputs"), identity(spark, inputs)
    if saved.exceptAll(now).unionByName(now.exceptAll(saved)).limit(1).count():
        raise ValueError("the project belongs to other inputs")
    return adopt(symbols, spark.read.parquet(f"{path}/aliases"), variables)


def document_entries(spark: SparkSession, path: str) -> DataFrame:
    """(id, alias, reason) of a project kept as one JSON document of version 1; ValueError for others."""
    rows = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    if not rows.where("version = 1").limit(1).count():
        raise ValueError("no project document of version 1")
    entries = rows.where("version = 1").select("renameReasons", F.explode("aliases").alias("id", "alias"))
    return entries.select("id", "alias", F.coalesce(F.try_element_at("renameReasons", F.col("id")), F.lit(IMPORTED)).alias("reason"))
