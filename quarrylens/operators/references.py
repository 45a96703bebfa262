"""Symbols, references and aliases of programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.functions import names
from quarrylens.schemas import REFS_COMPACT, REFS_LEGACY
from quarrylens.storage import materialise, small_or_plain


def decode_references(index: DataFrame) -> DataFrame:
    """(class, from, target, offset, kind) of class index rows, in both encodings of refs.

    The compact encoding has a dictionary ref_targets; an index outside it drops the row, text in its place is taken as
    the target, and a missing kind means bytecode.
    """
    legacy = index.where("ref_targets is null").select("name", F.explode(F.from_json("refs", REFS_LEGACY)).alias("r"))
    legacy = legacy.select(F.col("name").alias("class"), "r.from", "r.target", "r.offset", F.coalesce("r.kind", F.lit("bytecode")).alias("kind"))
    # Targets are looked up inside the row, so that its dictionary goes through no explode.
    at = lambda r: F.get(r, 0).try_cast("int")
    target = lambda r: F.when(at(r).isNull(), F.get(r, 0)).otherwise(F.when(at(r) >= 0, F.get(F.col("ref_targets"), at(r))))
    named = F.transform_values(F.from_json("refs", REFS_COMPACT), lambda _, rows: F.transform(rows, lambda r: F.struct(target(r).alias("target"), r.alias("r"))))
    groups = index.where("ref_targets is not null").select("name", F.explode(named).alias("from", "rows"))
    rows = groups.select(F.col("name").alias("class"), "from", F.explode("rows").alias("x")).select("class", "from", "x.target", "x.r")
    rows = rows.select("class", "from", "target", F.get("r", 1).try_cast("int").alias("offset"), F.coalesce(F.get("r", 2), F.lit("bytecode")).alias("kind"))
    return legacy.unionByName(rows).where("target is not null and target <> ''")


def encode_references(refs: DataFrame) -> DataFrame:
    """(class, refs, ref_targets): the compact encoding of (class, from, target, offset, kind), a row for each caller.

    Callers of a class have a dictionary each, so no row grows with a class; decode_references puts the rows together as it finds them.
    """
    lists = refs.groupBy("class", "from").agg(F.sort_array(F.collect_set("target")).alias("ref_targets"), F.sort_array(F.collect_list(F.struct("target", "offset", "kind"))).alias("l"))
    at = lambda r: (F.array_position("ref_targets", r["target"]) - 1).cast("string")
    rows = F.transform("l", lambda r: F.array(at(r), r["offset"].cast("string"), r["kind"]))
    return lists.select("class", F.to_json(F.create_map("from", rows)).alias("refs"), "ref_targets")


def symbols(index: DataFrame) -> DataFrame:
    """(id, name, owner, kind, flags, descriptor): classes and their members."""
    classes = index.select(F.concat(F.lit("L"), "name", F.lit(";")).alias("id"), F.regexp_extract("name", "[^/]*$", 0).alias("name"), F.col("name").alias("owner"), F.coalesce("kind", names.class_kind(F.col("flags"))).alias("kind"), "flags", F.lit("").alias("descriptor"))
    parts = [index.select(F.col("name").alias("owner"), F.explode(c).alias("m")).select("m.id", "m.name", "owner", F.lit(k).alias("kind"), "m.flags", "m.descriptor") for c, k in (("methods", "method"), ("fields", "field"))]
    return classes.unionByName(parts[0]).unionByName(parts[1])


def parents(refs: DataFrame) -> DataFrame:
    """(child, parent, ordinal) from extends and implements references, in order of offset."""
    up = refs.where(F.col("kind").isin("extends", "implements")).select(F.col("class").alias("child"), names.normalise_class(F.col("target")).alias("parent"), (F.col("kind") != "extends").cast("int").alias("k"), "offset")
    order = F.row_number().over(Window.partitionBy("child").orderBy("k", "offset", "parent"))
    return up.select("child", "parent", order.alias("ordinal"))


def latest(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """Of rows with one key the last to arrive: re-adding replaces."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), arrival).alias("r")).select(key, "r.*").select(rows.columns)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each composite key, with its payload: an aggregation with map-side combine, not a window."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*").select(rows.columns)


def callees(refs: DataFrame, member: str) -> DataFrame:
    """Distinct (target, offset) that a member's bytecode refers to, member targets only."""
    rows = refs.where((F.col("from") == member) & F.col("kind").isin("bytecode", "") & F.col("target").contains("->"))
    return rows.select("target", "offset").distinct()


def with_class_targets(refs: DataFrame) -> DataFrame:
    """refs with `about`: the target itself and, for a member, also its class."""
    member = F.col("target").contains("->")
    owner = F.concat(F.lit("L"), names.class_of(F.col("target")), F.lit(";"))
    return refs.withColumn("about", F.explode(F.when(member, F.array("target", owner)).otherwise(F.array("target"))))


def xrefs(refs: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """(about, class, from, target, offset, kind): references to each symbol, once per (class, from, canonical target, offset).

    canonical: (id, canonical), see graph.resolve. The first row in order of kind stands for its key.
    """
    rows = refs if canonical is None else refs.join(canonical, F.col("target") == F.col("id"), "left").withColumn("to", F.coalesce("canonical", "target")).drop("id", "canonical")
    rows = rows if canonical is not None else rows.withColumn("to", F.col("target"))
    rows = first_of_each(rows, ["class", "from", "to", "offset"], ["kind", "target"])
    return with_class_targets(rows.withColumn("raw", F.col("target")).withColumn("target", F.col("to"))).select("about", "class", "from", F.col("raw").alias("target"), "offset", "kind")


def with_alias(rows: DataFrame, aliases: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """rows with shown: the alias of the key where there is one, else the name."""
    return rows.join(aliases.select(F.col("id").alias("__id"), "alias"), F.col(key) == F.col("__id"), "left").withColumn("shown", F.coalesce("alias", name)).drop("__id", "alias")


def find_symbols(rows: DataFrame, aliases: DataFrame, query: str) -> DataFrame:
    """Symbols whose id or shown name contains the query, without regard to case; an empty query gives all."""
    shown = with_alias(rows, aliases)
    return shown if not query else shown.where(F.lower("id").contains(query.lower()) | F.lower("shown").contains(query.lower()))


def one_member(rows: DataFrame, owner: str, name: str, descriptor: str | None = None) -> str:
    """The id of the only member that fits; raises LookupError if none or several do."""
    found = rows.where((F.col("owner") == owner) & (F.col("name") == name) & (F.lit(descriptor is None) | (F.col("descriptor") == descriptor))).select("id").limit(2).collect()
    if len(found) != 1:
        raise LookupError("ambiguous" if found else "not found")
    return found[0]["id"]


def deobfuscate(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, alias, reason): readable names for suspicious ones, the n-th free number for the n-th such id of a kind.

    Free numbers are those whose name no symbol shows; ids with an alias, constructors and initialisers keep theirs.
    Running it on its own result changes nothing.
    """
    from quarrylens.operators.graph import numbered, running_total

    shown = with_alias(rows, aliases).select("shown").distinct()
    member = F.col("id").contains("->")
    prefix = F.when(~member, "Class_").when(F.col("id").contains("("), "method_").otherwise("field_")
    todo = rows.where(~F.col("name").isin("", "<init>", "<clinit>") & names.suspicious_name(F.col("name"))).join(aliases.select("id"), "id", "left_anti").select("id", "name", prefix.alias("prefix")).distinct()
    todo = numbered(todo, ["prefix", "id"], "at")
    start = todo.groupBy("prefix").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    todo = todo.join(F.broadcast(start), "prefix").select("id", "name", "prefix", (F.col("at") - F.col("first")).alias("k"))
    taken = shown.select(F.regexp_extract("shown", r"^(Class_|method_|field_)([1-9][0-9]{0,9})$", 1).alias("prefix"), F.regexp_extract("shown", r"_([1-9][0-9]{0,9})$", 1).try_cast("long").alias("number")).where("prefix <> ''")
    # The n-th free number is n plus the taken ones at or below it; each taken number t moves those with k + 1 >= t - (taken below t).
    # Numbers and sums come from range partitions over all prefixes; what lies before a prefix is taken off again.
    taken = numbered(taken, ["prefix", "number"], "at")
    ahead = taken.groupBy("prefix").agg(F.min("at").alias("first"))
    shift = taken.join(F.broadcast(ahead), "prefix").select("prefix", (F.col("number") - (F.col("at") - F.col("first"))).alias("from_k"))
    steps = materialise(shift.groupBy("prefix", "from_k").agg(F.count(F.lit(1)).alias("more")), "steps")
    sums = steps.groupBy("prefix").agg(F.sum("more").alias("s"))  # a row for each of the three prefixes
    base = sums.select("prefix", F.coalesce(F.sum("s").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    both = todo.select("prefix", "k", F.lit(1).alias("is_row"), "id", "name", F.lit(0).cast("long").alias("more")).unionByName(steps.select("prefix", (F.col("from_k") - 1).alias("k"), F.lit(0).alias("is_row"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), "more"))
    both = running_total(both, ["prefix", "k", "is_row", "id"], "more", "total").where("is_row = 1").join(F.broadcast(base), "prefix", "left")
    # Without a taken number before it a prefix has no row in base of its own; nothing moves then.
    both = both.withColumn("moved", F.when(F.col("base").isNotNull(), F.col("total") - F.col("base")).otherwise(F.lit(0)))
    return both.select("id", F.concat("prefix", (F.col("k") + 1 + F.col("moved")).cast("string")).alias("alias"), names.rename_reason(F.col("name")).alias("reason"))


def alias_version(aliases: DataFrame) -> DataFrame:
    """One row: SHA-256 over all entries in order of id; equal tables have equal versions, other ones do not.

    Each entry's fields go with their lengths. Entries meet in 65536 groups by the digest of their id, so that no task holds all of
    them; the last digest is over the groups.
    """
    field = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    entry = F.concat(field(F.col("id")), field(F.coalesce("alias", F.lit(""))), field(F.coalesce("reason", F.lit(""))))
    key = F.sha2("id", 256)
    groups = aliases.groupBy(F.substring(key, 1, 4).alias("part")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat(key, F.sha2(entry, 256)))), ","), 256).alias("digest"))
    return groups.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("part", "digest"))), ","), 256).alias("version"))


def resolve_tokens(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """(token, package, id): a simple name that is unique, else unique in the token's package, else null."""
    overall = rows.groupBy(F.col("name").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    local = rows.groupBy(F.col("name").alias("token"), "package").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("here"))
    out = tokens.join(overall, "token", "left").join(local, ["token", "package"], "left")
    return out.select("token", "package", F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("here")).alias("id"))


def outer_class(classes: DataFrame) -> DataFrame:
    """(name, outer): the outermost known class of each class, by cutting after the last $ as long as the rest is known.

    All cuts of a name are looked up by one join, so nesting of any depth takes one pass.
    """
    known = classes.select(F.col("name").alias("up")).distinct()
    parts = F.size(F.split("name", r"\$"))
    cuts = known.select(F.col("up").alias("name")).withColumn("left", F.explode(F.when(parts > 1, F.sequence(F.lit(1), parts - 1))))
    cuts = cuts.withColumn("up", F.expr("substring_index(name, '$', left)"))
    found = cuts.join(known.withColumn("hit", F.lit(True)), "up", "left")
    reach = found.groupBy("name").agg(F.max(F.when(F.col("hit").isNull(), F.col("left"))).alias("miss"), F.max("left").alias("most"))
    outer = reach.where("miss is null or miss < most").select("name", F.expr("substring_index(name, '$', coalesce(miss, 0) + 1)").alias("outer"))
    return classes.select("name").join(outer, "name", "left").select("name", F.coalesce("outer", "name").alias("outer"))


def names_containing(rows: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """rows joined with keys whose text the name contains, once for each pair of rows; empty and null keys and names meet nothing.

    The names' substrings of the keys' lengths meet the keys by equality, so no nested loop runs.
    """
    keys = keys.where(F.length(key) > 0)
    lengths = sorted(r[0] for r in keys.select(F.length(key)).distinct().collect())  # at most the longest key's length

    def parts_of(k: int) -> Column:
        at = F.sequence(F.lit(1), F.length(name) - k + 1)
        return F.when(F.length(name) >= k, F.transform(at, lambda i: F.substring(F.col(name), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    if not lengths:
        return rows.join(keys, F.lit(False))
    parts = rows.withColumn("__part", F.explode(F.array_distinct(F.flatten(F.array(*map(parts_of, lengths))))))
    return parts.join(keys, F.col("__part") == F.col(key)).drop("__part")


def classify_api(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """nodes (class_name, method_name, ...) with api_type: the first rule in order for the pair, 0 if none.

    rules: (position, class_name, method_name, api_type). One row of each pair is left before the join.
    """
    first = rules.groupBy("class_name", "method_name").agg(F.min_by("api_type", "position").alias("api_type"))
    return nodes.drop("api_type").join(small_or_plain(first), ["class_name", "method_name"], "left").withColumn("api_type", F.coalesce("api_type", F.lit(0)))


def string_marks(literals: DataFrame, marks: DataFrame) -> DataFrame:
    """literals (str, ...) with bits: OR of all marks (text, bit) of the text; marks of other texts are ignored."""
    bits = marks.groupBy("text").agg(F.bit_or("bit").alias("bits"))
    return literals.join(bits, F.col("str") == F.col("text"), "left").drop("text").withColumn("bits", F.coalesce("bits", F.lit(0)))


def page(rows: DataFrame, order: list[str | Column], offset: int = 0, count: int = 100) -> DataFrame:
    """One page in a total order; a negative offset is 0, the count is held between 1 and 1000."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, count)))
