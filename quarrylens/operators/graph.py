"""Graphs as edge relations: callers and callees, bounded walks, closures, components.

Walks go level by level. Each level joins the frontier with the edges and drops what has been seen; the frontier and
the visited set are written out so that plans stay short. Nodes and edges never pass through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.storage import materialise, small_or_plain

#: Node limits up to here are kept to; Spark's own limits take 32 bits.
MAX_LIMIT = (1 << 31) - 2


def distinct_edges(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """(src_id, dst_id), each pair once."""
    return rows.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id")).where("src_id is not null and dst_id is not null").distinct()


def register_nodes(occurrences: DataFrame) -> DataFrame:
    """(id, method, type): identities by first occurrence; type 1 if any definition is native.

    occurrences: (method, is_native, order...) where the remaining columns order the first sightings.
    """
    order = [c for c in occurrences.columns if c not in ("method", "is_native")]
    first = occurrences.groupBy("method").agg(F.min(F.struct(*order)).alias("seen"), F.max(F.coalesce(F.col("is_native").cast("int"), F.lit(0))).alias("type"))
    return numbered(first, ["seen", "method"], "id").select("id", "method", "type")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with consecutive numbers from 0 in a total order: counts of range partitions, then numbers inside each."""
    part = rows.repartitionByRange(*order).withColumn("__at", F.spark_partition_id())
    part = materialise(part.sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    sizes = part.groupBy("__at").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    base = sizes.select("__at", F.coalesce(F.sum("__n").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return part.join(F.broadcast(base), "__at").withColumn(name, F.col("__base") + inside).drop("__at", "__row", "__base")


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of a column over all rows up to and with each, in a total order: sums of range partitions, then sums inside each."""
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    part = materialise(part, "totals")
    sums = part.groupBy("__at").agg(F.sum(value).alias("__s"))  # a row for each partition
    before = sums.select("__at", F.coalesce(F.sum("__s").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__at").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("__inside", inside).join(F.broadcast(before), "__at").withColumn(name, F.col("__before") + F.col("__inside")).drop("__at", "__row", "__inside", "__before")


def one_id_space(inputs: list[tuple[DataFrame, DataFrame]], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several inputs, each (nodes (node_id, ...), edges (src_id, dst_id)), under common ids.

    Nodes with one key are one node, numbered from 0 in order of the key; the rest of its columns come from the first input that has
    it. Edges keep their multiplicity; one whose end is no node of its input is left out. Null parts of a key are equal.
    """
    tagged = [(F.lit(k), nodes, edges) for k, (nodes, edges) in enumerate(inputs)]
    nodes = reduce(DataFrame.unionByName, [n.withColumn("__input", k) for k, n, _ in tagged])
    edges = reduce(DataFrame.unionByName, [e.withColumn("__input", k) for k, _, e in tagged])
    rest = [c for c in nodes.columns if c not in (*key, "node_id", "__input")]
    first = nodes.groupBy(*key).agg(F.min_by(F.struct(F.lit(0).alias("__"), *rest), F.struct("__input", "node_id")).alias("__rest"))
    merged = numbered(first, key, "node_id")
    keys = merged.select(F.col("node_id").alias("__new"), *[F.col(c).alias(f"__{c}") for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    ids = materialise(nodes.select("__input", "node_id", *key).join(keys, same).select("__input", "node_id", "__new"), "ids")
    for end in ("src_id", "dst_id"):
        to = ids.withColumnRenamed("node_id", end)
        edges = edges.join(to, ["__input", end]).drop(end).withColumnRenamed("__new", end)
    return merged.select("node_id", *key, *[F.col(f"__rest.{c}").alias(c) for c in rest]), edges.select("src_id", "dst_id", *[c for c in edges.columns if c not in ("__input", "src_id", "dst_id")])


def callees(edges: DataFrame, nodes: DataFrame, node_id) -> DataFrame:
    """The nodes that one node calls."""
    return edges.where(F.col("src_id") == node_id).join(nodes, F.col("dst_id") == F.col("node_id")).select(*[nodes[c] for c in nodes.columns])


def uncalled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.join(edges, F.col("node_id") == F.col("dst_id"), "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, n_out, n_in) of every node that has an edge: one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.o").cast("long").alias("n_out"), F.sum("e.i").cast("long").alias("n_in"))


def neighbourhood(edges: DataFrame, root, depth: int = 2, direction: str = "both", limit: int = 150) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes (node_id, level), edges among expanded nodes, and whether the node limit cut the walk.

    Levels are signed: one less for each caller hop, one more for each callee hop; the first discovery counts, ties go to the
    callee side and then the smaller id. Nodes at the depth are not expanded.
    """
    depth = min(5, max(1, depth))
    schema = edges.schema["src_id"].dataType.simpleString()
    frontier = edges.sparkSession.createDataFrame([(root, 0)], f"node_id {schema}, level long")
    seen, used, limited = frontier, None, False
    for _ in range(depth):
        ahead = frontier.join(edges, F.col("node_id") == F.col("src_id")).select("src_id", "dst_id", F.col("dst_id").alias("next"), (F.col("level") + 1).alias("to"))
        behind = frontier.join(edges, F.col("node_id") == F.col("dst_id")).select("src_id", "dst_id", F.col("src_id").alias("next"), (F.col("level") - 1).alias("to"))
        step = {"both": lambda: ahead.unionByName(behind), "callees": lambda: ahead, "callers": lambda: behind}[direction]()
        step = materialise(step, "step")
        used = step.select("src_id", "dst_id") if used is None else used.unionByName(step.select("src_id", "dst_id"))
        found = step.groupBy("next").agg(F.max("to").alias("level")).withColumnRenamed("next", "node_id").join(seen.select("node_id"), "node_id", "left_anti")
        if limit > MAX_LIMIT:  # as good as none: nothing is sorted or cut
            room, frontier = limit, found
        else:
            room = limit - seen.count()
            frontier = found.orderBy(F.abs("level"), F.desc("level"), "node_id").limit(room + 1)
        frontier = materialise(frontier, "frontier")
        n = frontier.count()
        if n > room:
            limited, frontier = True, frontier.orderBy(F.abs("level"), F.desc("level"), "node_id").limit(room)
        seen = materialise(seen.unionByName(frontier), "seen")
        if not n or limited:
            break
    kept = seen.select("node_id")
    used = used.distinct().join(kept, F.col("src_id") == F.col("node_id"), "left_semi").join(kept, F.col("dst_id") == F.col("node_id"), "left_semi")
    return seen, used, limited


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node_id, level): smallest number of hops from any root along edges, up to depth."""
    seen = materialise(roots.select("node_id").distinct().withColumn("level", F.lit(0)), "seen")
    frontier = seen
    for level in range(1, depth + 1):
        step = edges.join(small_or_plain(frontier.select("node_id")), F.col("src_id") == F.col("node_id")).select(F.col("dst_id").alias("node_id")).distinct()
        frontier = materialise(step.join(seen.select("node_id"), "node_id", "left_anti").withColumn("level", F.lit(level)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = materialise(seen.unionByName(frontier), "seen")
    return seen


def closure(parents: DataFrame, depth: int = 128) -> DataFrame:
    """(child, ancestor, depth, path): every ancestor along parents (child, parent, ordinal) at its smallest distance.

    path holds the ordinals of the way, which breaks ties between ancestors of one distance in declaration order.
    """
    base = parents.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("ordinal").alias("path"))
    first = lambda df: df.groupBy("child", "ancestor").agg(F.min(F.struct("depth", "path")).alias("b")).select("child", "ancestor", "b.depth", "b.path")
    found = materialise(first(base), "closure")
    frontier = found
    for d in range(2, depth + 1):
        up = parents.select(F.col("child").alias("ancestor"), F.col("parent").alias("next"), "ordinal")
        step = frontier.join(up, "ancestor").select("child", F.col("next").alias("ancestor"), F.lit(d).alias("depth"), F.concat("path", F.array("ordinal")).alias("path"))
        step = step.where("child <> ancestor").join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti")
        frontier = materialise(first(step), "frontier")
        if not frontier.limit(1).count():
            break
        # The levels stay files of their own; they are put together now and then, so that plans stay short.
        found = found.unionByName(frontier)
        if d % 16 == 0:
            found = materialise(found, "closure")
    return found


def resolve(references: DataFrame, symbols: DataFrame, parents: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(id, canonical): a member reference class->suffix resolves to the closest ancestor that declares the suffix.

    Known symbols, constructors and static initialisers stand for themselves, as does what no ancestor declares.
    references: (id, owner, suffix); symbols: (owner, suffix).
    """
    best = declared_above(references, symbols, parents, ancestors).select("id", "declared_in")
    return references.join(best, "id", "left").select("id", F.when(F.col("declared_in").isNull(), F.col("id")).otherwise(F.concat(F.col("declared_in"), F.lit("->"), F.col("suffix"))).alias("canonical"))


def declared_above(references: DataFrame, symbols: DataFrame, parents: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(id, suffix, declared_in): the closest ancestor that declares the suffix, of the references that resolve to one.

    Ids, owners and suffixes as for resolve.
    """
    ancestors = closure(parents) if ancestors is None else ancestors
    own = symbols.select("owner", "suffix").distinct()
    # What a class declares is as bounded as its file; looked up as a list, one exchange by owner serves this join and that with the ancestors.
    has = symbols.groupBy("owner").agg(F.collect_set("suffix").alias("has"))
    open_rows = references.where(~F.col("suffix").rlike(r"^<(cl)?init>")).join(has, "owner", "left")
    open_rows = open_rows.where(~F.coalesce(F.array_contains("has", F.col("suffix")), F.lit(False))).drop("has")
    up = open_rows.join(ancestors, F.col("owner") == F.col("child")).join(own.withColumnRenamed("owner", "ancestor"), ["ancestor", "suffix"])
    return up.groupBy("id", "suffix").agg(F.min_by("ancestor", F.struct("depth", "path")).alias("declared_in"))


def overrides(methods: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(owner, suffix, parent): the closest ancestor whose method each method overrides.

    methods: (owner, suffix, flags). Constructors and private or static methods on either side take no part.
    """
    able = methods.where(~F.col("suffix").rlike(r"^<(cl)?init>") & (F.col("flags").bitwiseAND(F.lit(0x0A)) == 0)).select("owner", "suffix")
    up = able.join(ancestors, F.col("owner") == F.col("child")).join(able.select(F.col("owner").alias("ancestor"), "suffix"), ["ancestor", "suffix"])
    return up.groupBy("owner", "suffix").agg(F.min_by("ancestor", F.struct("depth", "path")).alias("parent"))


def override_notes(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """(owner, id, flags, text) of methods that override one: the annotation that a source listing shows for them.

    methods: (id, owner, suffix, name, flags); parents: as overrides. The name is the method's, the class its nearest overridden ancestor, with dots.
    """
    text = F.concat(F.lit("@Override // "), F.translate("parent", "/", "."), F.lit("."), "name")
    return methods.join(parents, ["owner", "suffix"]).select("owner", "id", "flags", text.alias("text"))


def concrete_descendants(classes: DataFrame, ancestors: DataFrame, root: str) -> DataFrame:
    """Classes (name, flags) that reach root and are neither interface nor abstract; root itself counts if it is there."""
    below = ancestors.where(F.col("ancestor") == root).select(F.col("child").alias("name")).distinct()
    rows = classes.where(F.col("flags").bitwiseAND(F.lit(0x600)) == 0)
    return rows.join(below, "name", "left_semi").unionByName(rows.where(F.col("name") == root)).distinct()


def greedy_trace(edges: DataFrame, nodes: DataFrame, matches: Column, depth: int = 2, native: Column | None = None, compat: bool = False, n_match: int = 50, n_root: int = 8, n_list: int = 20) -> DataFrame:
    """(root_id, level, position, node_id, followed): from each matching node the callees listed level by level.

    Of each level at most n_list callees in order of id are listed and the first is followed; a root stops after a level
    with a native callee or without callees. compat takes api_type 3 for native, as the original tool does.
    """
    depth = min(5, max(1, depth or 2)) if depth > 0 else 2
    native = native if native is not None else ((F.col("api_type") == 3) if compat else F.lit(False)) | (F.col("node_type") == 1)
    roots = nodes.where(matches).orderBy("node_type", "node_id").limit(n_match).orderBy("node_type", "node_id").limit(n_root)
    at = materialise(roots.select(F.col("node_id").alias("root_id"), F.col("node_id").alias("at")), "roots")
    kinds = nodes.select("node_id", native.alias("is_native"))
    out = at.select("root_id", F.lit(0).alias("level"), F.lit(1).alias("position"), F.col("at").alias("node_id"), F.lit(True).alias("followed"))
    for level in range(1, depth + 1):
        step = F.broadcast(at).join(edges, F.col("at") == F.col("src_id")).select("root_id", "dst_id").join(kinds, F.col("dst_id") == F.col("node_id"))
        step = step.withColumn("position", F.row_number().over(Window.partitionBy("root_id").orderBy("dst_id"))).where(F.col("position") <= n_list)
        step = materialise(step, "trace")
        out = out.unionByName(step.select("root_id", F.lit(level).alias("level"), "position", F.col("dst_id").alias("node_id"), (F.col("position") == 1).alias("followed")))
        stop = step.where("is_native").select("root_id").distinct()
        at = materialise(step.where("position = 1").join(stop, "root_id", "left_anti").select("root_id", F.col("dst_id").alias("at")), "roots")
        if not at.limit(1).count():
            break
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node_id, component): smallest id reachable when edges are read both ways; alternating large and small stars."""
    edges = materialise(edges.select(F.greatest("src_id", "dst_id").alias("u"), F.least("src_id", "dst_id").alias("v")).distinct(), "stars")
    nodes = edges.select(F.col("u").alias("node_id")).union(edges.select("v")).distinct()
    edges, before = edges.where("u <> v"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(edges, F.col("node_id") == F.col("u"), "left").select("node_id", F.coalesce("v", "node_id").alias("component"))


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node_id, component) of components with more than one node: trim, then forward and backward smallest-id sweeps.

    In each round a node's colour is the smallest id that reaches it; within a colour, what reaches the node of that id is one component.
    Raises RuntimeError if that has not ended after so many rounds; a chain costs a round for each link.
    """
    edges = materialise(edges.where("src_id <> dst_id").distinct(), "scc")
    out = None
    for _ in range(rounds):
        ins, outs = edges.select(F.col("dst_id").alias("n")).distinct(), edges.select(F.col("src_id").alias("n")).distinct()
        live = ins.intersect(outs)
        trimmed = edges.join(live, F.col("src_id") == F.col("n"), "left_semi").join(live, F.col("dst_id") == F.col("n"), "left_semi")
        trimmed = materialise(trimmed, "scc")
        before, after = edges.count(), trimmed.count()
        edges = trimmed
        if not after:
            break
        if after < before:
            continue
        colour = materialise(spread(edges, edges.select(F.col("src_id").alias("n")).union(edges.select("dst_id")).distinct().select("n", F.col("n").alias("c"))), "colour")
        c1, c2 = colour.select(F.col("n").alias("src_id"), F.col("c").alias("cs")), colour.select(F.col("n").alias("dst_id"), F.col("c").alias("cd"))
        same = materialise(edges.join(c1, "src_id").join(c2, "dst_id").where("cs = cd").select("src_id", "dst_id", F.col("cs").alias("c")), "scc")
        back = materialise(colour.where("n = c"), "back")
        frontier = back
        while True:
            step = same.join(frontier, (same["dst_id"] == frontier["n"]) & (same["c"] == frontier["c"])).select(same["src_id"].alias("n"), same["c"]).distinct()
            frontier = materialise(step.join(back, ["n", "c"], "left_anti"), "frontier")
            if not frontier.limit(1).count():
                break
            back = materialise(back.unionByName(frontier), "back")
        found = back.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1").join(back, "c").select(F.col("n").alias("node_id"), F.col("c").alias("component"))
        found = materialise(found, "found")
        out = found if out is None else out.unionByName(found)
        gone = back.select("n")
        edges = materialise(edges.join(gone, F.col("src_id") == F.col("n"), "left_anti").join(gone, F.col("dst_id") == F.col("n"), "left_anti"), "scc")
    else:
        raise RuntimeError(f"strong components did not settle in {rounds} rounds")
    if out is None:
        return edges.select(F.col("src_id").alias("node_id"), F.col("src_id").alias("component")).where("false")
    return out


def spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """(n, c): the smallest colour that reaches each node along edges. Only nodes whose colour has just changed send it on."""
    changed = colours
    while True:
        sent = edges.join(changed, F.col("src_id") == F.col("n")).select(F.col("dst_id").alias("n"), "c", F.lit(None).cast(colours.schema["c"].dataType).alias("had"))
        new = colours.select("n", "c", F.col("c").alias("had")).unionByName(sent).groupBy("n").agg(F.min("c").alias("c"), F.min("had").alias("had"))
        new = materialise(new, "colours")
        colours, changed = new.select("n", "c"), new.where("had is null or c < had").select("n", "c")
        if not changed.limit(1).count():
            return colours
