"""Graph and reference queries on the supply graph, the nation hierarchy and the lines of orders."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarrylens.operators import dataflow, graph, references, renames
from quarrylens.plans.base import EDGES, SUPPLIER_BASE, query, supply_edges


@query("edges_distinct", EDGES)
def edges_distinct(t):
    return supply_edges(t)


@query("degree", f"WITH e AS ({EDGES}) SELECT node_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src_id AS node_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst_id, 0, 1 FROM e) GROUP BY node_id")
def degree(t):
    return graph.degrees(supply_edges(t))


@query("callees", f"WITH e AS ({EDGES}) SELECT s_suppkey AS node_id, s_name AS name FROM e JOIN (SELECT s_suppkey + {SUPPLIER_BASE} AS k, * FROM supplier) ON dst_id = k WHERE src_id = 1")
def callees(t):
    nodes = t.supplier.select((F.col("s_suppkey") + SUPPLIER_BASE).alias("node_id"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return graph.callees(supply_edges(t), nodes, 1).select(F.col("key").alias("node_id"), "name")


@query("uncalled_anti", "SELECT min_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS node_id FROM orders GROUP BY o_custkey")
def uncalled_anti(t):
    """Orders that follow no other order of their customer."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = t.orders.select(F.col("o_orderkey").alias("src_id"), after.alias("dst_id")).where("dst_id is not null")
    return graph.uncalled(edges, t.orders.select(F.col("o_orderkey").alias("node_id")))


@query("register_nodes", "SELECT method, type, row_number() OVER (ORDER BY k, n, method) - 1 AS id FROM (SELECT p_name AS method, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS type, min(struct_pack(a := l_orderkey, b := l_linenumber)).a AS k, min(struct_pack(a := l_orderkey, b := l_linenumber)).b AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name)")
def register_nodes(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("method"), (F.col("l_returnflag") == "R").alias("is_native"), "l_orderkey", "l_linenumber")
    return graph.register_nodes(rows)


@query("xrefs_dedup", "SELECT DISTINCT p_brand AS class, l_orderkey AS from_id, l_partkey AS target, l_linenumber AS off FROM lineitem JOIN part ON l_partkey = p_partkey")
def xrefs_dedup(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("class"), F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("off"), F.col("l_shipdate").alias("d"))
    return references.first_of_each(rows, ["class", "from_id", "target", "off"], ["d"]).drop("d")


@query("xrefs_class_rollup", "SELECT p_brand AS about, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_brand")
def xrefs_class_rollup(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").distinct().join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("about")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bfs_depth_n",
    f"""WITH RECURSIVE e AS (SELECT src_id, dst_id FROM ({EDGES}) UNION SELECT dst_id, src_id FROM ({EDGES})),
    walk(node_id, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT dst_id, level + 1 FROM walk JOIN e ON node_id = src_id WHERE level < 3)
    SELECT node_id, min(level) AS level FROM walk GROUP BY node_id""",
)
def bfs_depth_n(t):
    edges = supply_edges(t)
    both = edges.unionByName(edges.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id")))
    return graph.reachable(both, t.spark.createDataFrame([(1,)], "node_id long"), 3)


@query(
    "neighbourhood_both",
    f"""WITH e AS ({EDGES}), l1 AS (SELECT DISTINCT dst_id AS node_id FROM e WHERE src_id = 1), l2 AS (SELECT DISTINCT src_id AS node_id FROM e WHERE dst_id IN (SELECT node_id FROM l1) AND src_id <> 1)
    SELECT CAST(1 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS level UNION ALL SELECT node_id, 1 FROM l1 UNION ALL SELECT node_id, 0 FROM l2""",
)
def neighbourhood_both(t):
    return graph.neighbourhood(supply_edges(t), 1, 2, "both", limit=1 << 40)[0]


@query(
    "greedy_trace",
    f"""WITH e AS ({EDGES}), r AS (SELECT c_custkey AS root_id FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 8),
    l1 AS (SELECT root_id, dst_id, row_number() OVER (PARTITION BY root_id ORDER BY dst_id) AS p FROM r JOIN e ON src_id = root_id)
    SELECT root_id, 0 AS level, 1 AS position, root_id AS node_id, TRUE AS followed FROM r UNION ALL SELECT root_id, 1, p, dst_id, p = 1 FROM l1 WHERE p <= 20""",
)
def greedy_trace(t):
    nodes = t.customer.select(F.col("c_custkey").alias("node_id"), F.lit(0).alias("node_type"), "c_mktsegment", F.lit(0).alias("api_type"))
    nodes = nodes.unionByName(t.supplier.select((F.col("s_suppkey") + SUPPLIER_BASE).alias("node_id"), F.lit(1).alias("node_type"), F.lit("").alias("c_mktsegment"), F.lit(0).alias("api_type")))
    return graph.greedy_trace(supply_edges(t), nodes, F.col("c_mktsegment") == "BUILDING", depth=2)


NEXT = "SELECT DISTINCT l_partkey AS src_id, nxt AS dst_id FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL"
DEPTH = 4


def trace_sql() -> str:
    """Levels one after another: the callees listed, then the first followed unless one of those listed is native."""
    levels = ["x0 AS (SELECT p_partkey AS root_id, p_partkey AS pos FROM part WHERE p_brand = 'Brand#1' ORDER BY p_size % 47 = 0, p_partkey LIMIT 8)"]
    for k in range(1, DEPTH + 1):
        levels.append(f"l{k} AS (SELECT root_id, dst_id, p, native FROM (SELECT root_id, dst_id, p_size % 47 = 0 AS native, row_number() OVER (PARTITION BY root_id ORDER BY dst_id) AS p FROM x{k - 1} JOIN e ON src_id = pos JOIN part ON p_partkey = dst_id) WHERE p <= 20)")
        levels.append(f"x{k} AS (SELECT root_id, dst_id AS pos FROM l{k} WHERE p = 1 AND root_id NOT IN (SELECT root_id FROM l{k} WHERE native))")
    rows = " UNION ALL ".join(f"SELECT root_id, {k} AS level, p, dst_id, p = 1 FROM l{k}" for k in range(1, DEPTH + 1))
    return f"WITH e AS MATERIALIZED ({NEXT}), {', '.join(levels)} SELECT root_id, 0 AS level, 1 AS position, pos AS node_id, TRUE AS followed FROM x0 UNION ALL {rows}"


@query("greedy_trace_deep", trace_sql())
def greedy_trace_deep(t):
    """Parts that follow one another in orders: several levels, some of which end at a native callee."""
    nodes = t.part.select(F.col("p_partkey").alias("node_id"), (F.col("p_size") % 47 == 0).cast("int").alias("node_type"), "p_brand", F.lit(0).alias("api_type"))
    return graph.greedy_trace(copurchase(t), nodes, F.col("p_brand") == "Brand#1", depth=DEPTH)


def hierarchy(t):
    """(child, parent, ordinal): customers under nations, nations under regions."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    up = t.customer.select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"), F.lit(1).alias("ordinal"))
    return up.unionByName(t.nation.select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"), F.lit(1).alias("ordinal")))


UP = "SELECT 'c/' || c_custkey AS child, 'n/' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n/' || n_nationkey, 'r/' || n_regionkey FROM nation"


@query("ancestor_closure", f"WITH RECURSIVE up AS ({UP}), a(child, ancestor, depth) AS (SELECT child, parent, 1 FROM up UNION ALL SELECT a.child, up.parent, depth + 1 FROM a JOIN up ON up.child = a.ancestor) SELECT child, ancestor, depth FROM a")
def ancestor_closure(t):
    return graph.closure(hierarchy(t)).select("child", "ancestor", "depth")


@query("nearest_ancestor", "SELECT 'c/' || c_custkey || '->' || 'm' || (c_custkey % 3) AS id, CASE c_custkey % 3 WHEN 0 THEN 'n/' || c_nationkey WHEN 1 THEN 'r/' || n_regionkey ELSE 'c/' || c_custkey END || '->m' || (c_custkey % 3) AS canonical FROM customer JOIN nation ON c_nationkey = n_nationkey")
def nearest_ancestor(t):
    refs = t.customer.select(F.concat(F.lit("c/"), "c_custkey").alias("owner"), F.concat(F.lit("m"), F.col("c_custkey") % 3).alias("suffix"))
    refs = refs.select(F.concat("owner", F.lit("->"), "suffix").alias("id"), "owner", "suffix")
    known = t.nation.select(F.concat(F.lit("n/"), "n_nationkey").alias("owner"), F.lit("m0").alias("suffix")).union(t.region.select(F.concat(F.lit("r/"), "r_regionkey"), F.lit("m1")))
    return graph.resolve(refs, known, hierarchy(t))


@query("overrides", "SELECT 'c/' || c_custkey AS owner, 'm()' AS suffix, CASE WHEN n_nationkey % 2 = 0 THEN 'n/' || n_nationkey ELSE 'r/' || n_regionkey END AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n/' || n_nationkey, 'm()', 'r/' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0")
def overrides(t):
    own = t.customer.select(F.concat(F.lit("c/"), "c_custkey").alias("owner"), F.lit("m()").alias("suffix"), F.lit(1).alias("flags"))
    own = own.union(t.nation.select(F.concat(F.lit("n/"), "n_nationkey"), F.lit("m()"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(2))).union(t.region.select(F.concat(F.lit("r/"), "r_regionkey"), F.lit("m()"), F.lit(1)))
    return graph.overrides(own, graph.closure(hierarchy(t)))


@query("concrete_descendants", "SELECT 'c/' || c_custkey AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_acctbal > 0")
def concrete_descendants(t):
    classes = t.customer.select(F.concat(F.lit("c/"), "c_custkey").alias("name"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0x400).alias("flags"))
    return graph.concrete_descendants(classes, graph.closure(hierarchy(t)), "r/1").select("name")


def copurchase(t):
    """Edges between parts that follow one another in an order,."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = t.lineitem.select("l_orderkey", "l_partkey", F.lead("l_partkey").over(w).alias("next"))
    return graph.distinct_edges(rows, "l_partkey", "next")


@query("components")
def components(t):
    return graph.components(copurchase(t))


@query("strong_components")
def strong_components(t):
    return graph.strong_components(copurchase(t))


@query("string_marks", "SELECT p_type AS str, bit_or(CASE WHEN l_returnflag = 'R' THEN 8 WHEN l_linestatus = 'O' THEN 32 ELSE 2 END) AS bits FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_type")
def string_marks(t):
    marks = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("text"), F.when(F.col("l_returnflag") == "R", 8).when(F.col("l_linestatus") == "O", 32).otherwise(2).alias("bit"))
    return references.string_marks(t.part.select(F.col("p_type").alias("str")).distinct(), marks)


@query("api_match_first", "WITH r(position, class_name, method_name, api_type) AS (VALUES (1, 'Brand#11', 'a', 4), (2, 'Brand#12', 'b', 7), (3, 'Brand#11', 'a', 9), (4, 'Brand#13', 'c', 5)) SELECT p_partkey, coalesce((SELECT arg_min(api_type, position) FROM r WHERE class_name = p_brand AND method_name = chr(CAST(97 + p_size % 3 AS INTEGER))), 0) AS api_type FROM part")
def api_match_first(t):
    rules = t.spark.createDataFrame([(1, "Brand#11", "a", 4), (2, "Brand#12", "b", 7), (3, "Brand#11", "a", 9), (4, "Brand#13", "c", 5)], "position int, class_name string, method_name string, api_type int")
    nodes = t.part.select("p_partkey", F.col("p_brand").alias("class_name"), F.char(97 + F.col("p_size") % 3).alias("method_name"))
    return references.classify_api(nodes, rules).select("p_partkey", "api_type")


def line_refs(t):
    """References (class, from, target, offset, kind): brands, orders, parts and line numbers."""
    return t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("class"), F.col("l_orderkey").cast("string").alias("from"), F.concat(F.lit("part"), "l_partkey").alias("target"), F.col("l_linenumber").alias("offset"), F.lit("bytecode").alias("kind"))


@query("compact_decode", "SELECT DISTINCT p_brand AS class, CAST(l_orderkey AS VARCHAR) AS from_id, 'part' || l_partkey AS target, l_linenumber AS off, 'bytecode' AS kind FROM lineitem JOIN part ON l_partkey = p_partkey")
def compact_decode(t):
    # Dealt by caller first: the distinct rows and the lists of a caller then need no exchange of their own.
    packed = references.encode_references(line_refs(t).repartition("class", "from").distinct()).withColumnRenamed("class", "name")
    return references.decode_references(packed).select("class", F.col("from").alias("from_id"), "target", F.col("offset").alias("off"), "kind")


@query("legacy_decode", "SELECT DISTINCT p_brand AS class, CAST(l_orderkey AS VARCHAR) AS from_id, 'part' || l_partkey AS target, l_linenumber AS off, 'bytecode' AS kind FROM lineitem JOIN part ON l_partkey = p_partkey")
def legacy_decode(t):
    rows = line_refs(t).distinct().groupBy("class", "from").agg(F.to_json(F.collect_list(F.struct("from", "target", "offset"))).alias("refs"))
    rows = rows.select(F.col("class").alias("name"), "refs", F.lit(None).cast("array<string>").alias("ref_targets"))
    return references.decode_references(rows).select("class", F.col("from").alias("from_id"), "target", F.col("offset").alias("off"), "kind")


@query("alias_overlay", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 'alias_' || c_custkey END, c_name) AS shown FROM customer")
def alias_overlay(t):
    names = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    aliases = t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("alias_"), "c_custkey").alias("alias"))
    return references.with_alias(names, aliases).select("id", "shown")


@query("deobfuscate_names", "SELECT id, 'Class_' || (row_number() OVER (ORDER BY id)) AS alias, CASE WHEN length(name) > 64 THEN 'long name' ELSE 'invalid or non-ASCII identifier' END AS reason FROM (SELECT p_partkey AS k, printf('%012d', p_partkey) AS id, p_name AS name FROM part) WHERE NOT regexp_full_match(name, '[A-Za-z_$][A-Za-z0-9_$]*') OR length(name) > 64")
def deobfuscate_names(t):
    rows = t.part.select(F.format_string("%012d", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    return references.deobfuscate(rows, t.spark.createDataFrame([], "id string, alias string"))


@query("last_writer_wins", "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max(struct_pack(a := ts, b := event_id)).b AS event_id FROM events GROUP BY user_id")
def last_writer_wins(t):
    rows = t.events.select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    return references.latest(rows, "user_id", "at").select("user_id", "event_type", "event_id")


@query("token_resolution", "WITH s AS (SELECT p_type AS token, p_brand AS package, p_partkey AS id FROM part), g AS (SELECT token, count(*) AS n, min(id) AS one FROM s GROUP BY token), l AS (SELECT token, package, count(*) AS m, min(id) AS here FROM s GROUP BY token, package) SELECT token, package, CASE WHEN n = 1 THEN one WHEN m = 1 THEN here END AS id FROM l JOIN g USING (token)")
def token_resolution(t):
    rows = t.part.select(F.col("p_type").alias("name"), F.col("p_brand").alias("package"), F.col("p_partkey").alias("id"))
    return references.resolve_tokens(rows.select(F.col("name").alias("token"), "package").distinct(), rows)


@query("find_symbols", "SELECT c_custkey AS id, c_name AS shown FROM customer WHERE lower(c_name) LIKE '%12%' OR CAST(c_custkey AS VARCHAR) LIKE '%12%'")
def find_symbols(t):
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return references.find_symbols(rows, t.spark.createDataFrame([], "id string, alias string"), "12").select(F.col("id").cast("long").alias("id"), "shown")


def flow(t):
    """Control-flow edges: an order is a method, its lines are blocks; a returned line also jumps back or ahead."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("method"), F.col("l_linenumber").cast("long").alias("src"), "l_partkey", "l_returnflag")
    top = rows.groupBy("method").agg(F.max("src").alias("last"), F.min("src").alias("first"))
    ahead = rows.join(top, "method").where("src < last").select("method", "src", (F.col("src") + 1).alias("dst"))
    jump = rows.join(top, "method").where("l_returnflag = 'R'").select("method", "src", (F.col("first") + F.col("l_partkey") % (F.col("last") - F.col("first") + 1)).alias("dst"))
    return ahead.unionByName(jump).distinct()


def facts(t):
    """Slots: a line defines its supplier's slot and uses its part's."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("method"), F.col("l_linenumber").cast("long").alias("block"), "l_partkey", "l_suppkey")
    return rows.select("method", "block", (F.col("l_suppkey") % 4).alias("slot"), F.lit("def").alias("kind")).unionByName(rows.select("method", "block", (F.col("l_partkey") % 4).alias("slot"), F.lit("use").alias("kind"))).distinct()


@query("dominators")
def dominators(t):
    return dataflow.dominators(flow(t))


@query("dominance_frontiers")
def dominance_frontiers(t):
    return dataflow.frontiers(flow(t))


@query("natural_loops")
def natural_loops(t):
    return dataflow.loops(flow(t))


@query("liveness")
def liveness(t):
    return dataflow.liveness(flow(t), facts(t))


@query("reaching_defs")
def reaching_defs(t):
    return dataflow.reaching(flow(t), facts(t))


@query("phi_places")
def phi_places(t):
    return dataflow.phis(dataflow.frontiers(flow(t)), dataflow.liveness(flow(t), facts(t)), facts(t))


# Fields of a class for each size: one of each part that is to be renamed, one that keeps its name.
WORD = "split_part(p_name, ' ', 2)"
ENTRIES = f"SELECT concat('Lp/S', p_size, ';->f', p_partkey, ':I') AS id, p_size, concat({WORD}, '_', length(p_type)) AS name, concat({WORD}, '_', replace(p_brand, 'Brand#', '')) AS alias FROM part"


@query(
    "alias_replay",
    f"""WITH e AS ({ENTRIES}), kept AS (SELECT DISTINCT p_size, concat({WORD}, '_', p_size) AS word FROM part),
    old AS (SELECT p_size, name AS word, max(id) AS most FROM e GROUP BY 1, 2), fresh AS (SELECT p_size, alias AS word, min(id) AS least FROM e GROUP BY 1, 2)
    SELECT e.id, e.alias, CASE WHEN kept.word IS NOT NULL OR old.most > e.id OR fresh.least < e.id THEN 'name is taken in this scope' END AS error FROM e
    LEFT JOIN kept ON kept.p_size = e.p_size AND kept.word = e.alias LEFT JOIN old ON old.p_size = e.p_size AND old.word = e.alias LEFT JOIN fresh ON fresh.p_size = e.p_size AND fresh.word = e.alias""",
)
def alias_replay(t):
    word, owner = F.split_part("p_name", F.lit(" "), F.lit(2)), F.concat(F.lit("Lp/S"), "p_size", F.lit(";->"))
    fields = t.part.select(F.concat(owner, F.lit("f"), "p_partkey", F.lit(":I")).alias("id"), F.concat_ws("_", word, F.length("p_type")).alias("name"), F.concat_ws("_", word, F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("alias"))
    kept = t.part.select(F.concat(owner, F.lit("k"), "p_partkey", F.lit(":I")).alias("id"), F.concat_ws("_", word, "p_size").alias("name"))
    return renames.replay(fields.select("id", "name").unionByName(kept), fields.select("id", "alias"))


@query(
    "one_id_space",
    """WITH a AS (SELECT concat('c', c_nationkey) AS name FROM customer UNION SELECT concat('s', c_custkey) FROM customer), b AS (SELECT concat('c', s_nationkey) AS name FROM supplier UNION SELECT concat('s', s_suppkey) FROM supplier),
    ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS node_id FROM (SELECT name FROM a UNION SELECT name FROM b))
    SELECT x.node_id AS src_id, y.node_id AS dst_id, count(*) AS n FROM (SELECT concat('c', c_nationkey) AS u, concat('s', c_custkey) AS v FROM customer UNION ALL SELECT concat('c', s_nationkey), concat('s', s_suppkey) FROM supplier) e
    JOIN ids x ON x.name = e.u JOIN ids y ON y.name = e.v GROUP BY 1, 2""",
)
def one_id_space(t):
    """Customers and suppliers below their nations, as two inputs whose own ids clash."""
    inputs = []
    for rows, top, leaf, own in ((t.customer, "c_nationkey", "c_custkey", 0), (t.supplier, "s_nationkey", "s_suppkey", 1)):
        edges = rows.select((F.col(top) * 2 + own).alias("src_id"), (F.col(leaf) * 2 + 1 - own).alias("dst_id"))
        tops = rows.select((F.col(top) * 2 + own).alias("node_id"), F.concat(F.lit("c"), top).alias("name")).distinct()
        inputs.append((tops.unionByName(rows.select((F.col(leaf) * 2 + 1 - own).alias("node_id"), F.concat(F.lit("s"), leaf).alias("name"))), edges))
    _, edges = graph.one_id_space(inputs, ["name"])
    return edges.groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))
