"""Report, paging, window and set queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarrylens.operators import lookups, references
from quarrylens.plans.base import query

TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("overview_counts", " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS cnt FROM {n}" for n in TABLES))
def overview_counts(t):
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(n).alias("relation"), "cnt") for n in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("distinct_libraries", "SELECT count(DISTINCT l_suppkey) AS cnt FROM lineitem")
def distinct_libraries(t):
    return t.lineitem.agg(F.countDistinct("l_suppkey").alias("cnt"))


@query("type_histogram", "SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type ORDER BY event_type")
def type_histogram(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt")).orderBy("event_type")


@query("top10_by_count", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def top10_by_count(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("exports_page", "SELECT p_partkey, p_name FROM part ORDER BY p_brand, p_partkey LIMIT 200")
def exports_page(t):
    return references.page(t.part.select("p_brand", "p_partkey", "p_name"), ["p_brand", "p_partkey"], 0, 200).select("p_partkey", "p_name")


@query("page_clamped", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 1000 OFFSET 50")
def page_clamped(t):
    return references.page(t.customer.select("c_custkey", "c_name"), ["c_name", "c_custkey"], 50, 5000)


@query("class_units", "SELECT p_brand, CAST(sum(l_linenumber) AS BIGINT) AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def class_units(t):
    return t.lineitem.select("l_partkey", "l_linenumber").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_linenumber").alias("units"))


@query("setops_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def setops_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("setops_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def setops_intersect(t):
    part = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return part("R").intersect(part("A"))


@query("setops_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def setops_except(t):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.where("l_discount > 0.05").select("l_partkey"))


@query("setops_except_all", "SELECT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1 EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_linenumber = 2")
def setops_except_all(t):
    part = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select(F.col("l_suppkey").alias("k"))
    return part(1).exceptAll(part(2))


PRICE = "CAST(round(sum(l_extendedprice), 2) AS DOUBLE) AS total, count(*) AS n"


def priced(df):
    return df.agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("rollup", f"SELECT l_returnflag, l_linestatus, {PRICE} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return priced(t.lineitem.rollup("l_returnflag", "l_linestatus"))


@query("cube", f"SELECT l_returnflag, l_linestatus, {PRICE} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return priced(t.lineitem.cube("l_returnflag", "l_linestatus"))


@query("grouping_sets", f"SELECT l_returnflag, l_linenumber, {PRICE} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
def grouping_sets(t):
    c = [F.col("l_returnflag"), F.col("l_linenumber")]
    return priced(t.lineitem.groupingSets([[c[0]], [c[1]], []], *c))


@query("aggregate_filter", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, max(l_quantity) FILTER (WHERE l_discount = 0) AS top FROM lineitem GROUP BY l_suppkey")
def aggregate_filter(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"), F.max(F.when(F.col("l_discount") == 0, F.col("l_quantity"))).alias("top"))


@query("ordered_set_median", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS med FROM lineitem GROUP BY l_returnflag")
def ordered_set_median(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("med"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("full_outer", "SELECT c.k AS ck, s.k AS sk, c.n AS cn, s.n AS sn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s ON c.k = s.k")
def full_outer(t):
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("ck")).agg(F.count(F.lit(1)).alias("cn"))
    s = t.supplier.where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("sk")).agg(F.count(F.lit(1)).alias("sn"))
    return c.join(s, F.col("ck") == F.col("sk"), "full").select("ck", "sk", "cn", "sn")


@query("contains_bridge", "SELECT n_name, s_suppkey FROM supplier JOIN nation ON contains(s_name, CAST(n_nationkey AS VARCHAR))")
def contains_bridge(t):
    keys = t.nation.select("n_name", F.col("n_nationkey").cast("string").alias("key"))
    return references.names_containing(t.supplier.select("s_suppkey", "s_name"), "s_name", keys, "key").select("n_name", "s_suppkey")


@query("lateral_top", "SELECT c_custkey, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def lateral_top(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.row_number().over(w).alias("rn")).where("rn <= 2").drop("rn")


@query("rank_frames", "SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS q, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS before, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS after, count(*) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY CAST(floor(s_acctbal / 1000) AS BIGINT))")
def rank_frames(t):
    w = Window.partitionBy("s_nationkey").orderBy(F.floor(F.col("s_acctbal") / 1000))
    k = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return t.supplier.select("s_suppkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(k).alias("q"), F.lag("s_suppkey").over(k).alias("before"), F.lead("s_suppkey").over(k).alias("after"), F.count(F.lit(1)).over(k.rowsBetween(-2, 0)).alias("c3"))


@query("range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS recent FROM orders")
def range_frame(t):
    w = Window.partitionBy("o_custkey").orderBy(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")).rangeBetween(-30 * 86_400_000_000, 0)
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(w).alias("recent"))


@query("occurrence_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def occurrence_index(t):
    return lookups.occurrence(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"], "occurrence").select("event_id", F.col("occurrence").cast("long").alias("occurrence"))


@query("enclosing_decl", "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS enclosing FROM events")
def enclosing_decl(t):
    rows = t.events.select("event_id", "user_id", "event_type")
    return lookups.last_before(rows, ["user_id"], "event_id", F.when(F.col("event_type") == "click", F.col("event_id")), "enclosing").select("event_id", "enclosing")


@query("next_decl", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events")
def next_decl(t):
    return lookups.next_start(t.events.select("event_id", "user_id"), ["user_id"], "event_id", "next_id").select("event_id", "next_id")


@query("asof_last_event", "SELECT e.event_id, p.event_id AS last_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e LEFT JOIN LATERAL (SELECT event_id, value FROM events q WHERE q.event_type = 'purchase' AND q.user_id = e.user_id AND q.ts <= e.ts ORDER BY q.ts DESC, q.event_id DESC LIMIT 1) p ON TRUE")
def asof_last_event(t):
    left = t.events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_id"), F.col("value").alias("last_value"))
    out = lookups.asof_join(left, right, ["user_id"], "ts", ["last_id", "last_value"], ["last_id"], slice_of=F.date_trunc("week", "ts"))
    return out.select("event_id", "last_id", "last_value")


@query("range_lookup", "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice BETWEEN abs(s_acctbal) * 50 AND abs(s_acctbal) * 50 + 400")
def range_lookup(t):
    points = t.orders.select("o_orderkey", F.col("o_totalprice").alias("at"))
    ranges = t.supplier.select("s_suppkey", (F.abs("s_acctbal") * 50).alias("start"), (F.abs("s_acctbal") * 50 + 400).alias("end"))
    points = points.withColumn("pt", F.floor("at").cast("long"))
    ranges = ranges.withColumns({"lo": F.col("start"), "hi": F.col("end"), "start": F.floor("start").cast("long"), "end": F.ceil("end").cast("long")})
    return lookups.in_range(points, ranges, "pt", 1000).where("at between lo and hi").select("o_orderkey", "s_suppkey")


@query("evict_oldest", "SELECT o_orderkey FROM (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS s FROM orders) WHERE s > 100000000")
def evict_oldest(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("size"))
    return lookups.evict_oldest(rows, ["o_orderdate", "o_orderkey"], "size", 100_000_000).select("o_orderkey")


@query("split_merge", "SELECT CASE WHEN n = 1 THEN name ELSE 'split-data/' || split || '/' || name END AS name, split FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY split = 'base' DESC, split) AS n FROM (SELECT DISTINCT p_type || CASE WHEN p_size % 5 = 0 THEN '.dex' ELSE '.txt' END AS name, CASE WHEN p_size < 10 THEN 'base' ELSE p_brand END AS split FROM part)) WHERE n = 1 OR regexp_matches(name, '\\.dex$')")
def split_merge(t):
    from quarrylens.sources.archives import merge_splits

    rows = t.part.select(F.concat("p_type", F.when(F.col("p_size") % 5 == 0, ".dex").otherwise(".txt")).alias("name"), F.when(F.col("p_size") < 10, "base").otherwise(F.col("p_brand")).alias("split")).distinct()
    return merge_splits(rows.withColumns({"is_base": F.col("split") == "base", "size": F.lit(0).cast("long"), "source_path": F.col("split")})).select("name", "split")


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_tumbling(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


@query("event_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s")
def event_session(t):
    return t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "n")
