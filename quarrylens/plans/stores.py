"""Call graphs in bucketed tables, and class indexes in snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylens.plans.base import EDGES, SUPPLIER_BASE, query, supply_edges
from quarrylens.sources import snapshot
from quarrylens.sources.warehouse import Warehouse
from quarrylens.storage import shared_dir

BUCKETS = 8


def warehouse(t) -> Warehouse:
    """Suppliers first, then customers and all edges again: the second append overlaps the first."""
    store, edges = Warehouse(t.spark, f"calls_{uuid.uuid4().hex}", BUCKETS), supply_edges(t)
    suppliers = t.supplier.select((F.col("s_suppkey") + SUPPLIER_BASE).alias("node_id"), F.col("s_name").alias("name"))
    customers = t.customer.select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("name"))
    store.append(suppliers, edges.where(F.col("dst_id") % 2 == 0))
    store.append(suppliers.unionByName(customers), edges)
    return store


@query("warehouse_counts", f"SELECT 'nodes' AS relation, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'edges', count(*) FROM ({EDGES})")
def warehouse_counts(t):
    return warehouse(t).counts()


@query("warehouse_degree", f"WITH e AS ({EDGES}) SELECT node_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src_id AS node_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst_id, 0, 1 FROM e) GROUP BY node_id")
def warehouse_degree(t):
    return warehouse(t).degrees()


@query("warehouse_callees", f"SELECT src_id, dst_id AS node_id, s_name AS name FROM ({EDGES}) JOIN supplier ON dst_id = s_suppkey + {SUPPLIER_BASE}")
def warehouse_callees(t):
    return warehouse(t).callees()


def class_index(t):
    """A class of each part, whose members are its lines."""
    member = F.struct(F.concat(F.lit("m"), "l_orderkey").alias("id"), F.col("l_linenumber").alias("flags"))
    members = t.lineitem.groupBy("l_partkey").agg(F.sort_array(F.collect_list(member)).alias("methods"))
    rows = t.part.join(members, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select(F.format_string("p/C%09d", "p_partkey").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("flags"), (F.col("p_size") % 2 == 0).alias("inner"), "methods")


@query("snapshot_directory", "SELECT printf('p/C%09d', p_partkey) AS name, p_type AS kind, p_size AS flags, p_size % 2 = 0 AS inner FROM part")
def snapshot_directory(t):
    path = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write(class_index(t), path)
    return snapshot.read(t.spark, path, "directory")


@query("snapshot_members", "SELECT printf('p/C%09d', p_partkey) AS name, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def snapshot_members(t):
    path = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write(class_index(t), path)
    return snapshot.read(t.spark, path).select("name", F.coalesce(F.array_size("methods"), F.lit(0)).cast("long").alias("n"))
