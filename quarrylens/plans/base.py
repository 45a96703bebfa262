"""Registering of queries over the standard tables with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Suppliers' ids in the supply graph start here, so that they differ from customers'.
SUPPLIER_BASE = 10_000_000_000


class Tables:
    """The tables of a folder by attribute; only the columns a plan uses are read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def supply_edges(t: Tables) -> DataFrame:
    """(src_id, dst_id): customers and the suppliers that have delivered to them."""
    from quarrylens.operators.graph import distinct_edges

    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    rows = t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return distinct_edges(rows.select("o_custkey", (F.col("l_suppkey") + SUPPLIER_BASE).alias("sup")), "o_custkey", "sup")


EDGES = f"SELECT DISTINCT o_custkey AS src_id, l_suppkey + {SUPPLIER_BASE} AS dst_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
