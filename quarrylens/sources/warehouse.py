"""A warehouse of call graphs: bucketed tables that grow by appends and join without a shuffle.

Edges are kept twice, bucketed by their start and by their end, and nodes by id, all with the same number of buckets. What asks by either end, or joins nodes,
reads buckets side by side. Every append counts what it has added against the tables and raises if they disagree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens.storage import materialise, shared_dir


class Warehouse:
    """Tables <name>_nodes (node_id, ...), <name>_by_src and <name>_by_dst (src_id, dst_id) in a folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.path = (path or f"{shared_dir(spark)}/warehouse").rstrip("/")

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def _append(self, rows: DataFrame, part: str, key: str) -> None:
        table = f"{self.name}_{part}"
        # Dealt by key first, so that each bucket gets one file of this append.
        dealt = rows.repartition(self.buckets, key)
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{table}").saveAsTable(table)

    def append(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """Add nodes and edges that are not there yet (by node_id, by both ends); the counts afterwards.

        Running it again with the same rows, as after a lost driver, adds nothing.
        """
        nodes, edges = nodes.dropDuplicates(["node_id"]), edges.select("src_id", "dst_id").distinct()
        had = self.sizes()
        for rows, part, keys in ((nodes, "nodes", ["node_id"]), (edges, "by_src", ["src_id", "dst_id"]), (edges, "by_dst", ["dst_id", "src_id"])):
            fresh = rows.join(self.table(part).select(*keys), keys, "left_anti") if part in had else rows
            fresh = materialise(fresh.select(rows.columns), "append")
            self._append(fresh, part, keys[0])
            added, now = fresh.count(), self.table(part).count()
            if now != had.get(part, 0) + added:
                raise RuntimeError(f"{self.name}_{part} has {now} rows after {added} were added to {had.get(part, 0)}")
        if self.table("by_src").count() != self.table("by_dst").count():
            raise RuntimeError(f"{self.name}: the two copies of the edges differ")
        return self.counts()

    def sizes(self) -> dict[str, int]:
        return {p: self.table(p).count() for p in ("nodes", "by_src", "by_dst") if self.spark.catalog.tableExists(f"{self.name}_{p}")}

    def counts(self) -> DataFrame:
        """(relation, n) of nodes and edges."""
        one = lambda part, shown: self.table(part).agg(F.count(F.lit(1)).alias("n")).select(F.lit(shown).alias("relation"), "n")
        return one("nodes", "nodes").unionByName(one("by_src", "edges"))

    def degrees(self) -> DataFrame:
        """(node_id, n_out, n_in) of every node that has an edge; no shuffle."""
        out = self.table("by_src").groupBy(F.col("src_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
        into = self.table("by_dst").groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_out", "n_in")]
        return out.hint("merge").join(into, "node_id", "full").select("node_id", *zero)

    def callees(self) -> DataFrame:
        """(src_id, node columns): every edge with the node it leads to; no shuffle."""
        nodes = self.table("nodes")
        return self.table("by_dst").hint("merge").join(nodes, F.col("dst_id") == F.col("node_id")).select("src_id", *nodes.columns)

    def drop(self) -> None:
        for p in ("nodes", "by_src", "by_dst"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{p}")
