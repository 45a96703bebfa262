"""Readers and writers of the exchanged relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylens import schemas
from quarrylens.functions.names import address
from quarrylens.functions.text import clean_csv_text


def read_csv(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Delimited text with declared types; malformed rows are left out."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep, quote='"', escape='"', mode="DROPMALFORMED")


def call_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four call-graph relations of a folder; a null node type is 0 and edges are distinct."""
    nodes = read_csv(spark, f"{folder}/call_graph_node.csv", schemas.CALL_GRAPH_NODE)
    nodes = nodes.select(F.col("id").alias("node_id"), F.col("method").alias("method_raw"), F.coalesce(F.col("type").cast("long"), F.lit(0)).alias("node_type"), F.coalesce("api_type", F.lit(0)).alias("api_type"))
    edges = read_csv(spark, f"{folder}/call_graph_edge.csv", schemas.CALL_GRAPH_EDGE).distinct()
    strings = read_csv(spark, f"{folder}/string_node.csv", schemas.STRING_NODE)
    links = read_csv(spark, f"{folder}/string_edge.csv", schemas.STRING_EDGE).select(F.col("src_id").alias("string_id"), F.col("dst_id").alias("method_id")).distinct()
    return {"java_cg_nodes": nodes, "java_cg_edges": edges, "string_nodes": strings, "string_edges": links}


def native_library(spark: SparkSession, folder: str, so_name: str) -> dict[str, DataFrame]:
    """The relations of one native library; addresses may be decimal or hexadecimal. Entries keep all eight columns."""
    kinds = {
        "native_exports": (".exports", schemas.NATIVE_EXPORTS, "\t"),
        "native_entries": (".entries", schemas.NATIVE_ENTRIES, "\t"),
        "native_func_xref": (".func_xref", schemas.NATIVE_FUNC_XREF, "\t"),
        "native_imports": (".imports", schemas.NATIVE_IMPORTS, ","),
        "native_pc_xrefs": (".pc_xrefs", schemas.NATIVE_PC_XREFS, ","),
    }
    out = {}
    for name, (suffix, schema, sep) in kinds.items():
        rows = spark.read.csv(f"{folder}/{so_name}{suffix}", schema=schema, sep=sep, mode="PERMISSIVE")
        numbers = {c: address(F.trim(c)) for c in rows.columns if c.endswith(("addr", "address", "pc"))}
        rows = rows.withColumns(numbers).withColumns({c: F.coalesce(c, F.lit("")) for c in rows.columns if c == "descriptor"})
        out[name] = rows.where(" and ".join(f"{c} is not null" for c in list(numbers)[:1])).select(F.lit(so_name).alias("so_name"), "*")
    return out


def class_index(spark: SparkSession, path: str, names_only: bool = False) -> DataFrame:
    """JSON Lines of classes. One bad line fails the read; names_only reads the directory columns alone."""
    text = spark.read.text(path).where("trim(value) <> ''")
    keep = "name string, flags int, kind string, inner boolean" if names_only else schemas.CLASS_INDEX
    rows = text.select(F.from_json("value", keep, {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.*")


def write_csv(df: DataFrame, path: str) -> None:
    """Everything quoted, quotes doubled, control characters as spaces."""
    texts = {f.name: clean_csv_text(F.col(f.name)) for f in df.schema.fields if f.dataType.simpleString() == "string"}
    df.withColumns(texts).write.csv(path, header=True, quoteAll=True, escape='"', mode="overwrite")


def write_class_index(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON Lines; with an order column the files' order and the lines in them follow it."""
    (df.repartitionByRange(order).sortWithinPartitions(order).drop(order) if order else df).write.json(path, mode="overwrite")
