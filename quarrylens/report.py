"""The analysis report: eleven questions about an analysed program, as one small table, rendered as Markdown or HTML."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

#: Labels of the counts, in order of the report. Fixed values.
COUNTS = ["Java methods", "Call edges", "Native libraries", "Native exports", "Native references", "Native imports", "Native entries"]
SECTIONS = {"overview": "Overview", "node types": "Methods by kind", "libraries": "Libraries with most exports", "exports": "Exported symbols", "urls": "URLs"}
LIBRARIES, EXPORTS, URLS = 10, 200, 50


def sections(nodes: DataFrame, edges: DataFrame, exports: DataFrame, xrefs: DataFrame, imports: DataFrame, entries: DataFrame, strings: DataFrame) -> DataFrame:
    """(section, place, label, value): seven counts, methods by type, the libraries with most exports, exported symbols, URLs.

    nodes: (node_type); exports: (so_name, name); strings: (str, is_url). The lists are the first of a total order, so they don't change from run to run;
    each is cut where its rows are, and only so many reach the driver when the report is rendered.
    """
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("overview").alias("section"), F.lit(k).alias("place"), F.lit(COUNTS[k]).alias("label"), F.col("n").cast("string").alias("value"))
    parts = [count(df, k) for k, df in enumerate([nodes, edges, exports.select("so_name").where("so_name is not null").distinct(), exports, xrefs, imports, entries])]
    kinds = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    parts.append(listed(kinds, "node types", ["node_type"], F.col("node_type"), F.col("n"), None))
    libraries = exports.groupBy("so_name").agg(F.count(F.lit(1)).alias("n"))
    parts.append(listed(libraries, "libraries", [F.desc("n"), "so_name"], F.col("so_name"), F.col("n"), LIBRARIES))
    parts.append(listed(exports, "exports", ["so_name", "name"], F.col("so_name"), F.col("name"), EXPORTS))
    urls = strings.where("is_url").select("str").distinct()
    parts.append(listed(urls, "urls", ["str"], F.col("str"), F.lit(""), URLS))
    return reduce(DataFrame.unionByName, parts)


def listed(rows: DataFrame, section: str, order: list, label, value, most: int | None) -> DataFrame:
    """The first rows in an order with their place from 0; without `most` all rows, of which there must be few."""
    first = rows.orderBy(*order).limit(most if most is not None else 1000)
    place = F.row_number().over(Window.orderBy(*order)) - 1  # over the few rows that the limit lets through
    return first.select(F.lit(section).alias("section"), place.alias("place"), label.cast("string").alias("label"), value.cast("string").alias("value"))


def rendered(table: DataFrame, title: str, permissions: list[str] | None = None) -> tuple[str, str]:
    """(Markdown, HTML) of a report table and a list of permissions."""
    rows = sorted(table.collect(), key=lambda r: r["place"])
    mark, page = [f"# {title}", ""], [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    own = {s: [(r["label"], r["value"]) for r in rows if r["section"] == s] for s in SECTIONS}
    own["permissions"] = [(p, "") for p in permissions or []]
    for key, name in {**SECTIONS, "permissions": "Permissions"}.items():
        if not own[key]:
            continue
        cell = lambda v: (v or "").replace("|", "\\|").replace("\n", " ")
        mark += [f"## {name}", "", "| | |", "| --- | --- |", *(f"| {cell(a)} | {cell(b)} |" for a, b in own[key]), ""]
        page.append(f"<h2>{name}</h2><table>{''.join(f'<tr><td>{html.escape(a or '')}<td>{html.escape(b or '')}' for a, b in own[key])}</table>")
    return "\n".join(mark), "\n".join(page)
