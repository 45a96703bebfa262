"""Call sites that name their target through method handles, as lambdas do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Kinds of method handles that call something; the others read or write fields. Fixed values of the file format.
CALLING = {"invoke_static": 4, "invoke_instance": 5, "invoke_constructor": 6, "invoke_direct": 7, "invoke_interface": 8}


def resolve_call_sites(sites: DataFrame, values: DataFrame, handles: DataFrame, methods: DataFrame, lambdas: DataFrame) -> DataFrame:
    """(site, method, how): the method behind each call site, one row a site.

    Of a site's values in order the first handle on a known lambda body counts, else the first handle on any method, else the site stands
    for itself under the name invoke-custom@site. how says which: lambda, handle or placeholder.

    sites: (site); values: (site, place, handle), null for values of other kinds; handles: (handle, kind, method); methods and lambdas: (method).
    The ranks meet in one aggregation with map-side combine, so a method behind a third of all sites is no hot key of a window.
    """
    calls = handles.where(F.col("kind").between(min(CALLING.values()), max(CALLING.values()))).select("handle", "method")
    calls = calls.join(methods.select("method").distinct(), "method", "left_semi")
    bodies = lambdas.select("method").distinct().withColumn("body", F.lit(True))
    calls = calls.join(bodies, "method", "left").select("handle", "method", F.coalesce("body", F.lit(False)).alias("body"))
    ranked = values.where("handle is not null").join(calls, "handle").select("site", "method", "body", F.struct((~F.col("body")).alias("later"), "place").alias("order"))
    best = ranked.groupBy("site").agg(F.min_by(F.struct("method", "body"), "order").alias("b"))
    how = F.when(F.col("b").isNull(), "placeholder").when(F.col("b.body"), "lambda").otherwise("handle")
    return sites.select("site").distinct().join(best, "site", "left").select("site", F.coalesce(F.col("b.method").cast("string"), F.concat(F.lit("invoke-custom@"), F.col("site").cast("string"))).alias("method"), how.alias("how"))


def call_edges(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(caller, callee) once each: calls (caller, site) through their call sites."""
    return calls.join(resolved.select("site", F.col("method").alias("callee")), "site").select("caller", "callee").distinct()
