"""Line search over documents: literal or regular expression, code or comments, pruned by grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.functions import text as texts

CROP_BEFORE, CROP = 200, 1200


def explode_lines(docs: DataFrame, key: str = "doc_id", body: str = "text", shown: str | None = None) -> DataFrame:
    """(key, line_no from 1, line, searchable): shown holds the masked body if it differs."""
    both = F.arrays_zip(texts.lines(F.col(body)).alias("line"), texts.lines(F.col(shown or body)).alias("searchable"))
    return docs.select(key, F.posexplode(both).alias("n", "l")).select(key, (F.col("n") + 1).cast("int").alias("line_no"), "l.line", "l.searchable")


def gram_index(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, grams): the sorted grams of each document, to be written beside the text and used by prune."""
    return docs.select(key, F.sort_array(texts.gram_bits(F.col(body))).alias("grams"))


def prune(docs: DataFrame, grams: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """Documents that may hold a literal query; never drops one that does. Short queries prune nothing."""
    need = texts.query_grams(query)
    if not need:
        return docs
    return docs.join(grams.where(F.size(F.array_intersect("grams", F.array(*[F.lit(g).cast("long") for g in need]))) == len(need)).select(key), key, "left_semi")


def check_expression(spark, pattern: str) -> None:
    """Raises ValueError if the engine that will run an expression does not take it; nothing runs on the executors."""
    try:
        spark.sql("SELECT '' RLIKE :p", args={"p": pattern}).collect()
    except Exception as e:
        raise ValueError(f"invalid expression (unterminated or malformed): {pattern}") from e


def first_match(line: Column, query: str, regex: bool, case: bool) -> tuple[Column, Column]:
    """Column (from 1, 0 for none) and length of the first match in a line."""
    if regex:
        pattern = query if case else f"(?i){query}"
        found = F.regexp_substr(line, F.lit(pattern))
        return F.when(found.isNull(), 0).otherwise(F.regexp_instr(line, F.lit(pattern))), F.coalesce(F.length(found), F.lit(0))
    where = F.instr(line, query) if case else F.instr(F.lower(line), query.lower())
    return where, F.lit(len(query))


def search(docs: DataFrame, query: str, regex: bool = False, case: bool = False, code: bool = True, comments: bool = True, limit: int | None = 1000, grams: DataFrame | None = None, package: Column | None = None, key: str = "doc_id", body: str = "text") -> DataFrame:
    """One hit for each matching line: (key, line_no, column, length, line_occurrence, text).

    line_occurrence numbers equal lines of a document over all its lines. An empty query gives no hits, an invalid expression raises.
    With a limit the first hits in order of (key, line_no) come back.
    """
    if regex:
        check_expression(docs.sparkSession, query)
    docs = docs.where(package) if package is not None else docs
    if grams is not None and not regex:
        docs = prune(docs, grams, query, key)
    docs = docs.where(F.col(body).isNotNull() & F.lit(bool(query)))
    if not regex and query and not any(c.isspace() for c in query):
        # The whole text is tested before it is cut into lines; a masked text matches only where the raw one does.
        docs = docs.where(F.col(body).contains(query) if case else F.lower(body).contains(query.lower()))
    docs = docs.select(key, body, texts.masked(F.col(body), code, comments).alias("__shown")) if not (code and comments) else docs.select(key, body)
    rows = explode_lines(docs, key, body, None if code and comments else "__shown")
    rows = rows.withColumn("line_occurrence", (F.row_number().over(Window.partitionBy(key, F.xxhash64("line"), "line").orderBy("line_no")) - 1).cast("int"))
    at, length = first_match(F.col("searchable"), query, regex, case)
    rows = rows.withColumn("column", at.cast("int")).withColumn("length", length.cast("int")).where("column > 0")
    start = F.greatest(F.lit(1), F.col("column") - CROP_BEFORE)
    hits = rows.select(key, "line_no", "column", "length", "line_occurrence", F.substring(F.col("line"), start, F.lit(CROP)).alias("text"))
    return hits.orderBy(key, "line_no").limit(limit) if limit is not None else hits


def truncated(hits: DataFrame, limit: int) -> bool:
    """Whether a limited result reached its limit, also when it fits exactly."""
    return hits.count() >= limit


def counters(docs: DataFrame, grams: DataFrame, query: str, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(scanned, missing, rejected): documents looked at, without text, and left out by the grams."""
    need = texts.query_grams(query)
    fits = F.size(F.array_intersect("grams", F.array(*[F.lit(g).cast("long") for g in need]))) == len(need) if need else F.lit(True)
    rows = docs.join(grams, key, "left").select(F.col(body).isNull().alias("missing"), (~fits).alias("rejected"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(one(~F.col("missing") & ~F.coalesce("rejected", F.lit(False))).alias("scanned"), one(F.col("missing")).alias("missing"), one(~F.col("missing") & F.coalesce("rejected", F.lit(False))).alias("rejected"))


def filter_rows(rows: DataFrame, query: str) -> DataFrame:
    """Rows with the text in any column, without regard to case."""
    any_column = F.concat_ws("\x00", *[F.col(c).cast("string") for c in rows.columns])
    return rows.where(F.lower(any_column).contains(query.lower()))
