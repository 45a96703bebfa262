"""A persistent index of texts by three-character grams: 128 longs a text, kept as columns and united by part.

Three tables, written once: `texts` and `grams` in the same parts, ranges of the key, and `unions` with the OR of all texts of a part. A gram is
one bit of one long, so a query reads only the few columns its grams are in. Searching goes from unions to grams to
texts; parts in which nothing can match are not opened. The index only leaves out: what it lets through is searched as any text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from quarrylens.functions.text import GRAM_BITS
from quarrylens.operators import search as lines
from quarrylens.sources.index_cache import IndexCache
from quarrylens.storage import materialise, small_or_plain

WORDS = GRAM_BITS // 64
#: Characters of text that a part holds about, and texts that may be picked one by one out of the parts.
PART_CHARS, PICKED = 64 << 20, 100_000
#: Lower-casing gives one or the other by what follows; grams take them for one.
FINAL_SIGMA, SIGMA = 0x3C2, 0x3C3


def gram_numbers(text: str) -> np.ndarray:
    """The gram of each window of three characters of a lower-cased text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[codes == FINAL_SIGMA] = SIGMA
    return (codes[:-2] * (251 * 251) + codes[1:-1] * 251 + codes[2:]) & (GRAM_BITS - 1)


@F.pandas_udf(ArrayType(LongType()))
def gram_words(lowered: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The bitmap of each text's grams as WORDS longs."""
    for texts in lowered:
        out = []
        for t in texts:
            bits = np.zeros(GRAM_BITS, bool)
            bits[gram_numbers(t or "")] = True
            out.append(np.packbits(bits, bitorder="little").view(np.int64))
        yield pd.Series(out, dtype="object")


def needed(spark, query: str, case: bool = False) -> dict[int, int]:
    """word -> mask of the bits that a text with the query must have; grams with white space say nothing, for masks put it there."""
    q = spark.sql("SELECT lower(:q)", args={"q": query}).first()[0] if case else query.lower()
    masks: dict[int, int] = {}
    for k, g in enumerate(gram_numbers(q).tolist()):
        if not any(c.isspace() for c in q[k : k + 3]):
            masks[g // 64] = masks.get(g // 64, 0) | 1 << g % 64
    return {w: m - (1 << 64) if m >> 63 else m for w, m in masks.items()}


def may_match(masks: dict[int, int]) -> Column:
    """Whether columns g0, g1, ... have all bits of the masks."""
    return reduce(Column.__and__, [F.col(f"g{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long") for w, m in sorted(masks.items())], F.lit(True))


def write(docs: DataFrame, path: str, key: str = "doc_id", body: str = "text", part_chars: int = PART_CHARS) -> None:
    """Write texts, grams and unions of (key, body) below a path. Rows of one key lie in one part; other columns stay out."""
    docs = docs.select(key, body)
    size = docs.agg(F.sum(F.length(body))).first()[0] or 0
    dealt = docs.repartitionByRange(max(1, -(-size // part_chars)), key).withColumn("part", F.spark_partition_id()).sortWithinPartitions(key)
    dealt.write.partitionBy("part").parquet(f"{path}/texts")
    texts = docs.sparkSession.read.schema(f"`{key}` {docs.schema[key].dataType.simpleString()}, `{body}` string, part int").parquet(f"{path}/texts")
    words = texts.select(key, "part", F.col(body).isNull().alias("missing"), gram_words(F.lower(body)).alias("g"))
    words.select(key, "part", "missing", *[F.get("g", F.lit(w)).alias(f"g{w}") for w in range(WORDS)]).write.partitionBy("part").parquet(f"{path}/grams")
    grams = docs.sparkSession.read.parquet(f"{path}/grams") if size else docs.sparkSession.createDataFrame([], f"part int, {', '.join(f'g{w} long' for w in range(WORDS))}")
    grams.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.bit_or(f"g{w}").alias(f"g{w}") for w in range(WORDS)]).coalesce(1).write.parquet(f"{path}/unions")


class GramIndex:
    """The tables of a written index; parts_read and texts_read say what the last search let through."""

    def __init__(self, tables: dict[str, DataFrame], key: str = "doc_id", body: str = "text"):
        self.texts, self.grams, self.unions, self.key, self.body = tables["texts"], tables["grams"], tables["unions"], key, body
        self.keys: DataFrame | None = None
        self.parts_read: list[int] = []
        self.texts_read = 0

    def only(self, keys: DataFrame) -> GramIndex:
        """The same index for the texts of some keys (one column)."""
        part = GramIndex({"texts": self.texts, "grams": self.grams, "unions": self.unions}, self.key, self.body)
        part.keys = materialise(keys.toDF("__key").distinct(), "keys")
        return part

    @classmethod
    def of(cls, docs: DataFrame, key: str = "doc_id", body: str = "text", cache: IndexCache | None = None, part_chars: int = PART_CHARS) -> GramIndex:
        """The index of docs, as read from files; built if the cache has none for these files."""
        cache = cache or IndexCache(docs.sparkSession)
        options = {"kind": "grams", "key": key, "body": body, "part_chars": part_chars}
        return cls(cache.get_or_build([docs], options, lambda path: write(docs, path, key, body, part_chars)), key, body)

    def parts(self, masks: dict[int, int]) -> list[tuple[int, int]]:
        """(part, texts that may match) of parts where something may, in order. A row for each part comes to the driver."""
        able = [r["part"] for r in self.unions.where(may_match(masks)).select("part").collect()]
        if not able or not masks:
            return sorted((r["part"], r["n"]) for r in self.unions.select("part", "n").collect() if not masks)
        rows = self.grams.where(F.col("part").isin(able) & may_match(masks)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        return sorted((r["part"], r["n"]) for r in rows.collect())

    def candidates(self, parts: list[tuple[int, int]], masks: dict[int, int]) -> DataFrame:
        """(key, body) of the parts. Few texts are picked by key; of many the parts are read whole, so that no text is shuffled."""
        numbers = [p for p, _ in parts]
        rows = self.texts.where(F.col("part").isin(numbers))
        if self.keys is not None:
            rows = rows.join(small_or_plain(self.keys), F.col(self.key) == F.col("__key"), "left_semi")
        if masks and sum(n for _, n in parts) <= PICKED:
            picked = self.grams.where(F.col("part").isin(numbers) & may_match(masks)).select(F.col(self.key).alias("__picked")).distinct()
            rows = rows.join(F.broadcast(picked), F.col(self.key).eqNullSafe(F.col("__picked")), "left_semi")
        return rows.drop("part")

    def search(self, query: str, regex: bool = False, case: bool = False, code: bool = True, comments: bool = True, limit: int | None = 1000) -> DataFrame:
        """Hits as search.search gives them, in order of key and line.

        With a limit parts are searched in order, four times as many each time, until it is full; later parts are not read.
        """
        masks = {} if regex or not query else needed(self.texts.sparkSession, query, case)
        parts, found = self.parts(masks), None
        self.parts_read, self.texts_read, step = [], 0, 1
        options = {"regex": regex, "case": case, "code": code, "comments": comments, "key": self.key, "body": self.body}
        if limit is None or not parts:
            self.parts_read, self.texts_read = [p for p, _ in parts], sum(n for _, n in parts)
            return lines.search(self.candidates(parts, masks), query, limit=limit, **options)
        while parts and limit > 0:
            now, parts = parts[:step], parts[step:]
            self.parts_read += [p for p, _ in now]
            self.texts_read += sum(n for _, n in now)
            hits = materialise(lines.search(self.candidates(now, masks), query, limit=limit, **options), "hits")
            limit, step = limit - hits.count(), step * 4
            found = hits if found is None else found.unionByName(hits)
        return found

    def counters(self, query: str, case: bool = False) -> dict[str, int]:
        """scanned, missing and rejected texts of a literal query, from the index alone."""
        missing, fits = F.col("missing"), may_match(needed(self.texts.sparkSession, query, case))
        row = self.grams.agg(F.count_if(~missing & fits).alias("scanned"), F.count_if(missing).alias("missing"), F.count_if(~missing & ~fits).alias("rejected")).first()
        return row.asDict()
