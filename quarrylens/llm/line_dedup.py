"""Repeated lines: which lines of each document stay, as compressed bitmaps.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least MIN_CHARS code points that
at least MIN_DOCS documents hold stay only in the document with the largest id.

Method: (hash, document, position) of each such line is range-partitioned by hash and sorted by document, last id first, and position;
one pass over the sorted rows sees the first occurrence of each hash and numbers its documents. Only rows that go leave
that pass, and come back as bitmaps: of each document the 64-line words in which some line goes, with the bits of the lines that stay.
A hash is 128 bits wide: two different keys are taken for one with a chance below n * n / 2^129.

Hot keys: hashes are counted by their first 20 bits, combined before the shuffle. What exceeds 1/65536 of all rows is dealt into
that many slices by document, each sorted and passed on its own; one row for each hash and slice then gives the
hash's last document and number of documents. The table of such prefixes has at most 65,536 rows, whatever the input.

Defined cases: null and empty texts are one empty line; a null id is one document, before all others; rows with one id are one document
(all its rows keep the lines it keeps) and each gets its own bitmap by its text; repeated rows have equal bitmaps;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.llm.common import ascii_lower, hash_pair, materialise, table

#: White space that a key doesn't count: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Hashes are counted by this many leading bits; rows of a prefix beyond 1 / SLICES of all are dealt out.
PREFIX_BITS, SLICES = 20, 1 << 16


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_mark(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, mark, pos): the hash of every line long enough to count."""
    lines = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), F.posexplode(split_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
    keys = lines.select("doc_id", "mark", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(*hash_pair("key"), "doc_id", "mark", "pos")


def dropped(seen: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, mark, pos) of the lines that go. seen: occurrences, materialised."""
    share = -(-seen.count() // SLICES) or 1
    prefix = F.shiftright("h1", 64 - PREFIX_BITS)
    hot = seen.groupBy(prefix.alias("prefix")).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("slices")).where("slices > 1")
    dealt = seen.withColumn("prefix", prefix).join(F.broadcast(hot), "prefix", "left")
    dealt = dealt.select("h1", "h2", "doc_id", "mark", "pos", F.coalesce(F.pmod(F.xxhash64("doc_id"), "slices") + 1, F.lit(0)).cast("int").alias("slice"))
    group = Window.partitionBy("h1", "h2", "slice")
    last_first = F.desc_nulls_last("doc_id")
    passed = dealt.repartitionByRange("h1", "h2", "slice").withColumn("place", F.row_number().over(group.orderBy(last_first, "mark", "pos")))
    passed = passed.withColumn("rank", F.dense_rank().over(group.orderBy(last_first))).withColumn("n", F.max("rank").over(group))
    goes = (F.col("n") >= min_docs) & (F.col("rank") > 1)
    left = materialise(passed.where((F.col("slice") > 0) | goes).drop("rank"), "passed")

    # Of a hot hash one row for each slice meets the hash's own row, and the slices' rows meet theirs: no join has a hot key.
    slices = left.where("slice > 0 and place = 1").select("h1", "h2", "slice", "n", F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id").alias("whole"))
    of_hash = slices.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("whole").alias("last")).where(F.col("n") >= min_docs)
    last = slices.select("h1", "h2", "slice").join(of_hash.select("h1", "h2", F.col("last.doc_id").alias("last")), ["h1", "h2"])
    cut = left.where("slice > 0").join(last, ["h1", "h2", "slice"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return left.where("slice = 0").select("doc_id", "mark", "pos").unionByName(cut.select("doc_id", "mark", "pos"))


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, mark, n_dropped, keep): keep has (word, bits) of each run of 64 lines that loses some; bit i stands for line 64 * word + i.

    Documents that keep all their lines have no row.
    """
    gone = dropped(materialise(occurrences(docs, min_chars), "lines"), min_docs)
    words = gone.groupBy("doc_id", "mark", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)))).alias("gone"))
    keep = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))
    return words.groupBy("doc_id", "mark").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), keep.alias("keep"))


def words_of(keep: Column) -> Column:
    """The bitmap as one long for each 64 lines, up to the last that loses some."""
    before = lambda i: F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
    return F.flatten(F.transform(keep, lambda k, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), k["word"] - before(i) - 1), F.array(k["bits"]))))


def kept_text(text: Column, words: Column) -> Column:
    """The lines of a text that stay, joined again; words as words_of gives them, null if nothing goes."""
    stays = lambda _, i: F.getbit(F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(-1).cast("long")), i.bitwiseAND(F.lit(63))) == 1
    return F.when(words.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(split_lines(text), stays), "\n"))


def with_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """(doc_id, text, n_dropped, words) of every row of docs."""
    right = maps.select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "n_dropped", words_of(F.col("keep")).alias("words"))
    rows = docs.select("doc_id", "text").withColumn("mark", text_mark(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("of"))
    return rows.join(right, same, "left").select("doc_id", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "words")


def op11_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = with_bitmaps(docs, materialise(bitmaps(docs), "bitmaps"))
    return rows.select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"), "n_dropped", F.sha2(kept_text(F.col("text"), F.col("words")), 256).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = f"""WITH l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
v AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last <> doc_id) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256 FROM k LEFT JOIN v USING (key) GROUP BY doc_id"""
