"""Benchmark decontamination on DataFrame functions alone: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words are split at ASCII white space after lower-casing A-Z; a shingle is five words in a row (all words of a shorter
item). A document is contaminated by an item if one of its windows of the item's size has weighted shingle similarity
(shared over joint multiplicity) of at least NUM / DEN with it.

1. Windows. Every word position of every document is looked at; hits are those where the document's shingle is one of the benchmark's.
   A window that reaches the bound holds at least NUM / DEN of an item's n shingles, so it holds one of any n - need + 1 of them (the
   ones with the fewest hits are taken), and moving its start to its first shared shingle keeps all it shares. So windows begin
   at hits that are followed by enough others of some item of that size. This filter loses nothing.
2. Fingerprints. 64 bits, each the majority over the hashes of the window's words.
3. Multi-index. Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS agree in one at least. A window takes along the items for which it
   passed the filter, and the join on (item, block number, block) finds all of them within RADIUS and looks at no other. Blocks of three bits alone would select
   an eighth of all items each, and the bound leaves no room for wider ones: a pair at the bound differs in a sixth of any code's bits, so the blocks
   that pigeonhole needs stay at three to four bits however long the code is. Pairs beyond RADIUS are dropped.
4. The pairs left are compared exactly, as multisets of shingles.

The radius follows from the bound: a window and an item then share 6 / 7 of their shingles at least, and so of their words, and a majority
bit differs with chance arccos(6 / 7) / pi = 0.17: 11 of 64 bits, with a deviation of 3. RADIUS lies three deviations above; tests compare
with brute force over sizes and edits.

Defined cases: null or empty texts and items match nothing; repeated items and documents count one by one; items with one text are
all reported; a document shorter than the item is compared as far as it goes; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrylens.llm.common import materialise, small_or_plain, table

WORDS, NUM, DEN, RADIUS = 5, 3, 4, 20
#: Words whose lane counts cannot overflow; of longer windows the words with a hash divisible by size / LANE_MAX (rounded up, doubled) count.
LANE_MAX = 32_767
LANES = 0x0001000100010001


def word_hashes(text: str) -> Column:
    """64-bit hashes of a text's words, in order."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column, length: Column) -> Column:
    """Hashes of the shingles of an array of word hashes, in order (empty if it has fewer words than length)."""
    n = F.size(words) - length + 1
    full = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.get(words, i + k - 1) for k in range(WORDS)]))
    short = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, length)))
    return F.when(n < 1, F.array().cast("array<bigint>")).when(length == WORDS, full).otherwise(short)


def simhash(words: str) -> Column:
    """The 64 majority bits of a column of word hashes (0 on a tie), counted in four lanes of 16 bits at a time.

    A lane starts so high that its bit 14 is set once more than half of the words have the bit.
    """
    thin = F.filter(words, lambda h: F.pmod(h, F.ceil(F.size(words) / LANE_MAX) * 2) == 0)
    part = F.when(F.size(words) <= LANE_MAX, F.col(words)).otherwise(thin)
    start = (F.lit(0x3FFF) - F.expr(f"size({words}) div 2")).cast("long")
    start = F.when(F.size(words) <= LANE_MAX, start).otherwise(F.lit(0x3FFF) - F.expr("1L") * F.floor(F.size(thin) / 2)) * F.lit(LANES)

    def lanes(k: int) -> Column:  # bits k, k + 16, k + 32, k + 48
        total = F.aggregate(part, start, lambda a, h: a + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES)))
        return F.shiftleft(F.shiftrightunsigned(total, 14).bitwiseAND(F.lit(LANES)), k)

    return reduce(Column.bitwiseOR, [lanes(k) for k in range(16)])


def blocks(fp: str) -> Column:
    """array<struct<no, bits>>: a fingerprint cut into RADIUS + 1 blocks."""
    edges = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    cut = [F.struct(F.lit(k).alias("no"), F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("bits")) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*cut)


def prepared_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, size, len, n, need, fp) of each distinct sequence of words, its shingles (key, size, len, n, need, gram, times), and (key,
    item_id) of every item with at least one word."""
    rows = benchmark.select("item_id", word_hashes("text").alias("w")).where(F.size("w") > 0)
    rows = materialise(rows.withColumn("key", F.xxhash64("w")), "items")
    items = rows.select("key", "w").dropDuplicates(["key"]).withColumn("size", F.size("w")).withColumn("len", F.least(F.col("size"), F.lit(WORDS)))
    items = items.withColumn("n", F.col("size") - F.col("len") + 1).withColumn("need", F.ceil(F.col("n") * NUM / DEN).cast("int"))
    items = materialise(items.withColumn("grams", shingles(F.col("w"), F.col("len"))).withColumn("fp", simhash("w")).drop("w"), "items")
    names = ["key", "size", "len", "n", "need"]
    of_item = items.select(*names, F.explode("grams").alias("gram")).groupBy(*names, "gram").agg(F.count(F.lit(1)).alias("times"))
    return items.select(*names, "fp"), materialise(of_item, "grams"), rows.select("key", "item_id")


def gram_hits(words: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, words, len, pos, gram): word positions whose shingle is one of the benchmark's."""
    parts = []
    for n in lengths:
        at = words.where(F.size("w") >= n).select("doc_id", "text_key", "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("pos"))
        gram = F.xxhash64(*[F.element_at("w", F.col("pos") + k) for k in range(WORDS)]) if n == WORDS else F.xxhash64(F.slice("w", F.col("pos"), n))
        at = at.select("doc_id", "text_key", F.size("w").alias("words"), F.lit(n).alias("len"), "pos", gram.alias("gram"))
        parts.append(at.join(known.where(F.col("len") == n).select("gram"), "gram").select("doc_id", "text_key", "words", "len", "pos", "gram"))
    return reduce(DataFrame.unionByName, parts)


def item_windows(docs: DataFrame, of_item: DataFrame, lengths: list[int]) -> tuple[DataFrame, DataFrame]:
    """(wid, doc_id, size, len, start, win, fp): windows of documents that may hold an item, with their word hashes and fingerprint; and (wid,
    key), the items that each may hold."""
    known = small_or_plain(materialise(of_item.select("len", "gram").distinct(), "known"))
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_hashes("text").alias("w"))
    hits = materialise(gram_hits(words, known, lengths), "hits")

    # Of each item, the shingles with the fewest hits that together number at least n - need + 1.
    hit_counts = hits.groupBy("len", "gram").agg(F.count(F.lit(1)).alias("n_hits"))
    rated = of_item.join(hit_counts, ["len", "gram"], "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))
    before = F.sum("times").over(Window.partitionBy("key").orderBy("n_hits", "gram")) - F.col("times")
    named = materialise(rated.withColumn("before", before).where("before <= n - need and n_hits > 0").select("key", "len", "gram"), "named")
    pairs = hits.join(small_or_plain(named), ["len", "gram"]).select("doc_id", "text_key", "key").distinct()
    wanted = materialise(pairs, "pairs").join(small_or_plain(of_item.select("key", "size", "len", "n", "need", "gram")), "key")
    same = F.col("h.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("h.text_key") == F.col("p.text_key")) & (F.col("h.len") == F.col("p.len")) & (F.col("h.gram") == F.col("p.gram"))
    runs = hits.alias("h").join(wanted.alias("p"), same).groupBy("h.doc_id", "h.text_key", "p.key", "p.size", "p.len", "p.n", "p.need")
    runs = runs.agg(F.array_sort(F.collect_set("h.pos")).alias("run")).where(F.size("run") >= F.col("need"))
    enough = F.filter("run", lambda p, i: F.get("run", i + F.col("need") - 1) < p + F.col("n"))
    of_key = materialise(runs.select("doc_id", "text_key", "size", "len", "key", F.explode(enough).alias("pos")), "starts")
    wid = F.xxhash64("doc_id", "text_key", "size", "pos")
    may_hold = of_key.select(wid.alias("wid"), "key").distinct()
    starts = of_key.drop("key").distinct()

    of_doc = small_or_plain(materialise(starts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct(), "found"))
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    source = source.join(of_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    source = materialise(source.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), word_hashes("text").alias("w")), "texts")
    cut = starts.join(source, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    cut = cut.select(wid.alias("wid"), "doc_id", "size", "len", (F.col("pos") - 1).alias("start"), F.slice("w", F.col("pos"), F.col("size")).alias("win"))
    return materialise(materialise(cut, "cut").withColumn("fp", simhash("win")), "windows"), may_hold


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, similarity, distance): the best window of each document and item."""
    items, of_item, ids = prepared_items(benchmark)
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())  # at most WORDS values
    if not lengths:
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("start_word"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance")).where("false")
    windows, may_hold = item_windows(docs, of_item, lengths)

    theirs = materialise(items.select("key", "n", F.col("fp").alias("item_fp"), F.explode(blocks("fp")).alias("b")).select("key", "n", "item_fp", "b.*"), "blocks")
    own = may_hold.join(windows.select("wid", "fp"), "wid").select("wid", "key", "fp", F.explode(blocks("fp")).alias("b")).select("wid", "key", "fp", "b.*")
    near = own.join(small_or_plain(theirs), ["key", "no", "bits"]).withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    near = materialise(near.where(F.col("distance") <= RADIUS).select("wid", "key", "n", "distance").distinct(), "near")

    grams = windows.select("wid", F.size("win").alias("words"), "len", F.explode(shingles(F.col("win"), F.least(F.size("win"), F.col("len")))).alias("gram"))
    grams = grams.groupBy("wid", "words", "len", "gram").agg(F.count(F.lit(1)).alias("held"))
    shared = grams.join(near, "wid").join(small_or_plain(of_item.select("key", "gram", "times")), ["key", "gram"])
    shared = shared.groupBy("wid", "key", "n", "distance", "words", "len").agg(F.sum(F.least("held", "times")).alias("shared"))
    joint = F.col("words") - F.col("len") + 1 + F.col("n") - F.col("shared")
    found = shared.where(F.col("shared") * DEN >= joint * NUM).select("wid", "key", "distance", (F.col("shared") / joint).alias("similarity"))
    found = materialise(found, "found").join(windows.select("wid", "doc_id", "start"), "wid").join(small_or_plain(ids), "key")
    best = F.max_by(F.struct(F.col("start").alias("start_word"), "similarity", "distance"), F.struct("similarity", -F.col("distance"), -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.start_word", "m.similarity", "m.distance")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id), the documents that hold a benchmark item, once each."""
    return matches(docs, benchmark).select("doc_id").distinct()


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
