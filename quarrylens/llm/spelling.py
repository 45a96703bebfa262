"""Spelling variants: each word's near words, the form it is a variant of, and the root of that form.

Words are maximal runs of letters with A-Z lower-cased; those of MIN_CHARS code points that occur MIN_COUNT times make the vocabulary.
Two words are near if they differ by one code point inserted, deleted or replaced.

Method, without a pair of words in any table: a word has a group (position, prefix, suffix) for each of its positions, written as the word with a wildcard
there. A group keeps its size and its two most frequent words, which is all that a member needs: size - 1 near words, and the
first word or, for the first word itself, the second. One position differs between two words, so no pair is counted
twice. Insertions and deletions are one join: words with one code point left out meet the vocabulary, and both ends take
count and most frequent word by aggregation. A group has at most one word for each letter (90), so its members are bounded.

A form has at least RATIO times its word's occurrences, so chains of forms end after log5 of the largest count; roots are found by
doubling the known part of every chain.

Defined cases: null and empty texts have no words; a null id counts as an empty one where ids matter (misspelt); repeated rows count each
time; groups and deletions of words beyond LONG code points are told apart by MD5 instead of the text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.llm.common import ascii_lower, materialise, table

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Keys of longer words are hashed, so that rows stay short.
LONG = 64
WILD = "*"
#: One occurrence in so many is misspelt by the query.
ONE_IN = 199


def runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, word): the runs of at least so many letters, one row each."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[a-z\\u00C0-\\u00FF]{{{min_chars},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("word"))


def misspelt(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word): words in which one occurrence of ONE_IN, chosen by crc32 of `doc_id:word`, lacks a code point."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    rows = words.select("word", h.alias("h"))
    short = without(F.col("word"), (F.col("h") % F.char_length("word")).cast("int"))
    return rows.select(F.when(F.col("h") % ONE_IN == 0, short).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= min_chars)


def without(word: Column, at: Column, wild: str = "") -> Column:
    """The word with its code point at a position (from 0) left out or replaced."""
    return F.concat(F.substring(word, F.lit(1), at), F.lit(wild), F.substring(word, at + 2, F.char_length(word)))


def key_of(word: Column) -> Column:
    """The word itself, or a hash if it is long; hashes are no words, for they hold digits."""
    return F.when(F.char_length(word) <= LONG, word).otherwise(F.concat(F.lit("0"), F.md5(word)))


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of words that occur often enough."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def near(vocab: DataFrame) -> DataFrame:
    """(word, n_near, best): how many words are near, and (-n, word) of the most frequent, the first in code-point order among equals."""
    places = vocab.select("word", F.struct((-F.col("n")).alias("less"), "word").alias("own"), F.explode(F.sequence(F.lit(0), F.char_length("word") - 1)).alias("at"))
    groups = places.groupBy(key_of(without(F.col("word"), F.col("at"), WILD)).alias("k")).agg(F.array_sort(F.collect_list("own")).alias("members")).where(F.size("members") > 1)
    groups = groups.select((F.size("members") - 1).cast("long").alias("others"), F.get("members", F.lit(0)).alias("first"), F.get("members", F.lit(1)).alias("second"), F.explode("members").alias("own"))
    replaced = groups.select(F.col("own.word").alias("word"), F.col("others").alias("n"), F.when(F.col("own.word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))

    letter = lambda at: F.substring(F.col("word"), at, F.lit(1))
    fresh = (F.col("at") == 0) | (letter(F.col("at") + 1) != letter(F.col("at")))  # of equal letters in a row the first stands for all
    short = places.where(fresh).select("own", key_of(without(F.col("word"), F.col("at"))).alias("k"))
    there = vocab.select(key_of(F.col("word")).alias("k"), F.struct((-F.col("n")).alias("less"), "word").alias("other"))
    ends = short.join(there, "k").select(F.explode(F.array(F.struct(F.col("own.word").alias("word"), F.col("other").alias("best")), F.struct(F.col("other.word").alias("word"), F.col("own").alias("best")))).alias("e"))
    both = replaced.unionByName(ends.select("e.word", F.lit(1).cast("long").alias("n"), "e.best"))
    return both.groupBy("word").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain; forms: (word, form), materialised, without cycles. Every round doubles what is known."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return at


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n), materialised."""
    found = near(vocab).select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.less")).alias("best_n"))
    rows = vocab.join(found, "word", "left").withColumn("far", F.col("best_n") >= ratio * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("far"), F.col("best")).alias("form"), F.when(F.col("far"), F.col("best_n")).alias("form_n"))
    rows = materialise(rows, "forms")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    words = misspelt(runs(table(spark, sf_dir, "documents")))
    return variants(materialise(vocabulary(words), "vocabulary")).select("word", "form", "root", "n", "n_near", "form_n")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]{{{MIN_CHARS},}}')) AS run FROM documents),
few AS (SELECT doc_id, run, count(*) AS m, hex(encode(concat(doc_id, ':', run))) AS x FROM runs GROUP BY doc_id, run),
digits AS (SELECT doc_id, run, m, list_transform(range(1, length(x), 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1) AS b FROM few),
steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
hashed AS (SELECT run, m, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]))) AS h FROM digits, steps),
words AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM words WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(m) >= {MIN_COUNT}),
p AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS g, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
links AS (SELECT a.word, b.word AS other, b.n AS m FROM p a JOIN p b ON a.g = b.g AND a.word <> b.word UNION SELECT d, p.word, p.n FROM p JOIN v ON d = v.word UNION SELECT p.word, d, v.n FROM p JOIN v ON d = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(a := -m, b := other)) AS other, max(m) AS m FROM links GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * v.n THEN other END AS form, CASE WHEN m >= {RATIO} * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, last, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN forms ON last = forms.word WHERE form IS NOT NULL)
SELECT word, form, (SELECT arg_max(last, k) FROM chain WHERE chain.word = forms.word) AS root, n, n_near, form_n FROM forms"""
