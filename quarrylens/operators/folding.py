"""Folding of string expressions to constants: a fixpoint over operand ids.

expressions: (id, op, text, number); op is string, int or char for literals, concat, substring, replace, chars (a string of its char operands). operands:
(id, place, operand), places from 0; of concat, substring and replace the string they are called on comes first. An operand that is no expression, or of another
op, never becomes known, nor does what uses it.

Each round joins the values found last with the operand rows and works out the expressions that have all their operands now. As in the folded language only ASCII
takes part; a value beyond MAX_CHARS, or an expression whose tree has made more than BUDGET characters, is an error row and folds no further.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quarrylens.storage import materialise

MAX_CHARS, BUDGET, MAX_OPERANDS = 65_536, 100_000, 1024
#: Values found in a round up to which they may be broadcast, by rows and by bytes of their texts.
FEW_ROWS, FEW_BYTES = 50_000, 4_000_000


def folded(expressions: DataFrame, operands: DataFrame, max_chars: int = MAX_CHARS, budget: int = BUDGET) -> DataFrame:
    """(id, text, number, error): every expression that folds, or why it does not although its operands do."""
    literal = expressions.where(F.col("op").isin("string", "int", "char"))
    ascii_only = (F.col("op") != "string") | (F.octet_length("text") == F.char_length("text"))
    known = literal.select("id", F.when(F.col("op") == "string", F.col("text")).alias("text"), F.when(F.col("op") != "string", F.col("number")).alias("number"), F.lit(0).cast("long").alias("cost"), F.when(~F.coalesce(ascii_only, F.lit(False)), "not ASCII").alias("error"))
    frontier, found, pending = materialise(known, "known"), [], None
    # Rows are many and texts long however small the files are that hold them, so no side is broadcast by the size of its files.
    arity = operands.groupBy("id").agg(F.count(F.lit(1)).alias("arity"))
    work = expressions.where(F.col("op").isin("concat", "substring", "replace", "chars")).select("id", "op")
    # An expression has MAX_OPERANDS operands at most, so its list is bounded.
    work = work.join(arity.where(F.col("arity") <= MAX_OPERANDS).hint("merge"), "id")
    wanted = materialise(operands.join(work.hint("merge"), "id").select("id", "op", "arity", "place", "operand"), "wanted")
    while True:
        found.append(frontier.select("id", "text", "number", "error"))
        ready = frontier.where("error is null").select(F.col("id").alias("operand"), "text", "number", "cost")
        n, size = ready.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        if not n:
            return reduce(DataFrame.unionByName, found)
        ready = ready.hint("broadcast" if n <= FEW_ROWS and size <= FEW_BYTES else "merge")
        new = wanted.join(ready, "operand").select("id", "op", "arity", F.array(F.struct("place", "text", "number")).alias("a"), F.col("cost").alias("spent"))
        rows = new if pending is None else new.unionByName(pending)
        rows = rows.groupBy("id", "op", "arity").agg(F.sort_array(F.flatten(F.collect_list("a"))).alias("a"), F.sum("spent").alias("spent"))
        # Only what lacks an operand goes through the next round again.
        rows = materialise(rows.withColumn("done", F.size("a") == F.col("arity")), "filled")
        pending = rows.where("not done").drop("done")
        rows = rows.where("done").select("id", "op", "a", "spent", *[F.get("a", F.lit(k))[f].alias(f"{f[0]}{k}") for k in range(3) for f in ("text", "number")], "arity")
        frontier = materialise(evaluated(rows, max_chars, budget), "known")


def evaluated(rows: DataFrame, max_chars: int, budget: int) -> DataFrame:
    """(id, text, number, cost, error) of expressions with all operands: a (list), t0.. and n0.. (texts and numbers of the first three)."""
    op, length = F.col("op"), lambda c: F.char_length(c)
    end = F.when(F.col("arity") == 3, F.col("n2")).otherwise(length("t0"))
    hits = F.when(length("t1") > 0, F.floor((length("t0") - length(F.replace("t0", F.col("t1"), F.lit("")))) / length("t1")))
    by_text = F.col("t1").isNotNull() & F.col("t2").isNotNull() & (length("t1") > 0)
    by_char = F.col("n1").between(0, 127) & F.col("n2").between(1, 127)
    letters = F.forall("a", lambda x: x["number"].between(1, 127))
    fits = F.when(op == "concat", (F.col("arity") == 2) & F.col("t0").isNotNull() & F.col("t1").isNotNull())
    fits = fits.when(op == "substring", F.col("arity").isin(2, 3) & F.col("t0").isNotNull() & (F.col("n1") >= 0) & (F.col("n1") <= end) & (end <= length("t0")))
    fits = fits.when(op == "replace", (F.col("arity") == 3) & F.col("t0").isNotNull() & (by_text | by_char)).otherwise(letters)
    size = F.when(op == "concat", length("t0") + length("t1")).when(op == "substring", end - F.col("n1"))
    size = size.when(op == "replace", F.when(by_text, length("t0") + hits * (length("t2") - length("t1"))).otherwise(length("t0"))).otherwise(F.col("arity"))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("size", size.cast("long"))
    # What an expression costs: its receiver and its result, and what its operands have cost.
    rows = rows.withColumn("cost", F.col("spent") + F.coalesce(length("t0"), F.lit(0)) + F.coalesce("size", F.lit(0)))
    error = F.when(~F.col("fits"), "operands do not fit").when(F.col("size") > max_chars, f"longer than {max_chars}").when(F.col("cost") > budget, f"budget of {budget} spent")
    rows = rows.withColumn("error", error)
    value = F.when(op == "concat", F.concat("t0", "t1")).when(op == "substring", F.substring("t0", F.col("n1").cast("int") + 1, (end - F.col("n1")).cast("int")))
    value = value.when((op == "replace") & by_text, F.replace("t0", F.col("t1"), F.col("t2"))).when(op == "replace", F.replace("t0", F.char("n1"), F.char("n2")))
    value = value.otherwise(F.array_join(F.transform("a", lambda x: F.char(x["number"])), ""))
    return rows.select("id", F.when(F.col("error").isNull(), value).alias("text"), F.lit(None).cast("long").alias("number"), "cost", "error")
