"""Repair of conversations: the cheapest edits after which the roles read (s?(ua)+)?, by weighted finite-state composition.

A row's first fault counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (last such
character is not . ! ?). Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows),
Insert an empty user or assistant row 3; a truncated row that stays adds 3. Of the cheapest ways the one whose initials (D I K R) come first.

Method: the rows are an input acceptor over symbols (role initial, fault), EDITS is the transducer, GRAMMAR the acceptor. Only states that can be
reached are composed, position after position, which is a topological order; a state keeps its least weight (cost, labels).
Labels end with the edit of a row at every position, so of two label strings at one state none begins with the other,
and the least one stays least whatever follows: weights form a semiring, and paths of parts can be joined.

Long conversations: rows are numbered through range partitions, blocks of BLOCK consecutive rows are composed from every grammar
state to every other, and FAN neighbouring blocks are joined a round, until a conversation is one part. No task holds a conversation's rows.
Applying the edits and hashing the text go through a conversation in order (a digest can't be split): one Arrow batch
and the conversation's edits in memory, never its text.

Defined cases: null role or text is one space; rows of one turn come in order of role and text (32 code points of each, then hash), null turns
first; a role that doesn't begin with s, u or a can't be kept, nor an empty one; a null conv_id is a conversation;
equality of role and text is by 128 bits of hash; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from quarrylens.llm.common import hash_pair, materialise, table
from quarrylens.operators.graph import numbered

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = {0, 3}
ROLES = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Symbols: s u a, x for any other initial; capital if truncated; DEAD for rows that must go.
DEAD = "-"
#: Rows composed at once, and parts joined in a round.
BLOCK, FAN = 256, 64
PATHS = ArrayType(StructType().add("start", IntegerType()).add("stop", IntegerType()).add("cost", LongType()).add("labels", StringType()))

Weight = tuple[int, str]
Segment = dict[tuple[int, int], Weight]


def edits(symbol: str) -> Iterator[tuple[str, str | None, int]]:
    """Arcs (label, role initial or None, cost) of the transducer for one row."""
    yield "D", None, DELETE
    if symbol != DEAD:
        extra = TRUNCATED if symbol.isupper() else 0
        if symbol.lower() in "sua":
            yield "K", symbol.lower(), extra
        for r in ROLES:
            yield "R", r, REROLE + extra


def inserts(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, labels) after any inserted rows; none comes back to a state, for that only costs."""
    todo = [(state, 0, "", {state})]
    while todo:
        at, cost, labels, seen = todo.pop()
        yield at, cost, labels
        todo += [(to, cost + INSERT, labels + "I", seen | {to}) for r, to in GRAMMAR[at].items() if r in ROLES and to not in seen]


def least(into: dict, key, weight: Weight) -> None:
    if key not in into or weight < into[key]:
        into[key] = weight


@lru_cache(None)
def arcs(symbol: str, state: int) -> dict[int, Weight]:
    """Least weights from a grammar state over one row, inserts before it included."""
    out: dict[int, Weight] = {}
    for at, cost, labels in inserts(state):
        for label, role, price in edits(symbol):
            to = at if role is None else GRAMMAR[at].get(role)
            if to is not None:
                least(out, to, (cost + price, labels + label))
    return out


@lru_cache(1 << 14)
def segment(symbols: str) -> Segment:
    """Least weight between each two grammar states over a row of symbols."""
    out: Segment = {}
    for start in GRAMMAR:
        reached: dict[int, Weight] = {start: (0, "")}
        for symbol in symbols:
            step: dict[int, Weight] = {}
            for at, (cost, labels) in reached.items():
                for to, (price, more) in arcs(symbol, at).items():
                    least(step, to, (cost + price, labels + more))
            reached = step
        out |= {(start, stop): w for stop, w in reached.items()}
    return out


def joined(parts: list[Segment]) -> Segment:
    """Segments in a row as one."""
    whole = parts[0]
    for part in parts[1:]:
        step: Segment = {}
        for (start, middle), (cost, labels) in whole.items():
            for (here, stop), (price, more) in part.items():
                if here == middle:
                    least(step, (start, stop), (cost + price, labels + more))
        whole = step
    return whole


def closed(whole: Segment) -> Weight:
    """Least weight of a complete repair, rows inserted at the end included."""
    return min((cost + price, labels + more) for (start, stop), (cost, labels) in whole.items() if start == 0 for at, price, more in inserts(stop) if at in FINAL)


def rows_of(s: Segment) -> list[dict]:
    return [{"start": a, "stop": b, "cost": c, "labels": w} for (a, b), (c, w) in s.items()]


def segment_of(rows) -> Segment:
    return {(r["start"], r["stop"]): (r["cost"], r["labels"]) for r in rows}


ARROW_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())]))


@F.arrow_udf(PATHS)
def composed(symbols: pa.Array) -> pa.Array:
    return pa.array([rows_of(segment(s)) for s in symbols.to_pylist()], ARROW_PATHS)


@F.arrow_udf(PATHS)
def chained(parts: pa.Array) -> pa.Array:
    return pa.array([rows_of(joined([segment_of(x) for x in p])) for p in parts.to_pylist()], ARROW_PATHS)


@F.arrow_udf(StructType().add("cost", LongType()).add("audit", StringType()))
def finished(paths: pa.Array) -> pa.Array:
    cost, audit = zip(*(closed(segment_of(p)) for p in paths.to_pylist())) if len(paths) else ((), ())
    return pa.StructArray.from_arrays([pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["cost", "audit"])


def illegal_pair(two: Column) -> Column:
    return ~two.isin("su", "ua", "au")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2, n): rows in order of conversation and turn, numbered from 0 over all."""
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    filled = filled.select("*", *hash_pair("role", "text"), F.left("role", F.lit(32)).alias("r"), F.left("text", F.lit(32)).alias("t"))
    return numbered(filled, ["conv_id", "turn", "r", "t", "h1", "h2"], "n").drop("r", "t")


def faults(turns: DataFrame) -> DataFrame:
    """(n, conv_id, turn, initial, fault): the first fault of each row, null if it has none. turns: ordered, materialised."""
    first = turns.groupBy("conv_id", "h1", "h2").agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    bare = F.rtrim("text", F.lit(SPACE))
    kinds = turns.select("n", "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return kinds.join(first, "n", "left").select("n", "conv_id", "turn", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x").alias("initial"), fault.alias("fault"))


def counts(found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated)."""
    kind = lambda k: F.count_if(F.coalesce(F.col("fault") == k, F.lit(False))).alias(k)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    return found.groupBy("conv_id").agg(gaps, kind("blank"), kind("duplicate"), kind("truncated"))


def plan(found: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit): neighbours whose roles may not follow one another, and the cheapest edits."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), DEAD).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    rows = found.select("conv_id", F.shiftright("n", BLOCK.bit_length() - 1).alias("part"), F.struct("n", symbol.alias("symbol"), "initial").alias("row"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # at most BLOCK rows each
    text = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "")
    parts = parts.select("conv_id", "part", text("symbol").alias("symbols"), text("initial").alias("initials"))
    bad = F.size(F.filter(F.sequence(F.lit(1), F.char_length("initials")), lambda i: (i < F.char_length("initials")) & illegal_pair(F.substring("initials", i, F.lit(2)))))
    parts = parts.select("conv_id", "part", F.left("initials", F.lit(1)).alias("first"), F.right("initials", F.lit(1)).alias("last"), bad.cast("long").alias("illegal"), composed("symbols").alias("paths"))
    done, parts = None, materialise(parts, "parts")
    while True:
        several = materialise(parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("conv_id").alias("several")), "several")
        same = F.col("conv_id").eqNullSafe(F.col("several"))
        single = parts.join(several, same, "left_anti")
        done = single if done is None else done.unionByName(single)
        if not several.limit(1).count():
            break
        open_parts = parts.join(several, same, "left_semi").groupBy("conv_id", F.shiftright("part", FAN.bit_length() - 1).alias("to")).agg(F.sort_array(F.collect_list(F.struct("part", "first", "last", "illegal"))).alias("p"), F.sort_array(F.collect_list(F.struct("part", "paths"))).alias("q"))
        between = F.size(F.filter("p", lambda x, i: (i > 0) & illegal_pair(F.concat(F.get("p", i - 1)["last"], x["first"]))))
        inside = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["illegal"])
        parts = open_parts.select("conv_id", F.col("to").alias("part"), F.get("p", F.lit(0))["first"].alias("first"), F.element_at("p", -1)["last"].alias("last"), (between + inside).cast("long").alias("illegal"), chained(F.transform("q", lambda x: x["paths"])).alias("paths"))
        parts = materialise(parts, "parts")
    return done.select("conv_id", "illegal", finished("paths").alias("f")).select("conv_id", "illegal", "f.cost", "f.audit")


def in_order(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Every conversation's edits followed by its rows: (conv_id, n, role, text), the edits as text of a row with n = -1."""
    head = plans.select("conv_id", F.lit(-1).cast("long").alias("n"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    return head.unionByName(turns.select("conv_id", "n", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "n")


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its end?, edit, role, text) of rows as in_order gives them."""
    conv, labels, last, begun = None, iter(()), "", False

    def new_role() -> str:
        return "a" if last == "u" else "u"

    for batch in batches:
        for now, n, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "role", "text")), strict=True):
            if n < 0:
                if begun:
                    for _ in labels:
                        last = new_role()
                        yield conv, False, "I", ROLES[last], ""
                    yield conv, True, None, None, None
                conv, labels, last, begun = now, iter(text), "", True
                continue
            for label in labels:
                if label == "D":
                    break
                last = role[0] if label == "K" else new_role()
                yield conv, False, label, role if label == "K" else ROLES[last], "" if label == "I" else text
                if label != "I":
                    break
    if begun:
        for _ in labels:
            last = new_role()
            yield conv, False, "I", ROLES[last], ""
        yield conv, True, None, None, None


def emitted(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema, strict=True)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema, strict=True)], schema=schema)


def repair(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, rows by place from 0."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def places():
            place = 0
            for conv, end, edit, role, text in repaired(batches):
                if not end:
                    yield conv, place, edit, role, text
                place = 0 if end else place + 1

        return emitted(places(), schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = turns.sparkSession.createDataFrame([], f"conv_id {kind}, place long, edit string, role string, text string").schema
    schema = to_arrow_schema(out)
    return in_order(turns, plans).mapInArrow(run, out)


def digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired rows as `role:text`, joined by new lines."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def hashes():
            sha, sep = hashlib.sha256(), b""
            for conv, end, _, role, text in repaired(batches):
                if end:
                    yield conv, sha.hexdigest()
                    sha, sep = hashlib.sha256(), b""
                else:
                    sha.update(sep + f"{role}:{text}".encode())
                    sep = b"\n"

        return emitted(hashes(), schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = turns.sparkSession.createDataFrame([], f"conv_id {kind}, repaired_sha256 string").schema
    schema = to_arrow_schema(out)
    return in_order(turns, plans).mapInArrow(run, out)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of `conv_id:turn` modulo 20: dropped, emptied, without . ! ?, repeated, or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    roll = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), roll.alias("roll")).where("roll <> 0")
    rows = rows.withColumn("role", F.when(F.col("roll") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("roll") == 1, "").when(F.col("roll") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("roll") == 3, 2).otherwise(1)))).drop("roll", "copy")


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = materialise(ordered(damaged(rows)), "turns")
    found = materialise(faults(turns), "faults")
    plans = materialise(plan(found), "plans")
    out = rows.select("conv_id").distinct()
    for part in (counts(found), plans, digests(turns, plans)):
        part = part.withColumnRenamed("conv_id", "of")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
