"""Undoing of flattened control flow: edges into a dispatcher whose state is known go straight to its arm.

A flattened method keeps its next block in a slot: blocks store a constant there and jump to a dispatcher, which compares the slot. What
a slot can hold where a block begins is a fixpoint over (method, slot, block, value). Dispatchers with a known state pass it on along the
arm that it selects only, which is what tells the states apart.

Two ways lead to the same rows. `unflattened_methods` deals whole methods to tasks, which go through many small ones at once as arrays (`method_arrays.solve`); methods with
more possible states than a task should hold take the other way. In `unflattened` each step is one join of the newly found states with what is known of their block by
(method, slot, block): its store, its list of arms and its ends; a method is spread over as many tasks as it has blocks, at the price of several joins a step.

edges: (method, src, dst), for blocks that are no dispatchers. effects: (method, block, slot, value), the last store of a block, null if it isn't constant. arms: (method,
block, slot, rank, op, operand, target); the first arm by rank that holds is taken; op is eq, ne, lt, ge, gt, le or else. A dispatcher does nothing but
compare one slot. entries: (method, block).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.operators import method_arrays
from quarrylens.storage import materialise, small_or_plain

KEYS = ["method", "slot", "block"]
#: Steps of a round: fewer rounds are fewer tables to write, at the price of longer plans.
HOPS = 2
#: States up to which a round broadcasts them.
FEW_ROWS = 50_000
#: Possible states of a method, and its rows, up to which a task holds it whole; a state takes five bytes there.
STATES, METHOD_ROWS = 1 << 26, 1 << 20


def holds(op: Column, value: Column, operand: Column) -> Column:
    tests = {"eq": value == operand, "ne": value != operand, "lt": value < operand, "ge": value >= operand, "gt": value > operand, "le": value <= operand, "else": F.lit(True)}
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(op == name, test).otherwise(out)
    return out


def after(states: DataFrame, effects: DataFrame) -> DataFrame:
    """states (method, slot, block, value) with the value at the block's end."""
    own = effects.select("method", "slot", "block", F.col("value").alias("stored"), F.lit(True).alias("stores"))
    return states.join(own, KEYS, "left").withColumn("value", F.when(F.col("stores"), F.col("stored")).otherwise(F.col("value"))).drop("stored", "stores")


def hubs_of(arms: DataFrame) -> DataFrame:
    """(method, slot, block, hub): each dispatcher's arms as a list in order of rank, as long as its code."""
    return arms.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("rank", "op", "operand", "target"))).alias("hub"))


def taken(hub: Column, value: Column) -> Column:
    """The target of the arm that a known value takes; null for an unknown one, and where no arm holds."""
    return F.when(value.isNotNull(), F.get(F.filter(hub, lambda x: holds(x["op"], value, x["operand"])), 0)["target"])


def reach(start: DataFrame, step: Callable[[DataFrame], DataFrame], same: Callable[[DataFrame, DataFrame], Column], tag: str) -> DataFrame:
    """All rows that steps lead to from start; a round takes HOPS steps, writes what is new and goes on from that.

    Rows are many however small the files are that hold them, so only counted ones are broadcast.
    """
    found = frontier = materialise(start.distinct(), tag)
    total = n = frontier.count()
    while n:
        hops = [F.broadcast(frontier) if n <= FEW_ROWS else frontier.hint("merge")]
        for _ in range(HOPS):
            to = step(hops[-1]).distinct()
            hops.append(to if n <= FEW_ROWS else to.hint("merge"))
        new = reduce(DataFrame.unionByName, hops[1:]).distinct()
        old = found.select(*[F.col(c).alias(f"__{c}") for c in found.columns])
        frontier = materialise(new.join(F.broadcast(old) if total <= FEW_ROWS else old.hint("merge"), same(new, old), "left_anti"), tag)
        found, n = found.unionByName(frontier), frontier.count()
        total += n
    return materialise(found, tag)


def states(edges: DataFrame, effects: DataFrame, arms: DataFrame, entries: DataFrame) -> DataFrame:
    """(method, slot, block, value): all values, null for unknown, that a dispatched slot can have where a block begins."""
    slots = arms.select("method", "slot").distinct()
    onward = edges.select("method", F.col("src").alias("block"), F.col("dst").alias("target")).unionByName(arms.select("method", "block", "target"))
    onward = onward.groupBy("method", "block").agg(F.collect_set("target").alias("onward"))
    # One row says all of a block that a step asks for: what it stores, its arms, where it may go.
    own = effects.select(*KEYS, F.col("value").alias("stored"), F.lit(True).alias("stores"))
    ways = onward.join(slots, "method").join(own, KEYS, "left").join(hubs_of(arms), KEYS, "left")
    ways = materialise(ways.select(*KEYS, "stored", "stores", "hub", "onward"), "ways")

    def step(at: DataFrame) -> DataFrame:
        end = F.when(F.col("stores"), F.col("stored")).otherwise(F.col("value"))
        rows = at.join(ways, KEYS).select("method", "slot", end.alias("value"), "hub", "onward")
        arm = F.filter(F.array(taken(F.col("hub"), F.col("value"))), lambda x: x.isNotNull())
        to = F.when(F.col("hub").isNotNull() & F.col("value").isNotNull(), arm).otherwise(F.col("onward"))
        return rows.select("method", "slot", F.explode(to).alias("block"), "value")

    same = lambda a, b: (a["method"] == b["__method"]) & (a["slot"] == b["__slot"]) & (a["block"] == b["__block"]) & a["value"].eqNullSafe(b["__value"])
    start = entries.join(slots, "method").select("method", "slot", "block", F.lit(None).cast("long").alias("value"))
    return reach(start, step, same, "states")


def redirected(edges: DataFrame, effects: DataFrame, arms: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, arms) after one pass, edges with `was`, the former end of a redirected edge, else null.

    An edge into a dispatcher is redirected if every state at its start leads to one and the same arm; a dispatcher of which
    that holds itself becomes a plain block.
    """
    found = states(edges, effects, arms, entries)
    hubs = materialise(hubs_of(arms), "hubs")
    one_target = [F.min("target").alias("least"), F.max("target").alias("to"), F.bool_or(F.col("target").isNull()).alias("open")]
    ends = after(found, effects).withColumnRenamed("block", "src")
    into = edges.join(hubs.withColumnRenamed("block", "dst"), ["method", "dst"])
    one = ends.join(into.hint("merge"), ["method", "slot", "src"]).select("method", "src", "dst", taken(F.col("hub"), F.col("value")).alias("target"))
    one = one.groupBy("method", "src", "dst").agg(*one_target)
    one = materialise(one.where("least = to and not open and to <> dst").select("method", "src", "dst", "to"), "redirected")
    new = edges.join(one, ["method", "src", "dst"], "left").select("method", "src", F.coalesce("to", "dst").alias("dst"), F.when(F.col("to").isNotNull(), F.col("dst")).alias("was"))

    here = found.join(hubs, KEYS).select("method", "slot", "block", taken(F.col("hub"), F.col("value")).alias("target")).groupBy(*KEYS).agg(*one_target)
    plain = materialise(here.where("least = to and not open").select("method", "block", "to"), "plain")
    new = new.unionByName(plain.select("method", F.col("block").alias("src"), F.col("to").alias("dst"), F.lit(None).cast(edges.schema["dst"].dataType).alias("was")))
    return materialise(new.distinct(), "edges"), materialise(arms.join(plain, ["method", "block"], "left_anti"), "arms")


def unflattened(edges: DataFrame, effects: DataFrame, arms: DataFrame, entries: DataFrame, passes: int = 64) -> DataFrame:
    """(method, src, dst, kind): the edges that are left, kind is jump, redirected or arm; blocks nothing reaches are gone.

    Passes go on until none changes anything, so dispatchers behind dispatchers are seen through; more than `passes` raise.
    """
    # The tables are asked for in every pass; what makes them runs once.
    edges, effects, arms, entries = (materialise(x, tag) for x, tag in ((edges, "edges"), (effects, "effects"), (arms, "arms"), (entries, "entries")))
    moved, closed, closed_arms = [], [], []
    for _ in range(passes):
        now, arms = redirected(edges, effects, arms, entries)
        moved.append(now.where("was is not null").select("method", "src", "dst"))
        edges = materialise(now.select("method", "src", "dst").distinct(), "edges")
        # Only methods in which something has changed and an edge still leads into a dispatcher are gone through again.
        hubs = arms.select("method", F.col("block").alias("dst"))
        again = materialise(edges.join(hubs, ["method", "dst"], "left_semi").select("method").intersect(moved[-1].select("method")), "again")
        closed.append(edges.join(again, "method", "left_anti"))
        closed_arms.append(arms.join(again, "method", "left_anti"))
        edges, arms = materialise(edges.join(again, "method", "left_semi"), "edges"), materialise(arms.join(again, "method", "left_semi"), "arms")
        if not again.limit(1).count():
            break
    else:
        raise RuntimeError("unflattening did not settle")
    moved, edges, arms = (reduce(DataFrame.unionByName, x) for x in (moved, closed, closed_arms))
    plain = edges.join(moved.distinct().withColumn("moved", F.lit(True)), ["method", "src", "dst"], "left").select("method", "src", "dst", F.when(F.col("moved"), "redirected").otherwise("jump").alias("kind"))
    left = materialise(plain.unionByName(arms.select("method", F.col("block").alias("src"), F.col("target").alias("dst"), F.lit("arm").alias("kind")).distinct()), "left")
    step = lambda at: at.join(left.select("method", F.col("src").alias("block"), "dst"), ["method", "block"]).select("method", F.col("dst").alias("block"))
    same = lambda a, b: (a["method"] == b["__method"]) & (a["block"] == b["__block"])
    seen = reach(entries.select("method", "block"), step, same, "live")
    return left.join(seen.withColumnRenamed("block", "src"), ["method", "src"], "left_semi")


def unflattened_methods(edges: DataFrame, effects: DataFrame, arms: DataFrame, entries: DataFrame, passes: int = 64) -> DataFrame:
    """As unflattened, for many methods of which few are large: one exchange by method, all passes of a method in one task.

    Methods that may have more than STATES states, or have more than METHOD_ROWS rows, go through the joins of unflattened.
    """
    none = lambda like, c: F.lit(None).cast(like.schema[c].dataType)
    part = lambda rows, tag, a, b, slot, rank, op, value: rows.where("method is not null").select("method", F.lit(tag).cast("byte").alias("part"), a.alias("a"), b.alias("b"), slot.alias("slot"), rank.alias("rank"), F.when(op.isNotNull(), F.array_position(F.array(*map(F.lit, method_arrays.OPS)), op) - 1).cast("byte").alias("op"), value.alias("value"))
    dst, slot, rank, op, value = none(edges, "dst"), none(arms, "slot"), none(arms, "rank"), F.lit(None).cast("string"), none(arms, "operand")
    c = F.col

    def rows_of(kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        parts = [
            part(kept(edges), method_arrays.EDGE, c("src"), c("dst"), slot, rank, op, value),
            part(kept(effects), method_arrays.EFFECT, c("block"), dst, c("slot"), rank, op, c("value")),
            part(kept(arms), method_arrays.ARM, c("block"), c("target"), c("slot"), c("rank"), c("op"), c("operand")),
            part(kept(entries), method_arrays.ENTRY, c("block"), dst, slot, rank, op, value),
        ]
        return reduce(DataFrame.unionByName, parts).where("a is not null")

    # At most as many blocks as ends of edges and arms, values as there are constants, slots as there are arms unless all name one.
    arm = F.when(c("part") == method_arrays.ARM, c("slot"))
    sizes = rows_of(lambda x: x).groupBy("method").agg(F.count(F.lit(1)).alias("rows"), F.count("b").alias("ends"), F.count("value").alias("values"), F.count(arm).alias("arms"), F.min(arm).alias("least"), F.max(arm).alias("most"))
    bound = (c("rows") + c("ends")).cast("double") * (c("values") + 1) * F.when(c("least") == c("most"), 1).otherwise(c("arms"))
    large = materialise(sizes.where((bound > STATES) | (c("rows") > METHOD_ROWS)).select("method"), "large")
    some = bool(large.limit(1).count())
    large = small_or_plain(large) if some else large
    rows = rows_of((lambda x: x.join(large, "method", "left_anti")) if some else lambda x: x)
    types = {n: edges.schema[n].dataType.simpleString() for n in ("method", "src", "dst")}
    schema = ", ".join(f"{n} {k}" for n, k in types.items()) + ", kind byte"
    left = rows.repartition("method").sortWithinPartitions("method").mapInArrow(lambda batches: method_arrays.stream(batches, STATES, passes), schema)
    left = left.withColumn("kind", reduce(lambda rest, k: F.when(c("kind") == k, method_arrays.KINDS[k]).otherwise(rest), range(len(method_arrays.KINDS)), F.lit(None)))
    if not some:
        return left
    return left.unionByName(unflattened(*(x.join(large, "method", "left_semi") for x in (edges, effects, arms, entries)), passes))
