"""Lookups by position: as-of, ranges, occurrences, and state kept in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def occurrence(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """rows with their number, from 0, among equal keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def last_before(rows: DataFrame, keys: list[str], at: str, value: Column, name: str, strict: bool = True) -> DataFrame:
    """rows with the last non-null value at an earlier (or equal) position of the same keys."""
    w = Window.partitionBy(*keys).orderBy(at)
    w = w.rowsBetween(Window.unboundedPreceding, -1) if strict else w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_start(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, payload: list[str], tie: list[str], slice_of: Column | None = None) -> DataFrame:
    """left with the payload of the last right row of the same keys at or before its position; null if there is none.

    Both sides are laid into one order and the last right row is carried on by a window. A hot key is cut by slice_of, a
    column that rises with `at`: windows run inside a slice, and a slice's opening value comes from the slices before it, of which each keeps one row.
    """
    ok = F.struct(*[F.col(c) for c in payload])
    sides = left.select(*keys, at, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(ok.alias("x")).schema["x"].dataType).alias("__pay"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__tie_{c}") for c in tie])
    sides = sides.unionByName(right.select(*keys, at, F.lit(0).alias("__side"), F.lit(None).cast(sides.schema["__row"].dataType).alias("__row"), ok.alias("__pay"), *[F.col(c).alias(f"__tie_{c}") for c in tie]))
    order = [at, "__side", *[f"__tie_{c}" for c in tie]]
    if slice_of is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = sides.withColumn("__pay", F.last("__pay", ignorenulls=True).over(w)).where("__side = 1")
    else:
        sides = sides.withColumn("__slice", slice_of)
        ends = sides.where("__side = 0").groupBy(*keys, "__slice").agg(F.max_by("__pay", F.struct(*order)).alias("__end"))
        every = sides.select(*keys, "__slice").distinct().join(ends, [*keys, "__slice"], "left")
        before = every.withColumn("__open", F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).drop("__end")
        w = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = sides.withColumn("__last", F.last("__pay", ignorenulls=True).over(w)).where("__side = 1").join(before, [*keys, "__slice"], "left").withColumn("__pay", F.coalesce("__last", "__open"))
    return out.select("__row.*", *[F.col(f"__pay.{c}").alias(c) for c in payload])


def in_range(points: DataFrame, ranges: DataFrame, at: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """points joined with every range (start, end, both ends included) that holds them, by equal buckets of `width`.

    A range is copied once for each bucket that it touches, so the join is an equi-join rather than a nested loop.
    """
    keys = keys or []
    buckets = ranges.withColumn("__b", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"`end` div {width}"))))
    return points.withColumn("__b", F.expr(f"`{at}` div {width}")).join(buckets, [*keys, "__b"]).where(F.col(at).between(F.col("start"), F.col("end"))).drop("__b")


def smallest_owner(hits: DataFrame, point: list[str], order: list[str], value: str) -> DataFrame:
    """Of several ranges that hold a point the one that is first in order."""
    return hits.groupBy(*point).agg(F.min_by(value, F.struct(*order)).alias(value))


def evict_oldest(entries: DataFrame, order: list[str], size: str, limit: int, incoming: int = 0) -> DataFrame:
    """Entries to drop, oldest first, until what stays and the incoming size fit the limit.

    An entry goes while the sizes from it to the newest do not fit. The running sum is taken over range partitions: sums of
    whole partitions first, then inside each.
    """
    from quarrylens.storage import materialise

    part = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id())
    part = materialise(part, "entries")
    sums = part.groupBy("__p").agg(F.sum(size).alias("__s"))  # a row for each partition
    later = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__later"))
    inside = F.sum(size).over(Window.partitionBy("__p").orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0))
    out = part.withColumn("__i", inside).join(F.broadcast(later), "__p")
    return out.where(F.col("__i") + F.col("__later") + incoming > limit).drop("__p", "__r", "__i", "__later")
