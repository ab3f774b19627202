"""Running sums and greedy batches over groups of any size, no group sorted or folded in one task unless it is small."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

#: Items of a group that one task may fold.
FOLDED = 1 << 20


def same(left, right, columns):
    return reduce(lambda p, q: p & q, [left[c].eqNullSafe(right[c]) for c in columns])


def running(df, group, order, value):
    """Rows with `index`, from 0 in the order within their group, `before`, the sum of an integer column before them, and `n`, the rows of the group.

    Rows are dealt into ranges of (group, order) and written; sums are taken within a range,
    and what stands before a range is added from the ranges' totals alone. Nulls come first.
    """
    ranges = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = df.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    rows = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    own = [*group, "_part"]
    parts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    parts = stored(parts.select(*own, (zero(F.sum("_rows").over(earlier)) - F.col("_first")).alias("_shift"), zero(F.sum("_sum").over(earlier)).alias("_past"), F.sum("_rows").over(Window.partitionBy(*group)).alias("n")), "totals")
    found = rows.join(parts, same(rows, parts, own)).select(*[rows[c] for c in rows.columns], "_shift", "_past", "n")
    within = zero(F.sum(value).over(Window.partitionBy(*own).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)))
    return found.select(*df.columns, (F.col("_place") + F.col("_shift")).alias("index"), (F.col("_past") + within).alias("before"), "n")


def _fold(budget):
    """Batch numbers of sorted rows, one pass with nothing held but the open batch."""

    def run(batches):
        group, used, batch = object(), 0, -1
        for rows in batches:
            out = []
            for key, size in zip(rows.column("_group").to_pylist(), rows.column("_size").to_pylist(), strict=True):
                if key != group:
                    group, used, batch = key, size, 0
                elif used + size > budget:
                    used, batch = size, batch + 1
                else:
                    used += size
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column("_group"), rows.column("_order"), pa.array(out, pa.int32())], ["_group", "_order", "batch"])

    return run


def _starts(items, budget):
    """The indexes that begin a batch, of items (_group, index, _size, before, n) in groups of any size.

    The item after a batch that begins at i is the first whose end lies more than the budget
    beyond the start of i: as many items as end by then stand before it, which is a running
    count over starts and ends together. From the first item on, these pointers are
    followed twice as far each round.
    """
    end = F.col("before") + F.col("_size")
    marks = items.select("_group", end.alias("at"), F.lit(0).alias("asks"), F.lit(1).alias("ends"), "index", "n")
    marks = marks.unionByName(items.select("_group", (F.col("before") + budget).alias("at"), F.lit(1).alias("asks"), F.lit(0).alias("ends"), "index", "n"))
    passed = running(marks.withColumnRenamed("index", "i").withColumnRenamed("n", "of"), ["_group"], ["at", "asks", "i"], "ends").where("asks = 1")
    jump = stored(passed.select("_group", "i", F.greatest(F.col("i") + 1, "before").alias("to"), "of").where("to < of").select("_group", "i", "to"), "pointers")
    found = stored(items.where("index = 0").select("_group", F.col("index").alias("i")), "starts")
    while True:
        onward = stored(found.join(jump, ["_group", "i"]).select("_group", F.col("to").alias("i")), "onward")
        if onward.isEmpty():
            return found
        found = stored(found.unionByName(onward), "starts")  # pointers of double length lead to none that is known
        ahead = jump.select("_group", F.col("i").alias("to"), F.col("to").alias("next"))
        jump = stored(jump.join(ahead, ["_group", "to"]).select("_group", "i", F.col("next").alias("to")), "pointers")


def greedy_batches(df, group, order, size, budget, folded=FOLDED):
    """Pack items in order into batches that hold at most `budget`, per group: group, order and the batch number, from 0.

    An item larger than the budget is a batch of its own. Groups of at most `folded` items
    are folded where their sorted rows lie; larger ones are cut by running sums and pointers,
    so that no task reads a whole group. The order has no ties within a group; sizes are
    integers, none negative, NULL as 0.
    """
    items = df.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"))
    counts = items.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    large = stored(counts.where(F.col("n") > folded).select(F.col("_group").alias("_large"), F.monotonically_increasing_id().alias("_id")), "large-groups")
    is_large = F.col("_group").eqNullSafe(F.col("_large"))
    some = not large.isEmpty()
    small = items.join(large, is_large, "left_anti") if some else items
    schema = items.drop("_size").withColumn("batch", F.lit(0)).schema
    out = small.repartition("_group").sortWithinPartitions("_group", "_order").mapInArrow(_fold(budget), schema)
    if some:
        own = items.join(large, is_large).select(F.col("_id").alias("_group"), "_order", "_size")  # groups by number, so that none is null
        placed = stored(running(own, ["_group"], ["_order"], "_size"), "placed")
        begins = _starts(placed, budget).select("_group", F.col("i").alias("index"), F.lit(1).alias("_begins"))
        marked = placed.join(begins, ["_group", "index"], "left").select("_group", "_order", F.col("index").alias("_at"), F.coalesce("_begins", F.lit(0)).alias("_begins"))
        batches = running(marked, ["_group"], ["_at"], "_begins").withColumnRenamed("_group", "_id").join(large, "_id")
        out = out.unionByName(batches.select(F.col("_large").alias("_group"), "_order", (F.col("before") + F.col("_begins") - 1).cast("int").alias("batch")))
    return out.select(F.col("_group").alias(group), F.col("_order").alias(order), "batch")
