"""Number the rows of groups of any size, without sorting a group in one task."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import stored


def same(left, right, columns):
    """A null-safe join condition on columns of the same names."""
    return reduce(lambda p, q: p & q, [left[c].eqNullSafe(right[c]) for c in columns])


def indexed(df, group, order, name):
    """Rows with `index`, from 0 in the order within their group, and `n`, the rows of the group.

    Rows are dealt into ranges of (group, order) and written, so that a lost executor
    changes nothing; what stands before a range is summed over the ranges alone. `group`
    may be empty; nulls come first. Rows equal in all these columns get any of their numbers.
    """
    ranges = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = df.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    rows = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), name)
    own = [*group, "_part"]
    parts = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    every = Window.partitionBy(*group)
    earlier = F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.select(*own, (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(every).alias("n")), f"{name}-ranges")
    found = rows.join(parts, same(rows, parts, own))
    return found.select(*[rows[c] for c in df.columns], (F.col("_place") + F.col("_shift")).alias("index"), "n")
