"""As-of joins over tables of any size: both sides are merged in ranges of (key, time), and what a range leaves open is carried over."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .ordering import same


def asof(left, right, by, on, right_on, take, forward=False, strict=False):
    """Every left row with the columns `take` of the last right row of its keys at or before its time, NULL where there is none.

    `by` are columns of both sides, and may be none; `forward` takes the first at or after
    it, `strict` leaves out those at the very time. Of right rows at one time the one whose
    taken columns are greatest counts, or least when looking forward. Rows without a time
    find nothing and are not found; a missing key is a key. No task reads more than a range
    of rows: equal times and hot keys are spread over ranges as other rows are.
    """
    by, kept = list(by), list(left.columns)
    keys = [f"_k{i}" for i in range(len(by))]
    own = F.struct(*[left[c].alias(c) for c in kept])
    taken = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(take)])
    first, second = (1, 0) if strict else (0, 1)
    one = right.where(F.col(right_on).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(right_on).alias("_at"), F.lit(first).alias("_side"), taken.alias("_right"))
    two = left.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(on).alias("_at"), F.lit(second).alias("_side"), own.alias("_left"), F.xxhash64(*[left[c] for c in kept if "map" not in left.schema[c].dataType.simpleString()]).alias("_tie"))
    rows = one.unionByName(two, allowMissingColumns=True)
    turn = (lambda c: F.col(c).desc_nulls_last()) if forward else (lambda c: F.col(c).asc_nulls_first())
    order = [*[F.col(k).asc_nulls_first() for k in keys], turn("_at"), F.col("_side").asc(), turn("_right"), F.col("_tie").asc_nulls_first()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "merged")
    # What a range sees last of each key is what the next ranges of that key begin with.
    ends = dealt.groupBy(*keys, "_part").agg(F.max_by(F.col("_right"), F.when(F.col("_right").isNotNull(), F.col("_place"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored(ends.select(*keys, "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")), "carried")
    so_far = Window.partitionBy(*keys, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("_seen", F.last("_right", ignorenulls=True).over(so_far)).where(F.col("_side") == second)
    found = seen.join(carried, same(seen, carried, [*keys, "_part"]), "left")
    value = F.when(F.col("_at").isNotNull(), F.coalesce("_seen", "_carried"))
    return found.select("_left.*", *[value[f"t{i}"].alias(c) for i, c in enumerate(take)])

