"""Population screens, nested populations, lifecycle of monthly activity."""

from pyspark.sql import functions as F

from ..functions.identity import months_before

MIN_COMMITS, MIN_MONTHS, MIN_BYTES, RECENT_MONTHS = 10, 3, 1000, 6


def lifecycle(monthly, snapshot, recent=RECENT_MONTHS):
    """Struct of activity figures from a map of month key -> count.

    One burst: a month with 80 % of all. Sustained: three active months or more that make
    up half of the months listed since the first. Dormant: none of the recent months active.
    """
    some = F.map_filter(monthly, lambda _, v: v > 0)
    active = F.array_sort(F.map_keys(some))
    total = F.aggregate(F.map_values(monthly), F.lit(0).cast("long"), lambda a, x: a + x)
    span = F.size(F.filter(F.map_keys(monthly), lambda k: k >= F.try_element_at(active, F.lit(1))))
    peak = F.array_max(F.map_values(monthly))
    none = F.coalesce(F.size(some), F.lit(0)) <= 0
    return F.struct(
        F.greatest(F.size(active), F.lit(0)).alias("active_months"),
        F.coalesce(total, F.lit(0)).alias("observed"),
        F.when(none, False).otherwise(peak / total >= 0.8).alias("single_burst"),
        F.when(none, False).otherwise((F.size(active) >= 3) & (F.size(active) >= 0.5 * span)).alias("sustained"),
        F.when(none, True).otherwise(~F.coalesce(F.arrays_overlap(active, months_before(snapshot, recent)), F.lit(False))).alias("dormant"),
    )


def screens(conditions):
    """Boolean columns of the single screens; NULL counts as failed."""
    return {name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()}


def nested(df, passed, labelled=None, engineered=None, strict=None):
    """E1 (all screens), E2 (E1 and the label), E3 (E2 and the stricter demand); E2 and E3 are NULL without labels."""
    e1 = F.lit(True)
    for c in passed:
        e1 = e1 & F.col(c)
    out = df.withColumn("E1", e1)
    if labelled is None:
        return out.withColumns({"E2": F.lit(None).cast("boolean"), "E3": F.lit(None).cast("boolean")})
    out = out.withColumn("E2", F.when(labelled, F.col("E1") & F.coalesce(engineered, F.lit(False))))
    return out.withColumn("E3", F.when(labelled, F.col("E2") & F.coalesce(strict, F.lit(False))))


def ladder(df, steps):
    """Counts left after each further step, in one pass: step number, name, rows."""
    kept, counts = F.lit(True), []
    for i, (_, c) in enumerate(steps.items()):
        kept = kept & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(kept).alias(f"s{i}"))
    wide = df.agg(F.count(F.lit(1)).alias("all"), *counts)
    rows = [F.struct(F.lit(0).alias("step"), F.lit("ALL").alias("name"), F.col("all").alias("n"))]
    rows += [F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("n")) for i, n in enumerate(steps)]
    return wide.select(F.inline(F.array(*rows)))


def bands(value, edges, cap=None):
    """Number of the size band and whether a count reaches the cap at which listings are cut off."""
    number = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value))
    return F.struct(number.alias("band"), (value >= cap if cap is not None else F.lit(False)).alias("truncated"))
