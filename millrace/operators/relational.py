"""Joins and set operations with the semantics the analyses need.

Sides that are dimensions by nature are joined plainly: Spark broadcasts a side on its
measured size and merges otherwise. Nothing here hints a broadcast of a table of unknown size.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .asof import asof


def first_per_key(df, key, *order):
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_by(df, key, order):
    """The row of each key with the greatest order value, as one aggregation."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(key, "_r.*")


def resume(todo, done, *keys):
    """Rows whose key is not done yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def within(df, population, *keys):
    """Rows whose key is in a population."""
    return df.join(population.select(*keys), list(keys), "left_semi")


def precedence(key, *sources):
    """Union of sources of one record per key; the earliest source that has the key gives the whole record.

    sources: (name, frame) from most to least preferred, with the same columns.
    """
    ranked = [df.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b), ranked)
    rest = [c for c in union.columns if c not in (key, "_rank")]
    return union.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("_r")).select(key, "_r.*")


def override(base, over, key, columns, present):
    """Left join whose right side replaces a column wherever it has the key's field, even with NULL.

    present: column of the right side, an array of the fields it carries.
    """
    right = over.select(key, F.col(present).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(right, key, "left")
    taken = {c: F.when(F.coalesce(F.array_contains("_has", c), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(taken).drop("_has", *[f"_{c}" for c in columns])


def shared_across(df, value, unit, least=2):
    """Rows with how many distinct units hold their value, and whether at least `least` do.

    Counting units is a two-step aggregation, so a value all units share is no hot task.
    """
    counts = df.select(value, unit).distinct().groupBy(value).agg(F.count(F.lit(1)).alias("n_units"))
    return df.join(counts, value).withColumn("shared", F.col("n_units") >= least)


def key_difference(expected, got, key):
    """Keys of one side only: missing (expected, not got) and unexpected."""
    a, b = expected.select(key).distinct(), got.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("unexpected")))


def same_sequence(a, b, group, order, value):
    """Whether two tables hold the same values in the same order, per group."""
    seq = lambda df, name: df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    return seq(a, "s1").join(seq(b, "s2"), group, "full").select(group, F.col("s1").eqNullSafe(F.col("s2")).alias("same"))


def rater_pairs(votes, item, rater, value):
    """Agreement of every two raters over the items both judged.

    Pairs come from each item's few votes, not from a join of all votes.
    """
    per = votes.where(F.col(value).isNotNull()).groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("r"), F.col(value).alias("v")))).alias("vs"))
    pairs = per.select(F.explode(F.flatten(F.transform("vs", lambda a: F.transform(F.filter("vs", lambda b: b["r"] > a["r"]), lambda b: F.struct(a["r"].alias("rater_a"), b["r"].alias("rater_b"), (a["v"] == b["v"]).cast("double").alias("same")))))).alias("p"))
    return pairs.groupBy("p.rater_a", "p.rater_b").agg(F.count(F.lit(1)).alias("n"), F.avg("p.same").alias("agreement"))


def factorial(spark, **factors):
    """Full-factorial design: one row for each combination of the given levels."""
    design = spark.range(0, 1, 1, 1)  # unfolded in one task: joins of frames would multiply their partitions
    for name, levels in factors.items():
        values = [F.lit(v).cast("long") if type(v) is int else F.lit(v) for v in levels]
        design = design.withColumn(name, F.explode(F.array(*values)))
    return design.select(*factors)


def written_after(items, names, date, removals, name="name", removed="removed_on"):
    """Per item: share of its names that some release removed, and whether it was written on or after all their removals.

    Items without such a name count in neither class (NULL).
    """
    key = "item"
    flat = items.select(F.col(key), F.col(date).alias("_d"), F.explode(names).alias(name))
    hit = flat.join(removals.select(name, removed), name)
    per = hit.groupBy(key).agg(F.count(F.lit(1)).alias("n_removed"), F.bool_and(F.col("_d") >= F.col(removed)).alias("after_all"))
    return items.select(key).join(per, key, "left").select(key, F.coalesce("n_removed", F.lit(0)).alias("n_removed"), "after_all")


def removals(releases, version_key, names, date):
    """For each name: the last release that has it and the first later one, with its date; names never removed are left out.

    A release may come in several rows, each with some of its names.
    """
    listed = releases.select(version_key.alias("_v"), "version", F.col(date).alias("removed_on"), names.alias("_names"))
    last = listed.select(F.explode("_names").alias("name"), "_v", "version").groupBy("name").agg(F.max(F.struct("_v", "version")).alias("last"))
    later = listed.select("_v", F.col("version").alias("first_without"), "removed_on").distinct()
    out = asof(last.select("name", F.col("last._v").alias("_last"), F.col("last.version").alias("last_with")), later, [], "_last", "_v", ["first_without", "removed_on"], forward=True, strict=True)
    return out.where("first_without IS NOT NULL").drop("_last")


def reconcile(old, new, key, value):
    """Counts of keys that stayed the same, changed, came new or went."""
    a, b = old.select(key, F.col(value).alias("_o"), F.lit(1).alias("_in_o")), new.select(key, F.col(value).alias("_n"), F.lit(1).alias("_in_n"))
    status = F.when(F.col("_in_o").isNull(), "new").when(F.col("_in_n").isNull(), "gone").when(F.col("_o").eqNullSafe(F.col("_n")), "same").otherwise("changed")
    return a.join(b, key, "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def declared_against_accepted(declared, accepted, key, names):
    """Per key: how many names were declared, accepted, rejected and extra."""
    j = declared.select(key, F.col(names).alias("d")).join(accepted.select(key, F.col(names).alias("a")), key, "left")
    d, a = F.array_distinct("d"), F.coalesce(F.array_distinct("a"), F.array().cast("array<string>"))
    return j.select(key, F.size(d).alias("n_declared"), F.size(F.array_intersect(d, a)).alias("n_accepted"), F.size(F.array_except(d, a)).alias("n_rejected"), F.size(F.array_except(a, d)).alias("n_extra"))


def with_default_status(wanted, got, keys, status="status", default="not-attempted"):
    """Every wanted row with the status it got, or the default."""
    return wanted.join(got.select(*keys, status), list(keys), "left").withColumn(status, F.coalesce(F.col(status), F.lit(default)))


def occurrences(df, key, cluster):
    """Rows and distinct clusters per key, ranked by clusters, then rows, then key."""
    per = df.groupBy(key, cluster).agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"))
    return per.orderBy(F.desc("n_clusters"), F.desc("n_rows"), key)


def top(df, key, k):
    """The k most frequent keys; ties go to the lesser key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def shadowed(df, root, name):
    """Per root: names beyond the first of each kind, and how many names are repeated."""
    per = df.groupBy(root, name).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(root).agg(F.sum(F.col("c") - 1).alias("n_shadowed"), F.count_if(F.col("c") > 1).alias("n_names"))
