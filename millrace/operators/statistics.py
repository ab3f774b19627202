"""Small-sample statistics as expressions and short compositions."""

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .estimate import share
from .sampling import range_bounds, range_of

Z = 1.96


def wilson(successes, trials, z=Z, empty=0.0):
    """Lower and upper Wilson bounds as a struct, clamped to 0..1; (`empty`, `empty`) without trials."""
    k, n = successes.cast("double"), trials.cast("double")
    p = F.try_divide(k, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = F.try_divide(p + F.try_divide(F.lit(z * z / 2), n), scale)
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)), scale)
    none = F.lit(empty).cast("double")
    return F.struct(
        F.when(trials > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(none).alias("lo"), F.when(trials > 0, F.least(F.lit(1.0), centre + half)).otherwise(none).alias("hi")
    )


def average_ranks(df, value, by=(), bounds=None):
    """Rank with ties at their mean, computed on distinct values and joined back; `value` is a number.

    `bounds` is a row of range_bounds that holds those of `value`, where one is at hand.

    The values are cut into ranges, ranked within each, and what stands before a range is
    summed over the ranges alone: neither rows nor values are sorted in one task.
    """
    by = list(by)
    bounds = (range_bounds(df, value) if bounds is None else bounds).select(F.col(f"_bounds_{value}").alias("_b"))
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.crossJoin(F.broadcast(bounds)).withColumn("_cell", range_of(F.col("_v"), F.col("_b"))).drop("_b")
    earlier = Window.unboundedPreceding, -1
    cells = counts.groupBy(*by, "_cell").agg(F.sum("_c").alias("_n"))
    before = cells.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(*earlier)), F.lit(0)))
    before = before.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_cell").alias("_of"), "_before")
    below = counts.withColumn("_below", F.coalesce(F.sum("_c").over(Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(*earlier)), F.lit(0)))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_cell").eqNullSafe(F.col("_of")))
    rank = F.col("_before") + F.col("_below") + (F.col("_c") + 1) / F.lit(2.0)
    named = below.join(before, same).select(*[F.col(c).alias(f"_by_{c}") for c in by], "_v", rank.alias("rank"))
    on = reduce(lambda p, q: p & q, [df[c].eqNullSafe(named[f"_by_{c}"]) for c in by], df[value].eqNullSafe(named["_v"]))
    return df.join(named, on).drop("_v", *[f"_by_{c}" for c in by])


def spearman(df, x, y):
    """Rank correlation with ties at mean rank; NULL where a side is constant."""
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    bounds = range_bounds(pairs, "x", "y")
    ranked = average_ranks(average_ranks(pairs, "x", bounds=bounds).withColumnRenamed("rank", "rx"), "y", bounds=bounds).withColumnRenamed("rank", "ry")
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


#: Ranges that a selection looks at in a round, and rows of a range that are sorted at last.
RANGES, SORTED = 1024, 1 << 16


def at_place(df, value, place, ranges=RANGES, most=SORTED):
    """The value at a place, from 0, of a numeric column in ascending order, exactly; None beyond the rows. NULL and NaN are left out.

    A round counts the rows in equal ranges between the least and the greatest value that
    are left, and goes on in the range that holds the place, from its own least to its own
    greatest value. It ends where these are one, or where so few rows are left that one
    task sorts them; no task sorts more, and no more than the ranges' counts are gathered.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    left = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not 0 <= place < left["n"]:
        return None
    while left["low"] < left["high"]:
        inside = rows.where(F.col("v").between(left["low"], left["high"]))
        if left["n"] <= most:
            return inside.agg(F.sort_array(F.collect_list("v"))[place].alias("x")).first()["x"]
        # Halves keep the width of the widest columns finite.
        share = (F.col("v") / 2 - left["low"] / 2) / (left["high"] / 2 - left["low"] / 2)
        cell = F.least(F.floor(share * ranges), F.lit(ranges - 1))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for left in sorted(cells, key=lambda r: r["low"]):
            if place < left["n"]:
                break
            place -= left["n"]
    return left["low"]


def medians(df, value, ranges=RANGES, most=SORTED):
    """One row: n, the median (between two middle values their mean) and the upper median (the greater of them); NULL without rows."""
    n = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).count()
    upper = at_place(df, value, n // 2, ranges, most) if n else None
    lower = upper if n % 2 else at_place(df, value, n // 2 - 1, ranges, most) if n else None
    return df.sparkSession.createDataFrame([(n, (lower + upper) / 2 if n else None, upper)], "n long, median double, upper_median double")


def log_factorial(n):
    """ln n!: exact up to 20, beyond that Stirling's series, good to twelve places."""
    x = n.cast("double")
    series = x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def fisher_exact(tables, key, a="a", b="b", c="c", d="d", tolerance=1e-9):
    """Two-sided Fisher p-value of each 2x2 table (p_value and its log10).

    All tables with the same margins are enumerated, one row each; those no likelier than
    the given one are summed in log space.
    """
    t = tables.select(*key, *[F.col(x).cast("long").alias(f"_{y}") for x, y in zip((a, b, c, d), "abcd", strict=True)])
    t = t.withColumns({"_r": F.col("_a") + F.col("_b"), "_s": F.col("_c") + F.col("_d"), "_k": F.col("_a") + F.col("_c")})
    cells = t.withColumn("_x", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_k") - F.col("_s")), F.least(F.col("_r"), F.col("_k")))))
    # Factorials of the margins are common to all tables; those of the four cells weigh them.
    parts = (F.col("_x"), F.col("_r") - F.col("_x"), F.col("_k") - F.col("_x"), F.col("_s") - F.col("_k") + F.col("_x"))
    cells = cells.withColumn("_lw", -sum((log_factorial(part) for part in parts), F.lit(0.0)))
    over = Window.partitionBy(*key)
    cells = cells.withColumn("_top", F.max("_lw").over(over)).withColumn("_own", F.max(F.when(F.col("_x") == F.col("_a"), F.col("_lw"))).over(over))
    # Summed relative to the given table so that tiny p-values keep their digits.
    near = F.when(F.col("_lw") <= F.col("_own") + tolerance, F.exp(F.col("_lw") - F.col("_own"))).otherwise(0.0)
    out = cells.groupBy(*key).agg(F.sum(F.exp(F.col("_lw") - F.col("_top"))).alias("_total"), F.sum(near).alias("_near"), F.max("_own").alias("_own"), F.max("_top").alias("_top"))
    log10p = (F.ln("_near") + F.col("_own") - F.col("_top") - F.ln("_total")) / F.ln(F.lit(10.0))
    return out.select(*key, F.least(F.lit(1.0), F.pow(F.lit(10.0), log10p)).alias("p_value"), F.least(F.lit(0.0), log10p).alias("log10_p"))


def odds_ratio(a, b, c, d, z=Z):
    """Odds ratio with half a count added to each cell, and Woolf bounds, as a struct."""
    a, b, c, d = (x.cast("double") + 0.5 for x in (a, b, c, d))
    log = F.ln(a * d / (b * c))
    half = z * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.struct(F.exp(log).alias("odds_ratio"), F.exp(log - half).alias("lo"), F.exp(log + half).alias("hi"))


def holm(df, p, key, by=()):
    """Step-down adjusted p-values; equal p-values get equal results."""
    order = Window.partitionBy(*by).orderBy(p, *key)
    every = Window.partitionBy(*by)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(every) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def krippendorff(pairs, x, y):
    """Nominal alpha of two raters, raw agreement and number of items; alpha NULL for one item or one category."""
    both = pairs.select(F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    values = both.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    expected = values.agg(F.sum("c").alias("n"), F.sum(F.col("c") ** 2).alias("c2"))
    observed = both.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.col("x") != F.col("y")).cast("double")).alias("do"))
    both_rows = observed.crossJoin(F.broadcast(expected))
    de = F.try_divide(F.col("n") ** 2 - F.col("c2"), F.col("n") * (F.col("n") - 1))
    alpha = F.when((F.col("n_items") > 1) & (de > 0), 1 - F.try_divide(F.col("do"), de))
    return both_rows.select("n_items", (1 - F.col("do")).alias("agreement"), alpha.alias("alpha"))


def consensus(votes, item, rater, value, least=2):
    """Value with a strict majority of an item's votes, NULL without one or with under `least` votes."""
    per = votes.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count_distinct(rater).alias("c"))
    tops = per.groupBy(item).agg(F.sum("c").alias("n_votes"), F.max(F.struct("c", F.col(value).alias("v"))).alias("top"))
    won = (F.col("n_votes") >= least) & (2 * F.col("top.c") > F.col("n_votes"))
    return tops.select(item, "n_votes", F.when(won, F.col("top.v")).alias("consensus"))


def lorenz(df, unit):
    """Cumulative shares of units and of rows, smallest units first, over the sizes of units."""
    sizes = df.groupBy(unit).agg(F.count(F.lit(1)).alias("size"))
    grouped = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("units"))
    running = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return grouped.select(
        "size", "units",
        share(F.sum("units").over(running), F.sum("units").over(total)).alias("unit_share"),
        share(F.sum(F.col("size") * F.col("units")).over(running), F.sum(F.col("size") * F.col("units")).over(total)).alias("row_share"),
    )


def gini(df, unit):
    """Gini coefficient of unit sizes by trapezoids under the Lorenz curve; units of equal size are one step."""
    curve = lorenz(df, unit)
    order = Window.orderBy("size")
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(0.0))
    area = (F.col("unit_share") - before("unit_share")) * (F.col("row_share") + before("row_share")) / 2
    return curve.withColumn("area", area).agg(F.sum("units").alias("n_units"), (1 - 2 * F.sum("area")).alias("gini"))


def survival(df, unit):
    """Share of units of at least each size."""
    sizes = df.groupBy(unit).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("units"))
    up = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select("size", "units", share(F.sum("units").over(up), F.sum("units").over(Window.partitionBy())).alias("survival"))


def histogram(df, value, edges):
    """Counts between fixed edges, lower bound in, upper bound out; values outside are left out, empty bins are kept."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    number = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value))) - 1
    counts = df.select(number.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def threshold_sweep(scored, score, truth, thresholds):
    """Precision, recall and F1 of score >= t for each threshold; NULL where undefined."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    told = scored.select(F.col(score).alias("s"), F.coalesce(F.col(truth).cast("boolean"), F.lit(False)).alias("y"), grid.alias("threshold"))
    sums = told.groupBy("threshold").agg(
        F.count_if((F.col("s") >= F.col("threshold")) & F.col("y")).alias("tp"), F.count_if((F.col("s") >= F.col("threshold")) & ~F.col("y")).alias("fp"), F.count_if((F.col("s") < F.col("threshold")) & F.col("y")).alias("fn")
    )
    return sums.withColumns(
        {
            "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )


def npmi(docs, key, tokens, words):
    """Normalised pointwise mutual information of word pairs by documents; -1 where never together, 1 where always in all."""
    own = docs.select(key, F.array_sort(F.array_intersect(F.array_distinct(tokens), F.array(*[F.lit(w) for w in words]))).alias("w"))
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    single = own.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("c"))
    # Pairs come from each document's few words of interest, not from a self-join of documents.
    pairs = own.select(F.explode(F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    together = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).cast("double").alias("c_ab"))
    grid = F.broadcast(docs.sparkSession.createDataFrame([(a, b) for i, a in enumerate(sorted(words)) for b in sorted(words)[i + 1 :]], "a string, b string"))
    s = F.broadcast(single)
    full = grid.join(together, ["a", "b"], "left").join(s.select(F.col("word").alias("a"), F.col("c").alias("c_a")), "a", "left").join(s.select(F.col("word").alias("b"), F.col("c").alias("c_b")), "b", "left").crossJoin(F.broadcast(n))
    pab = F.coalesce("c_ab", F.lit(0.0)) / F.col("n")
    value = F.ln(pab / (F.col("c_a") / F.col("n") * (F.col("c_b") / F.col("n")))) / -F.ln(pab)
    return full.select("a", "b", F.when(pab == 0, -1.0).when(pab == 1, 1.0).otherwise(value).alias("npmi"))
