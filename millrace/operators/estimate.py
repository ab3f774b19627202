"""Cluster-weighted estimation: rates per cluster, bootstrap over clusters, paired contrasts, intra-class correlation.

Every estimate is a pair of boolean columns, the outcome and the population it is asked
of. Any number of them are gathered in one pass over the rows, one group per cluster,
and bootstrapped together: each cluster has a Poisson(1) weight in every replicate, and
tasks add up arrays of weighted sums. The heavy side is thus one aggregation with
map-side combine; what is shuffled after it is an array per task and estimate.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

SEED, REPLICATES, ALPHA = 20260828, 10_000, 0.05
MIN_PAIRED_CLUSTERS = 10


def share(numerator, denominator):
    """A double, NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def cluster_rates(df, cluster, estimates):
    """Long rows (estimate, cluster, hits, eligible, rate); clusters without an eligible row are left out.

    estimates: name -> (outcome, population) as boolean columns; a population of None is all
    rows, a NULL outcome counts as false.
    """
    aggs, stacked = [], []
    for i, (name, (outcome, population)) in enumerate(estimates.items()):
        inside = F.coalesce(population, F.lit(False)) if population is not None else F.lit(True)
        aggs += [F.count_if(inside & F.coalesce(outcome, F.lit(False))).alias(f"h{i}"), F.count_if(inside).alias(f"n{i}")]
        stacked.append(F.struct(F.lit(name).alias("estimate"), F.col(f"h{i}").alias("hits"), F.col(f"n{i}").alias("eligible")))
    wide = df.groupBy(F.col(cluster).alias("cluster")).agg(*aggs)
    return (
        wide.select("cluster", F.inline(F.array(*stacked)))
        .where("eligible > 0")
        .withColumn("rate", share(F.col("hits"), F.col("eligible")))
    )


#: Uniform draws are integers below this prime; the first of an Arrow batch's rows that are weighed at once times the replicates.
PRIME, CELLS = 2**31 - 1, 1 << 22


def poisson_cuts(most=9):
    """The least draws that weigh 1, 2, ...: cumulative probabilities of 0, 1, ... under Poisson(1), times PRIME."""
    cuts, total, term = [], 0.0, 2.718281828459045**-1
    for i in range(1, most + 1):
        total += term
        cuts.append(int(total * PRIME) + 1)
        term /= i
    return cuts


def coins(seed, cluster):
    """Start and step of a cluster's draws, from one md5; its draw for a replicate is (start + step * replicate) modulo PRIME.

    Any two replicates of a cluster are drawn independently, and so are clusters.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), cluster.cast("string")))
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return number(1) % PRIME, 1 + number(16) % (PRIME - 1)


def weighted_sums(rows, by, columns, replicates=REPLICATES, seed=SEED):
    """by, rep, n, w and one sum per column: every cluster's Poisson(1) weight in a replicate times its values, summed.

    Each task adds up arrays as long as the replicates, and only these are shuffled, place
    by place: neither rows nor clusters are unfolded, numbered or joined. Groups with more
    arrays than a task should hold are given out as they come. Rows with a NULL are left out.
    """
    import numpy as np
    import pandas as pd

    by, columns = list(by), list(columns)
    start, step = coins(seed, F.col("cluster"))
    given = rows.select(*by, start.alias("_start"), step.alias("_step"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    given = given.dropna(subset=[f"_{i}" for i in range(len(columns))])
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    names = [*by, "n", *[f"s{i}" for i in range(len(columns) + 1)]]
    types = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n long", *[f"s{i} array<double>" for i in range(len(columns) + 1)]])
    reps, cuts, at_once = np.arange(replicates, dtype=np.int64), np.array(poisson_cuts(), np.int64), max(1, CELLS // replicates)

    def run(frames):
        held = {}

        def out():
            rows = [(*key, n, *sums) for key, (n, sums) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=names)

        for frame in frames:
            places = {}
            for i, key in enumerate(frame[by].astype(object).where(frame[by].notna(), None).itertuples(index=False, name=None)):
                places.setdefault(key, []).append(i)
            for key, of in places.items():
                part = frame.iloc[of]
                for first in range(0, len(part), at_once):
                    some = part.iloc[first : first + at_once]
                    draws = (some["_start"].to_numpy()[:, None] + some["_step"].to_numpy()[:, None] * reps) % PRIME
                    weights = np.searchsorted(cuts, draws, side="right").astype(float)
                    values = np.vstack([np.ones(len(some)), *[some[f"_{i}"].to_numpy() for i in range(len(columns))]])
                    n, sums = held.get(key, (0, 0.0))
                    held[key] = n + len(some), sums + values @ weights
                if len(held) * replicates * len(names) > CELLS:
                    yield out()
        yield out()

    arrays = given.mapInPandas(run, types)
    each = arrays.select(*by, "n", F.posexplode(F.arrays_zip(*[f"s{i}" for i in range(len(columns) + 1)])).alias("rep", "x"))
    sums = [F.sum(f"x.s{i + 1}").alias(c) for i, c in enumerate(columns)]
    return each.groupBy(*by, "rep").agg(F.sum("n").alias("n"), F.sum("x.s0").alias("w"), *sums)


def bootstrap_means(values, by=("estimate",), value="rate", replicates=REPLICATES, seed=SEED):
    """Mean of every replicate of a group of two clusters or more; `values` has one row per cluster. A replicate without a cluster is left out."""
    sums = weighted_sums(values.withColumn("_v", F.col(value)), by, ["_v"], replicates, seed).where("n >= 2 AND w > 0")
    return sums.select(*by, "rep", (F.col("_v") / F.col("w")).alias("mean"))


def percentile_interval(means, by=("estimate",), alpha=ALPHA):
    """Order statistics of R replicates, not interpolated: places int(a/2 R) + 1 and int((1 - a/2) R), counted from one."""
    by = list(by)
    ranked = means.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("mean", "rep"))).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    low, high = F.floor(F.lit(alpha / 2) * F.col("of")) + 1, F.floor(F.lit(1 - alpha / 2) * F.col("of"))
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("place") == low, F.col("mean"))).alias("lo"), F.max(F.when(F.col("place") == high, F.col("mean"))).alias("hi"))


def cluster_estimates(df, cluster, estimates, replicates=REPLICATES, seed=SEED, alpha=ALPHA):
    """One row per estimate: mean and median of cluster rates, bounds, clusters, pooled share and its counts."""
    return summarise(cluster_rates(df, cluster, estimates), ("estimate",), replicates, seed, alpha)


def summarise(rates, by, replicates=REPLICATES, seed=SEED, alpha=ALPHA):
    by = list(by)
    point = rates.groupBy(*by).agg(
        F.avg("rate").alias("mean"),
        F.median("rate").alias("median"),
        F.count(F.lit(1)).alias("n_clusters"),
        share(F.sum("hits"), F.sum("eligible")).alias("pooled"),
        F.sum("hits").alias("numerator"),
        F.sum("eligible").alias("denominator"),
    )
    bounds = percentile_interval(bootstrap_means(rates, by, "rate", replicates, seed), by, alpha)
    return point.join(bounds, by, "left")


def paired_contrast(df, cluster, outcome, group_a, group_b, replicates=REPLICATES, seed=SEED, alpha=ALPHA):
    """Mean within-cluster difference, rate of group B less that of group A, over clusters that have both.

    Rows in both groups count in both. Under ten such clusters every figure is NULL.
    """
    rates = cluster_rates(df, cluster, {"a": (outcome, group_a), "b": (outcome, group_b)})
    both = rates.groupBy("cluster").agg(F.max(F.when(F.col("estimate") == "a", F.col("rate"))).alias("ra"), F.max(F.when(F.col("estimate") == "b", F.col("rate"))).alias("rb"))
    gaps = both.where("ra IS NOT NULL AND rb IS NOT NULL").select(F.lit("b_minus_a").alias("estimate"), "cluster", (F.col("rb") - F.col("ra")).alias("gap"))
    point = gaps.groupBy("estimate").agg(F.avg("gap").alias("difference"), F.count(F.lit(1)).alias("n_clusters"))
    bounds = percentile_interval(bootstrap_means(gaps, ("estimate",), "gap", replicates, seed), ("estimate",), alpha)
    enough = F.col("n_clusters") >= MIN_PAIRED_CLUSTERS
    out = point.join(bounds, "estimate", "left")
    return out.select(
        "estimate",
        "n_clusters",
        *[F.when(enough, F.col(c)).alias(c) for c in ("difference", "lo", "hi")],
        F.when(enough, (F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"),
    )


def intraclass(df, cluster, outcome):
    """One-way intra-class correlation of a 0/1 outcome over clusters of two rows or more, design effect, effective size.

    NULL with one cluster or a constant outcome.
    """
    y = F.coalesce(outcome, F.lit(False)).cast("double")
    per = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s")).where("n >= 2")
    # For 0/1 values the sum of squares is the sum; all sums of squares come from n and s.
    t = per.agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") ** 2).alias("n2"), F.sum("s").alias("s"), F.sum(F.col("s") ** 2 / F.col("n")).alias("ss")
    )
    t = t.withColumn("between", F.try_divide(F.col("ss") - F.try_divide(F.col("s") ** 2, F.col("total")), F.col("k") - 1))
    t = t.withColumn("within", F.try_divide(F.col("s") - F.col("ss"), F.col("total") - F.col("k")))
    t = t.withColumn("m0", F.try_divide(F.col("total") - F.try_divide(F.col("n2"), F.col("total")), F.col("k") - 1))
    t = t.withColumn("icc", F.try_divide(F.col("between") - F.col("within"), F.col("between") + (F.col("m0") - 1) * F.col("within")))
    t = t.withColumn("design_effect", 1 + (F.try_divide(F.col("total"), F.col("k")) - 1) * F.col("icc"))
    return t.select(F.col("k").cast("long").alias("n_clusters"), F.col("total").cast("long").alias("n_rows"), "icc", "design_effect", F.try_divide(F.col("total"), F.col("design_effect")).alias("effective_n"))


def by_size(df, cluster, outcome, population=None, edges=(1, 5, 20), replicates=REPLICATES, seed=SEED):
    """Estimates by cluster size: bins up to each edge, and above the last."""
    rates = cluster_rates(df, cluster, {"x": (outcome, population)})
    sizes = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    label, low = F.lit(f">{edges[-1]}"), [1, *[e + 1 for e in edges]]
    for lo, hi in reversed(list(zip(low, edges, strict=False))):
        label = F.when(F.col("size") <= hi, F.lit(f"{lo}-{hi}" if lo < hi else str(lo))).otherwise(label)
    binned = rates.join(sizes, "cluster").withColumn("size_bin", label)
    return summarise(binned, ("size_bin",), replicates, seed)


def stratified_prevalence(sampled, population, stratum, key, outcome, replicates=2000, seed=SEED, alpha=ALPHA):
    """Prevalence re-weighted to stratum sizes, with a bootstrap within strata.

    Strata that are sampled but not in the population are left out.
    """
    pool = population.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("pool"))
    rows = sampled.select(F.col(stratum).alias("stratum"), F.coalesce(outcome, F.lit(False)).cast("double").alias("y"), F.col(key).alias("cluster"))
    rows = rows.join(pool, "stratum")
    means = rows.groupBy("stratum", "pool").agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n"))
    point = means.agg(share(F.sum(F.col("p") * F.col("pool")), F.sum("pool")).alias("prevalence"), F.sum("n").alias("n_sampled"), F.sum("pool").alias("n_population"))
    reps = bootstrap_means(rows.select("stratum", "cluster", "y"), ("stratum",), "y", replicates, seed).join(pool, "stratum")
    total = reps.groupBy("rep").agg(share(F.sum(F.col("mean") * F.col("pool")), F.sum("pool")).alias("mean")).withColumn("all", F.lit(1))
    return point.crossJoin(F.broadcast(percentile_interval(total, ("all",), alpha).drop("all")))


def ratio_bootstrap(rows, key, numerator, denominator, replicates=REPLICATES, seed=SEED, alpha=ALPHA):
    """Share of numerator rows among denominator rows; rows are resampled, the denominator with them."""
    n, d = (F.coalesce(c, F.lit(False)).cast("double") for c in (numerator & denominator, denominator))
    base = rows.select(F.lit(1).alias("all"), F.col(key).alias("cluster"), n.alias("num"), d.alias("den"))
    point = base.agg(F.sum("num").cast("long").alias("numerator"), F.sum("den").cast("long").alias("denominator"), share(F.sum("num"), F.sum("den")).alias("ratio"))
    # Both sums of a replicate come from the same weights.
    sums = weighted_sums(base, ("all",), ["num", "den"], replicates, seed).where("n >= 2 AND den > 0")
    means = sums.select("all", "rep", (F.col("num") / F.col("den")).alias("mean"))
    return point.crossJoin(F.broadcast(percentile_interval(means, ("all",), alpha).drop("all")))


def two_sample_difference(values, group, a, b, key, value, replicates=REPLICATES, seed=SEED, alpha=ALPHA):
    """Mean of group b less that of group a; the groups are resampled apart, under seeds of their own."""
    rows = values.where(F.col(group).isin(a, b)).select(F.col(group).alias("g"), F.col(key).alias("cluster"), F.col(value).cast("double").alias("v"))
    point = rows.agg((F.avg(F.when(F.col("g") == b, F.col("v"))) - F.avg(F.when(F.col("g") == a, F.col("v")))).alias("difference"))
    one = bootstrap_means(rows.where(F.col("g") == a), ("g",), "v", replicates, f"{seed}a").select("rep", F.col("mean").alias("ma"))
    two = bootstrap_means(rows.where(F.col("g") == b), ("g",), "v", replicates, f"{seed}b").select("rep", F.col("mean").alias("mb"))
    means = one.join(two, "rep").select(F.lit(1).alias("all"), "rep", (F.col("mb") - F.col("ma")).alias("mean"))
    return point.crossJoin(F.broadcast(percentile_interval(means, ("all",), alpha).drop("all")))


def first_copies(df, content, order, keep):
    """One row per content: of its copies the first in the given order, with the columns to keep.

    A partial minimum in place of a window, so that no task gathers the copies of one content.
    """
    first = F.min(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in keep])).alias("x")
    return df.groupBy(F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content")).agg(first).select(*[F.col(f"x._{c}").alias(c) for c in keep])


def dedup_sensitivity(df, cluster, content, order, outcome, population=None, replicates=REPLICATES, seed=SEED):
    """The same estimate over all rows ("all") and over the first copy of each content ("dedup")."""
    flagged = df.withColumns({"y": F.coalesce(outcome, F.lit(False)), "e": F.coalesce(population, F.lit(False)) if population is not None else F.lit(True)})
    once = first_copies(flagged, content, order, [cluster, "y", "e"])
    both = flagged.select(cluster, "y", "e", F.lit("all").alias("rows")).unionByName(once.withColumn("rows", F.lit("dedup")))
    asked = {name: (F.col("y"), F.col("e") & (F.col("rows") == name)) for name in ("all", "dedup")}
    return cluster_estimates(both, cluster, asked, replicates, seed)


def shares_by_side(rows, key, control, value, least=11, replicates=REPLICATES, seed=SEED, alpha=ALPHA):
    """One row per side of a yes/no control over units: their share with Wilson bounds, mean value with bootstrap bounds.

    Units without a value count in the share and not in the mean; sides of fewer than `least` units are left out.
    """
    units = rows.select(control.alias("side"), F.col(key).alias("cluster"), F.col(value).cast("double").alias("v"))
    sides = units.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_value"))
    total = F.broadcast(units.agg(F.count(F.lit(1)).alias("total")))
    bounds = percentile_interval(bootstrap_means(units.where("v IS NOT NULL"), ("side",), "v", replicates, seed), ("side",), alpha)
    return sides.crossJoin(total).where(F.col("n") >= least).join(bounds, "side", "left")
