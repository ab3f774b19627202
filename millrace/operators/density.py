"""Density clusters of vectors: a neighbour graph, its mutual-reachability spanning forest, and the clusters that last longest.

Neighbours are sought in the cells nearest to a point (a cell: the points nearest to one
of a bounded number of pivots), block by block. An edge weighs the distance of its ends
or the distance either has to its k-th neighbour, if more. The forest is grown by
components that each take their least edge. Its edges are then followed from short to
long, a bounded number a round: groups of points appear, take in single points and merge,
and the sums that decide which of them are clusters are carried along. Points that are in
no chosen group stay outliers.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

#: Pivots and points of a block at most, and forest edges that a task follows.
PIVOTS, BLOCK, FOLLOWED = 256, 1024, 1 << 20
#: Distances below this count as this, so that densities stay finite.
LEAST = 1e-9


def _distances(a, b):
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _matrix(column):
    return np.array(column.tolist(), np.float64)


def neighbours(df, key, vector, k, probes=8, block=BLOCK):
    """a, b, d: each point's k nearest others in the cells of the `probes` pivots nearest to it; exact with as many probes as cells.

    Cells of many points are cut into blocks, and so are those who ask there, so a task
    compares `block` points with as many, whatever a cell holds.
    """
    points = df.select(F.col(key).cast("long").alias("a"), F.col(vector).cast("array<double>").alias("v"))
    n = points.count()
    chosen = points.orderBy(F.xxhash64("a"), "a").limit(max(1, min(PIVOTS, -(-n // block)))).collect()
    if not chosen:
        return points.select("a", F.col("a").alias("b"), F.lit(0.0).alias("d"))
    pivots = np.array([r["v"] for r in chosen])

    def assign(frames):
        for frame in frames:
            if len(frame):
                near = np.argsort(_distances(_matrix(frame["v"]), pivots), axis=1, kind="stable")[:, :probes]
                yield frame.assign(cells=near.astype(np.int32).tolist())

    placed = stored(points.mapInPandas(assign, "a long, v array<double>, cells array<int>"), "placed")
    home = placed.select("a", "v", F.col("cells")[0].alias("cell"))
    asking = placed.select("a", "v", F.explode("cells").alias("cell"))
    counts = {r["cell"]: r["n"] for r in home.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # PIVOTS at most
    asked = {r["cell"]: r["n"] for r in asking.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = lambda sizes: F.element_at(F.array(*[F.lit(-(-sizes.get(i, 1) // block)) for i in range(len(pivots))]), F.col("cell") + 1)
    slot = lambda sizes: F.pmod(F.xxhash64("a"), parts(sizes)).cast("int")
    every = lambda sizes: F.explode(F.sequence(F.lit(0), (parts(sizes) - 1).cast("int")))
    held = home.withColumn("m", slot(counts)).withColumn("q", every(asked))
    seekers = asking.where(F.col("cell").isin(list(counts))).withColumn("q", slot(asked)).withColumn("m", every(counts))

    def nearest(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "d": []})
        ids = right["a"].to_numpy()
        d = _distances(_matrix(left["v"]), _matrix(right["v"]))
        d[left["a"].to_numpy()[:, None] == ids[None, :]] = np.inf
        order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
        out = pd.DataFrame({"a": np.repeat(left["a"].to_numpy(), order.shape[1]), "b": ids[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()})
        return out[np.isfinite(out["d"])]

    met = seekers.groupBy("cell", "m", "q").cogroup(held.groupBy("cell", "m", "q")).applyInPandas(nearest, "a long, b long, d double")
    best = met.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, k).alias("x"))
    return best.select("a", F.inline("x")).select("a", "b", "d")


def reachability(near, k):
    """a < b and w: the mutual-reachability weight of every pair of neighbours; who has fewer than k neighbours is as far as the last."""
    core = near.groupBy("a").agg(F.max("d").alias("core"))
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    both = pairs.join(core.withColumnRenamed("core", "ca"), "a").join(core.select(F.col("a").alias("b"), F.col("core").alias("cb")), "b")
    return both.select("a", "b", F.greatest("d", "ca", "cb", F.lit(LEAST)).alias("w"))


def spanning_forest(edges):
    """The least spanning forest of edges (a, b, w), ties by a and b, and the label (node, root) of every node.

    Every round each component takes its least edge outward, and what the edges tie
    becomes one component, so half of them go at least.
    """
    left = stored(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    taken = []
    while not left.isEmpty():
        out = left.select(F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("o"), "w", "a", "b"), F.struct(F.col("y").alias("c"), F.col("x").alias("o"), "w", "a", "b"))).alias("e")).select("e.*")
        least = stored(out.groupBy("c").agg(F.min(F.struct("w", "a", "b", "o")).alias("e")).select("c", "e.*"), "least")
        taken.append(least.select("a", "b", "w").distinct())
        # Two components that took the same edge: the lesser is the root of both.
        other = least.select(F.col("c").alias("o"), F.col("a").alias("oa"), F.col("b").alias("ob"))
        to = least.join(other, "o").select("c", F.when((F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("to"))
        roots = jumped(stored(to, "to"))
        x, y = (roots.select(F.col("c").alias(s), F.col("to").alias(f"{s}_to")) for s in "xy")
        left = stored(left.join(x, "x").join(y, "y").where("x_to <> y_to").select("a", "b", "w", F.col("x_to").alias("x"), F.col("y_to").alias("y")), "edges")
        labels = stored(labels.join(roots.withColumnRenamed("c", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
    empty = edges.select("a", "b", "w").limit(0)
    for t in taken:
        empty = empty.unionByName(t)
    return empty, labels


def jumped(to):
    """Pointers (c, to) of trees followed to their roots, twice as far each round."""
    while True:
        further = to.select(F.col("c").alias("to"), F.col("to").alias("next"))
        after = stored(to.join(further, "to", "left").select("c", F.coalesce("next", "to").alias("next"), "to"), "jumps")
        if after.where("next <> to").isEmpty():
            return to
        to = after.select("c", F.col("next").alias("to"))


OUT = "kind string, comp long, joined long, size long, cluster string, parent string, wins boolean, sum double, n long, kids double"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _closed(state, density):
    """What a group's stability is when it ends in a larger one: whether it beats the groups within, and the better sum."""
    stability = state["sum"] - state["n"] * density
    return stability >= state["kids"], max(stability, state["kids"])


def _followed(smallest):
    """Follow a group's edges from short to long; states of its components come along with them."""

    def run(frame):
        states = {r.comp: {"size": int(r.size), "cluster": r.cluster, "sum": r.sum, "n": r.n, "kids": r.kids} for r in frame[frame["kind"] == "state"].itertuples()}
        edges = frame[frame["kind"] == "edge"].sort_values(["w", "a", "b"])
        up, loose, rows, entered = {}, {}, [], {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def state(x):
            if x not in states:
                states[x] = {"size": 1, "cluster": None}
            if x not in loose:
                loose[x] = [x] if states[x]["cluster"] is None else []
            return states[x]

        for e in edges.itertuples():
            one, two = find(e.x), find(e.y)
            s, t, density = state(one), state(two), 1 / e.w
            name, size = f"{e.a}-{e.b}", s["size"] + t["size"]
            if s["cluster"] is None and t["cluster"] is None:
                new = {"size": size, "cluster": None}
                if size >= smallest:
                    new = {"size": size, "cluster": name, "sum": size * density, "n": size, "kids": 0.0}
            elif s["cluster"] is None or t["cluster"] is None:
                large, small = (s, t) if t["cluster"] is None else (t, s)
                new = large | {"size": size, "sum": large["sum"] + small["size"] * density, "n": large["n"] + small["size"]}
            else:
                kids = 0.0
                for old in (s, t):
                    wins, best = _closed(old, density)
                    kids += best
                    rows.append(("cluster", None, None, None, old["cluster"], name, wins, None, None, None))
                new = {"size": size, "cluster": name, "sum": (s["n"] + t["n"]) * density, "n": s["n"] + t["n"], "kids": kids}
            free = loose.pop(one) + loose.pop(two)
            if new["cluster"] is not None:
                entered.update((x, new["cluster"]) for x in free)
                free = []
            up[two] = one
            states[one], loose[one] = new, free
        for x in list(up):
            r = find(x)
            rows.append(("point", x, r, None, entered.get(x), None, None, None, None, None))
            if r == x:
                s = states[x]
                rows.append(("state", x, None, s["size"], s["cluster"], None, None, s.get("sum"), s.get("n"), s.get("kids")))
        return pd.DataFrame(rows, columns=COLUMNS)

    return run


def chosen_groups(forest, trees, smallest, followed=FOLLOWED):
    """node, cluster: the chosen group that a point of the forest is in, NULL for outliers.

    `trees` are the labels of the forest. A round follows as many edges as a task may; what
    hangs together by them is a task of its own.
    """
    forest = stored(forest, "forest")
    n = forest.count()
    rounds = max(1, -(-n // followed))
    bounds = [0.0] + (forest.agg(F.percentile_approx("w", [i / rounds for i in range(1, rounds)], 10 * rounds)).first()[0] if rounds > 1 else []) + [float("inf")]
    points = trees.select("node", F.col("node").alias("comp"), F.lit(None).cast("string").alias("cluster"))
    states, closed = None, []
    for low, high in zip(bounds, bounds[1:], strict=False):
        some = forest.where((F.col("w") > low) & (F.col("w") <= high))
        at = points.select("node", "comp")
        some = some.join(at.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(at.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        some = stored(some, "followed")
        own = trees if rounds == 1 else spanning_forest(some.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w"))[1]
        rows = some.join(own.withColumnRenamed("node", "x"), "x").withColumn("kind", F.lit("edge"))
        if states is not None:
            known = states.where("kind = 'state'").select("kind", "comp", "size", "cluster", "sum", "n", "kids")
            rows = rows.unionByName(known.join(own.withColumnRenamed("node", "comp"), "comp"), allowMissingColumns=True)
        else:
            rows = rows.selectExpr("*", "CAST(NULL AS BIGINT) comp", "CAST(NULL AS BIGINT) size", "CAST(NULL AS STRING) cluster", "CAST(NULL AS DOUBLE) sum", "CAST(NULL AS BIGINT) n", "CAST(NULL AS DOUBLE) kids")
        out = stored(rows.groupBy("root").applyInPandas(_followed(smallest), OUT), "rounds")
        closed.append(out.where("kind = 'cluster'").select("cluster", "parent", "wins"))
        went = out.where("kind = 'point'").select("comp", "joined", F.col("cluster").alias("entered"))
        points = stored(points.join(went, "comp", "left").select("node", F.coalesce("joined", "comp").alias("comp"), F.coalesce("cluster", "entered").alias("cluster")), "points")
        kept = out.where("kind = 'state'")
        if states is not None:  # components that no edge of the round touched
            kept = kept.unionByName(states.join(went.select("comp"), "comp", "left_anti").select(*COLUMNS))
        states = stored(kept, "states")
    # What is left are whole trees: with several they end where nothing is dense, a single one is no cluster.
    last = states.where("cluster IS NOT NULL").select("cluster", F.lit(None).cast("string").alias("parent"), (F.col("sum") >= F.col("kids")).alias("wins"))
    several = F.broadcast(last.agg((F.count(F.lit(1)) > 1).alias("several")))
    ended = last.crossJoin(several).select("cluster", "parent", (F.col("several") & F.col("wins")).alias("wins"))
    for c in closed:
        ended = ended.unionByName(c)
    return points.select("node", F.col("cluster").alias("first")).join(winners(stored(ended, "groups")), F.col("first") == F.col("of"), "left").select("node", "cluster")


def winners(groups):
    """of, cluster: the uppermost group that wins among a group and those it ends in, by pointers followed twice as far each round."""
    now = groups.select(F.col("cluster").alias("of"), "parent", F.when(F.col("wins"), F.col("cluster")).alias("cluster"))
    while not now.where("parent IS NOT NULL").isEmpty():
        above = now.select(F.col("of").alias("parent"), F.col("parent").alias("next"), F.col("cluster").alias("upper"))
        now = stored(now.join(above, "parent", "left").select("of", F.col("next").alias("parent"), F.coalesce("upper", "cluster").alias("cluster")), "winners")
    return now.select("of", "cluster")


def topics(df, key, vector, smallest=80, k=None, probes=8, block=BLOCK, followed=FOLLOWED):
    """key, topic: the density cluster of every row, numbered from 0 by size, -1 for outliers.

    `smallest` is the least size of a cluster, `k` the neighbours that make a point dense
    (by default as many). Rows without a vector are outliers; keys are unique. With fewer
    rows than make a cluster all are outliers.
    """
    known = stored(df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("_vector")), "vectors")
    k = k or smallest
    edges = stored(reachability(stored(neighbours(known, "_key", "_vector", k, probes, block), "neighbours").where("a <> b"), k), "reach")
    forest, labels = spanning_forest(edges)
    found = stored(chosen_groups(forest, labels, smallest, followed), "found")
    sizes = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    numbers = sizes.select("cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("topic"))
    own = found.join(numbers, "cluster").select(F.col("node").alias("_node"), "topic")
    return df.select(key).join(own, F.col(key).cast("long") == F.col("_node"), "left").select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))
