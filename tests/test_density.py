"""Density clusters against the whole distance matrix, single linkage by sorted edges and the chosen groups by recursion."""

import numpy as np
import pytest

from millrace.operators import density as D


def brute(ids, v, k, smallest):
    """id -> members' set of its cluster, None for outliers; on the graph of each point's k nearest others."""
    n = len(ids)
    d = np.sqrt(np.maximum(((v[:, None, :] - v[None, :, :]) ** 2).sum(2), 0))
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], ids[j]))[:k] for i in range(n)]
    core = [max((d[i, j] for j in near[i]), default=0) for i in range(n)]
    edges = {}
    for i in range(n):
        for j in near[i]:
            a, b = (i, j) if ids[i] < ids[j] else (j, i)
            edges[a, b] = max(d[a, b], core[a], core[b], D.LEAST)
    group = {i: {"points": [i], "kids": [], "w": 0.0} for i in range(n)}
    of = list(range(n))
    for w, _, _, a, b in sorted((w, ids[a], ids[b], a, b) for (a, b), w in edges.items()):
        if of[a] != of[b]:
            one, two = group.pop(of[a]), group.pop(of[b])
            group[of[a]] = {"points": one["points"] + two["points"], "kids": [one, two], "w": w}
            old = of[b]
            for p in two["points"]:
                of[p] = of[a]
            assert old not in group

    def condense(node, birth):
        """(stability, best sum, chosen groups) of a cluster that begins at `birth` and holds node."""
        total, points = 0.0, set(node["points"])
        while True:
            large = [x for x in node["kids"] if len(x["points"]) >= smallest]
            if len(large) == 1:
                total += sum(1 / node["w"] - birth for x in node["kids"] if x is not large[0] for _ in x["points"])
                node = large[0]
                continue
            total += len(node["points"]) * (1 / node["w"] - birth)
            parts = [condense(x, 1 / node["w"]) for x in large]
            inner = sum(p[0] for p in parts)
            return (total, [points]) if total >= inner - 1e-12 else (inner, [c for p in parts for c in p[1]])

    trees = [g for g in group.values() if len(g["points"]) >= smallest]
    chosen = []
    if len(trees) > 1:
        chosen = [c for t in trees for c in condense(t, 0.0)[1]]
    elif trees:
        node = trees[0]
        while len([x for x in node["kids"] if len(x["points"]) >= smallest]) == 1:
            node = next(x for x in node["kids"] if len(x["points"]) >= smallest)
        for x in node["kids"]:
            if len(x["points"]) >= smallest:
                chosen += condense(x, 1 / node["w"])[1]
    return {frozenset(ids[p] for p in c) for c in chosen}


def clouds(seed, spread=0.35):
    r = np.random.default_rng(seed)
    parts = [r.normal(c, spread, (n, 2)) for c, n in (((0, 0), 90), ((3, 0), 70), ((3.8, 0.9), 60), ((0, 4), 40))]
    return np.concatenate([*parts, r.uniform(-3, 7, (40, 2))])


def found(spark, v, **asked):
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(v)) * 3]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in zip(ids, v, strict=True)], "id long, v array<double>")
    groups = {}
    for row in D.topics(df, "id", "v", **asked).collect():
        groups.setdefault(row.topic, set()).add(row.id)
    outliers = groups.pop(-1, set())
    assert sum(map(len, groups.values())) + len(outliers) == len(v)
    assert [len(groups[t]) for t in range(len(groups))] == sorted(map(len, groups.values()), reverse=True)
    return ids, {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize(("seed", "k", "smallest", "followed", "block"), [(0, 5, 15, 1 << 20, 1024), (1, 8, 10, 70, 64), (2, 4, 25, 1 << 20, 50)])
def test_topics_equal_brute_force(spark, seed, k, smallest, followed, block):
    v = clouds(seed)
    ids, got = found(spark, v, k=k, smallest=smallest, followed=followed, block=block, probes=99)
    assert got == brute(ids, v, k, smallest) and len(got) >= 2


def test_copies_and_few_points(spark):
    v = np.concatenate([np.zeros((30, 2)), np.full((30, 2), 5.0), [[2.5, 2.5]]])
    ids, got = found(spark, v, k=3, smallest=10)
    assert sorted(map(len, got)) == [30, 31]  # the trees are not tied, and the far point is a neighbour's only
    assert found(spark, v[:4], k=3, smallest=10)[1] == set()
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert D.topics(empty, "id", "v", smallest=3).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [0.0, 1.0])], "id long, v array<double>")
    assert {(r.id, r.topic) for r in D.topics(rows, "id", "v", smallest=3).collect()} == {(1, -1), (2, -1)}
