"""The mix against seats given one by one, and the sums that it promises."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as X

SCHEMA = "doc_id long, source string, text string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    sized = {"a": 400, "b": 900, "c": 30, "é": 1500, "z": 200, None: 3}
    out, i = [], 0
    for source, n in sized.items():
        for _ in range(n // 10 + 1):
            out.append((i, source, " ".join("w" for _ in range(r.randint(0, 20)))))
            i += 1
    return [*out, (5000, "a", None), (5001, "empty", ""), (5002, "empty", " \n\t\x0b"), (None, "b", "one two"), (7, "b", "same id"), out[8], (5003, "b", "long " * 30000), (5004, "c", " x y\x1cz")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("size", "target", "place", "shard", "key", "n", "index")}).repartition(4)


def wanted(rows):
    """Targets by sharing anew until none is above its bound."""
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        above = {s for s, x in share.items() if x > 3 * sizes[s]}
        if not above:
            return sizes, share | {s: 3 * sizes[s] for s in capped}
        capped |= above


def test_mix_meets_its_targets(spark, rows):
    sizes, target = wanted(rows)
    got = X.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(target.values()) == pytest.approx(sum(sizes.values()))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, _, t in rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in sizes)
    again = X.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_of_nothing(spark):
    assert X.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = X.mix(spark.createDataFrame([(1, "a", None), (2, None, "  ")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    one = X.mix(spark.createDataFrame([(1, "a", "x y z")], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in one] == [(3, 3, 3.0, 3)]


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 333])
def test_seats_go_to_the_highest_quotients(spark, seats):
    r = random.Random(seats)
    claims = [(g, k, float(r.choice([1, 5, 40, 40, 300, 0])), r.choice([1, 3, 50, 10**6])) for g in (1, 2) for k in range(12)]
    got = X.highest_quotients(
        spark.createDataFrame(claims, "g int, k int, claim double, most long"), spark.createDataFrame([(1, seats), (2, 2 * seats)], "g int, seats long"), ["g"], ["k"], "test"
    )
    want = {}
    for g, n in ((1, seats), (2, 2 * seats)):
        heap = [(-c, k, 1, c, most) for gg, k, c, most in claims if gg == g and c > 0]
        free = all(most >= 10**6 for *_, most in heap)
        heapq.heapify(heap)
        quota = dict.fromkeys((x[1] for x in heap), 0)
        for _ in range(n):
            _, k, a, c, most = heap[0]
            quota[k] += 1
            heapq.heapreplace(heap, (-c / (2 * a + 1), k, a + 1, c, most))
        want |= {(g, k): (q, free) for k, q in quota.items()}
    found = {(x.g, x.k): x.quota for x in got.collect()}
    most = {(g, k): m for g, k, _, m in claims}
    assert set(found) == set(want) and all(found[x] <= most[x] for x in found)
    unbounded = X.highest_quotients(
        spark.createDataFrame([(g, k, c, 10**6) for g, k, c, _ in claims], "g int, k int, claim double, most long"), spark.createDataFrame([(1, seats), (2, 2 * seats)], "g int, seats long"), ["g"], ["k"], "test"
    )
    assert {(x.g, x.k): x.quota for x in unbounded.collect()} == {x: q for x, (q, _) in want.items()}
