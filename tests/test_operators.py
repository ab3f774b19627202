import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity as I
from millrace.functions import text as X
from millrace.operators import curation as C
from millrace.operators import estimate as E
from millrace.operators import relational as J
from millrace.operators import sampling as O
from millrace.operators import statistics as S
from millrace.operators import transcripts as R
from millrace.operators.asof import asof
from millrace.operators.ordering import greedy_batches


def rows_of(spark, n_clusters=40, seed=3):
    r = random.Random(seed)
    out = [(c, r.random() < 0.3 + 0.4 * (g == "b"), g) for c in range(n_clusters) for g in "ab" for _ in range(r.randint(1, 6))]
    return spark.createDataFrame(out, "cluster int, y boolean, g string")


def test_estimate_bounds_hold_the_mean(spark):
    got = E.cluster_estimates(rows_of(spark), "cluster", {"y": (F.col("y"), None)}, 200).first()
    assert got["lo"] <= got["mean"] <= got["hi"]
    assert got["n_clusters"] == 40 and got["numerator"] <= got["denominator"]


def test_clusters_without_eligible_rows_are_dropped_and_one_cluster_has_no_bounds(spark):
    df = spark.createDataFrame([(1, True, True), (1, None, True), (2, True, False)], "cluster int, y boolean, e boolean")
    got = E.cluster_estimates(df, "cluster", {"y": (F.col("y"), F.col("e"))}, 50).first()
    assert (got["n_clusters"], got["mean"], got["lo"], got["hi"]) == (1, 0.5, None, None)


def test_contrast_is_antisymmetric_and_needs_ten_clusters(spark):
    df = rows_of(spark)
    a, b = F.col("g") == "a", F.col("g") == "b"
    one, two = E.paired_contrast(df, "cluster", F.col("y"), a, b, 100).first(), E.paired_contrast(df, "cluster", F.col("y"), b, a, 100).first()
    assert one["difference"] == pytest.approx(-two["difference"])
    few = E.paired_contrast(df.where("cluster < 9"), "cluster", F.col("y"), a, b, 100).first()
    assert few["n_clusters"] == 9 and few["difference"] is None and few["excludes_zero"] is None
    assert E.paired_contrast(df.where("cluster < 10"), "cluster", F.col("y"), a, b, 100).first()["difference"] is not None


def test_poisson_bootstrap_agrees_with_the_mean(spark):
    rates = E.cluster_rates(rows_of(spark), "cluster", {"y": (F.col("y"), None)})
    mean = rates.agg(F.avg("rate")).first()[0]
    assert E.bootstrap_means(rates, replicates=200).agg(F.avg("mean")).first()[0] == pytest.approx(mean, abs=0.03)


def test_intraclass_edges(spark):
    one = spark.createDataFrame([(1, True), (1, False)], "cluster int, y boolean")
    assert E.intraclass(one, "cluster", F.col("y")).first()["icc"] is None
    constant = spark.createDataFrame([(c, True) for c in (1, 1, 2, 2)], "cluster int, y boolean")
    assert E.intraclass(constant, "cluster", F.col("y")).first()["icc"] is None
    apart = spark.createDataFrame([(c, c == 1) for c in (1, 1, 2, 2)], "cluster int, y boolean")
    assert E.intraclass(apart, "cluster", F.col("y")).first()["icc"] == pytest.approx(1.0)


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 254), (5, 5)], "k int, n int").select(S.wilson(F.col("k"), F.col("n")).alias("w"))
    a, b, c = [r["w"] for r in df.collect()]
    assert (a["lo"], a["hi"]) == (0.0, 0.0)
    assert b["lo"] == 0.0 and b["hi"] == pytest.approx(0.0149, abs=2e-4)
    assert c["hi"] == 1.0


def test_fisher_textbook_and_extreme_tables(spark):
    t = spark.createDataFrame([("tea", 3, 1, 1, 3), ("zero", 0, 5, 0, 4), ("shell", 270, 0, 0, 270)], "k string, a int, b int, c int, d int")
    got = {r["k"]: r for r in S.fisher_exact(t, ["k"]).collect()}
    assert got["tea"]["p_value"] == pytest.approx(0.4857142857)
    assert got["zero"]["p_value"] == pytest.approx(1.0)
    assert got["shell"]["log10_p"] == pytest.approx(math.log10(1.6e-161), abs=0.02)
    odds = t.select("k", S.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o")).where("k = 'shell'").first()["o"]
    assert odds["odds_ratio"] == pytest.approx(2.9e5, rel=0.02) and odds["lo"] == pytest.approx(5.8e3, rel=0.02)


def test_holm_is_monotone_and_not_below_raw(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.03, 0.9])], "k int, p double")
    got = sorted((r["p"], r["p_holm"]) for r in S.holm(df, "p", ["k"]).collect())
    assert all(b >= a for a, b in got) and [b for _, b in got] == sorted(b for _, b in got)
    assert got[1][1] == got[2][1]


def test_krippendorff_edges(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", None)], "x string, y string")
    assert S.krippendorff(same, "x", "y").first()["alpha"] == pytest.approx(1.0)
    one = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert S.krippendorff(one, "x", "y").first()["alpha"] is None


def test_spearman_of_ties_alone_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert S.spearman(df, "x", "y").first()["rho"] is None


def test_gini_range(spark):
    equal = spark.createDataFrame([(i,) for i in range(5)], "u int")
    assert S.gini(equal, "u").first()["gini"] == pytest.approx(0.0)
    assert 0 < S.gini(spark.createDataFrame([(0,)] * 9 + [(1,)], "u int"), "u").first()["gini"] < 1


def test_override_takes_null_where_the_key_is_present(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    over = spark.createDataFrame([(1, None, ["x"]), (2, None, [])], "k int, x string, has array<string>")
    assert {r["k"]: r["x"] for r in J.override(base, over, "k", ["x"], "has").collect()} == {1: None, 2: "b", 3: "c"}


def test_precedence_takes_whole_records(spark):
    a = spark.createDataFrame([(1, "a", None)], "k int, x string, y string")
    b = spark.createDataFrame([(1, "b", "b"), (2, "b", "b")], "k int, x string, y string")
    got = {r["k"]: (r["x"], r["y"], r["source"]) for r in J.precedence("k", ("a", a), ("b", b)).collect()}
    assert got == {1: ("a", None, "a"), 2: ("b", "b", "b")}


def test_quota_that_cannot_be_met_is_an_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, s string")
    assert O.quota_sample(df, "s", "id", {"a": 2}).count() == 2
    with pytest.raises(Exception, match="stratum too small"):
        O.quota_sample(df, "s", "id", {"b": 2}).collect()


def packed(sizes, budget):
    out, used, batch = [], 0, -1
    for s in sizes:
        if batch < 0 or used + s > budget:
            used, batch = 0, batch + 1
        used += s
        out.append(batch)
    return out


@pytest.mark.parametrize("folded", [100, 3, 0])
def test_greedy_batches(spark, folded):
    r = random.Random(2)
    sizes = {"g": [5, 5, 1, 20, 3], "h": [r.randint(0, 6) for _ in range(90)], None: [11, 12], "z": [0] * 7, "one": [4]}
    df = spark.createDataFrame([(g, 10 * i, s) for g, x in sizes.items() for i, s in enumerate(x)], "g string, i int, s int").repartition(5)
    got = {(r["g"], r["i"]): r["batch"] for r in greedy_batches(df, "g", "i", "s", 10, folded).collect()}
    assert got == {(g, 10 * i): b for g, x in sizes.items() for i, b in enumerate(packed(x, 10))}
    assert greedy_batches(df.where("i < 0"), "g", "i", "s", 10, folded).count() == 0


def test_greedy_batches_of_a_large_group(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("g").alias("g"), "id", F.pmod(F.xxhash64("id"), F.lit(100)).cast("int").alias("s"))
    got = [r["batch"] for r in greedy_batches(df, "g", "id", "s", 10_000, 1000).orderBy("id").select("batch").collect()]
    assert got == packed([r["s"] for r in df.orderBy("id").collect()], 10_000)


def test_lifecycle_edges(spark):
    months = {"202506": 8, "202507": 1, "202508": 1}
    df = spark.createDataFrame([(months,), ({"202401": 0},), ({},)], "m map<string,int>")
    got = [r["l"] for r in df.select(C.lifecycle(F.col("m"), F.lit("2025-08-28").cast("date")).alias("l")).collect()]
    assert got[0]["single_burst"] and got[0]["sustained"] and not got[0]["dormant"] and got[0]["active_months"] == 3
    assert got[1]["active_months"] == 0 and got[1]["dormant"] and got[2]["dormant"]


def test_populations_are_nested_and_null_without_labels(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True)], "a boolean, b boolean")
    got = C.nested(df, ["a"], F.lit(True), F.col("b"), F.lit(True)).collect()
    assert all((not r["E2"] or r["E1"]) and (not r["E3"] or r["E2"]) for r in got)
    assert all(r["E2"] is None for r in C.nested(df, ["a"]).collect())


def test_identities(spark):
    df = spark.createDataFrame([("1.10.0", "1.9.0")], "a string, b string")
    assert df.select(I.version_key(F.col("a")) > I.version_key(F.col("b"))).first()[0]
    got = spark.range(1).select(I.months_before(F.lit("2025-02-10").cast("date"), 3)).first()[0]
    assert got == ["202502", "202501", "202412"]
    link = '<https://x/y?page=2>; rel="next", <https://x/y?per=1&page=34>; rel="last"'
    assert spark.range(1).select(I.page_count(F.lit(link))).first()[0] == 34


def test_sentence_lengths(spark):
    text = "x" * 11 + ".\n" + "y" * 600 + "\n" + "z" * 601 + "\n- " + "w" * 12 + "\n```\ncode that goes away\n```"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(X.sentences(F.col("t")).alias("s")).collect()
    assert [len(s) for s in got[0]["s"]] == [12, 600, 12] and got[1]["s"] == []


def test_state_difference_and_key_values(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "t/x": "1"}, {"a": "1", "b": "3", "c": "1"})], "b map<string,string>, a map<string,string>")
    assert df.select(R.state_difference(F.col("b"), F.col("a"), ("t/",))).first()[0] == ["b", "c"]
    kv = spark.range(1).select(R.key_values(F.lit("debug: true \nport: 80\ndebug: false"))).first()[0]
    assert kv == {"debug": "false", "port": "80"}


def test_numbers_and_ranks_are_those_of_one_sort(spark):
    r = random.Random(11)
    rows = [(i, r.choice("ab"), None if r.random() < 0.1 else r.choice([1.0, 1.0, r.random() * 9])) for i in r.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k int, g string, v double").repartition(7)
    got = {x.k: x.batch for x in O.fixed_batches(df, 40, "k").collect()}
    assert got == {k: i // 40 for i, (k, _, _) in enumerate(sorted(rows))}
    order = {x.k: x.order for x in O.shuffled(df, "k", seed=4).collect()}
    assert order == {x.k: i for i, x in enumerate(df.orderBy(O.order_key(4, "k"), "k").collect())}
    assert O.fixed_batches(df.where("k < 0"), 40, "k").count() == 0
    ranks = {x.k: x["rank"] for x in S.average_ranks(df, "v", ["g"]).collect()}
    key = lambda v: -1.0 if v is None else v
    for k, g, v in rows:
        same = [key(w) for _, h, w in rows if h == g]
        assert ranks[k] == sum(w < key(v) for w in same) + (sum(w == key(v) for w in same) + 1) / 2


def test_log_factorials(spark):
    numbers = [0, 1, 5, 20, 21, 100, 12345, 10**7]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", S.log_factorial(F.col("n")).alias("l")).collect()
    for x in got:
        assert x.l == pytest.approx(math.lgamma(x.n + 1), rel=1e-12, abs=1e-12)


RELEASES = [("1.2.0", "2025-01-01", ["A", "B", "C"]), ("1.9.0", "2025-02-01", ["A", "B"]), ("1.10.0", "2025-03-01", ["A"]), ("2.0.0", "2025-04-01", ["A", "D"])]
ITEMS = [(1, "2025-01-15", ["A", "C"]), (2, "2025-02-01", ["C"]), (3, "2025-03-05", ["B", "C"]), (4, "2025-02-15", ["B", "C"]), (5, "2025-01-01", ["A"])]


def test_names_removed_by_releases(spark):
    releases = spark.createDataFrame(RELEASES, "version string, released string, names array<string>")
    gone = J.removals(releases, I.version_key(F.col("version")), F.col("names"), "released")
    assert sorted(map(tuple, gone.collect())) == [("B", "1.9.0", "1.10.0", "2025-03-01"), ("C", "1.2.0", "1.9.0", "2025-02-01")]
    items = spark.createDataFrame(ITEMS, "item int, d string, names array<string>")
    assert sorted(map(tuple, J.written_after(items, F.col("names"), "d", gone).collect())) == [(1, 1, False), (2, 1, True), (3, 2, True), (4, 2, False), (5, 0, None)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_brute_force(spark, forward, strict):
    r = random.Random(6)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(i, r.choice(keys), r.choice([None, *range(30)])) for i in range(300)] + [(i, "hot", 7) for i in range(300, 340)]
    right = [(r.choice([*keys, "only"]), r.choice([None, *range(30)]), i) for i in range(150)]
    good = lambda at, t: t is not None and at is not None and ((t > at if strict else t >= at) if forward else (t < at if strict else t <= at))
    best = min if forward else max
    want = {i: best(((t, x) for k2, t, x in right if k2 == k and good(at, t)), default=(None, None)) for i, k, at in left}
    one, two = spark.createDataFrame(left, "id int, k string, at int").repartition(5), spark.createDataFrame(right, "k string, t int, x int").repartition(3)
    got = asof(one, two, ["k"], "at", "t", ["t", "x"], forward, strict).collect()
    assert len(got) == len(left) and {row.id: (row.t, row.x) for row in got} == want
    whole = {i: best(((t, x) for _, t, x in right if good(at, t)), default=(None, None)) for i, _, at in left}
    assert {row.id: (row.t, row.x) for row in asof(one, two.drop("k"), [], "at", "t", ["t", "x"], forward, strict).collect()} == whole
    assert asof(one.limit(0), two, ["k"], "at", "t", ["x"]).count() == 0 and asof(one, two.limit(0), ["k"], "at", "t", ["x"]).where("x IS NULL").count() == len(left)


@pytest.mark.parametrize(("ranges", "most"), [(1024, 1 << 16), (4, 3), (7, 0)])
def test_selection_by_ranges(spark, ranges, most):
    r = random.Random(8)
    for values in ([r.choice([-1e300, 1e300, 0.0, 1.5, *[r.gauss(0, 1)] * 3]) for _ in range(101)], [2.0] * 9, [1.0, 2.0], [5.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "v double")
        ordered = sorted(values)
        places = sorted({0, len(values) // 3, len(values) - 1})
        assert [S.at_place(df, "v", k, ranges, most) for k in places] == [ordered[k] for k in places] and S.at_place(df, "v", len(values)) is None
        got, n = S.medians(df, "v", ranges, most).first(), len(values)
        assert (got.n, got.upper_median, got.median) == (n, ordered[n // 2], (ordered[n // 2] + ordered[(n - 1) // 2]) / 2)
    assert tuple(S.medians(df.limit(0), "v").first()) == (0, None, None)


@pytest.mark.parametrize("held", [1 << 17, 3])
def test_strata_without_a_window(spark, held, monkeypatch):
    monkeypatch.setattr(O, "HELD", held)
    r = random.Random(5)
    rows = [(i, r.choice(["hot"] * 8 + ["a", None]), i % 3 == 0) for i in range(400)] + [(7, "hot", True)] * 5
    df = spark.createDataFrame(rows, "id int, g string, ok boolean").repartition(6)
    key = lambda i: hashlib.md5(f"9|{i}".encode()).hexdigest()
    some = O.per_stratum(df, "g", "id", 4, 9)
    assert "Window" not in some._jdf.queryExecution().executedPlan().toString()
    want = {g: sorted((key(i), i) for i, g2, _ in rows if g2 == g)[:4] for g in ("hot", "a", None)}
    assert sorted(((x.g, x.id) for x in some.collect()), key=repr) == sorted(((g, i) for g, x in want.items() for _, i in x), key=repr)
    one = O.one_per_cluster(df, "g", "id", 9, F.col("ok")).collect()
    assert {x.g: x.id for x in one} == {g: min((key(i), i) for i, g2, ok in rows if g2 == g and ok)[1] for g in ("hot", "a", None)}
    assert len(O.quota_sample(df, "g", "id", {"hot": 30, "a": 2}, 9).collect()) == 32
    with pytest.raises(Exception, match="stratum too small: a"):
        O.quota_sample(df, "g", "id", {"a": 4000}, 9).collect()


def test_two_raters_differ_by_the_noise(spark):
    df = spark.range(3000).select("id", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("label"))
    exact, noisy = O.two_raters(df, "id", "label", ["x", "y", "z"], 0.0, 1), O.two_raters(df, "id", "label", ["x", "y", "z"], 0.3, 1)
    assert exact.where("label <> second").count() == 0
    assert 0.12 < noisy.where("label <> second").count() / 3000 < 0.3 and noisy.where("second NOT IN ('x', 'y', 'z')").count() == 0
    assert sorted(map(tuple, noisy.collect())) == sorted(map(tuple, O.two_raters(df.repartition(7), "id", "label", ["x", "y", "z"], 0.3, 1).collect()))
