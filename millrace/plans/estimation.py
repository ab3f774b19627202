"""Queries of the estimation core and of small-sample statistics."""

from pyspark.sql import functions as F

from ..operators import estimate as E
from ..operators import statistics as S
from ..session import table
from .registry import query

R, STRATIFIED_R, SEED = E.REPLICATES, 2000, E.SEED
FIGURES = ("mean", "median", "pooled", "lo", "hi")


def urgent():
    return F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")


def rounded(df, *columns, places=9):
    return df.withColumns({c: F.round(c, places) for c in columns})


def weights_sql(source, by, columns, seed=SEED, tag="", reps=R):
    """CTE sums (b, rep, n, w and the sum of each column) over `source` (by, cluster, columns), by Poisson weights of its clusters."""
    weight = " + ".join(f"(u >= {c})::INT" for c in E.poisson_cuts())
    digest = f"md5('{seed}|' || cluster)"
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    own = ", ".join(f"{c}::DOUBLE AS {c}" for c in columns)
    return f"""
coins{tag} AS (SELECT {by} AS b, {own}, ('0x' || substr({digest}, 1, 15))::BIGINT % {E.PRIME} AS start, 1 + ('0x' || substr({digest}, 16, 15))::BIGINT % {E.PRIME - 1} AS step FROM {source} WHERE {known}),
weighed{tag} AS (SELECT b, rep, {", ".join(columns)}, {weight} AS w FROM (SELECT *, (start + step * rep) % {E.PRIME} AS u FROM coins{tag}, range({reps}) AS r(rep)) drawn),
sums{tag} AS (SELECT b, rep, count(*) AS n, sum(w) AS w, {", ".join(f"sum(w * {c}) AS {c}" for c in columns)} FROM weighed{tag} GROUP BY b, rep)"""


def interval_sql(source):
    """b, lo, hi over replicates (b, rep, mean)."""
    return f"""SELECT b, max(CASE WHEN place = floor(0.025::DOUBLE * r) + 1 THEN mean END) AS lo, max(CASE WHEN place = floor(0.975::DOUBLE * r) THEN mean END) AS hi
FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY mean, rep) AS place, count(*) OVER (PARTITION BY b) AS r FROM {source}) ranked GROUP BY b"""


def boot_sql(source, by="estimate", value="rate", seed=SEED, tag="", reps=R):
    """CTEs reps (b, rep, mean) and bounds (b, lo, hi) over `source` (by, cluster, value)."""
    return f"""{weights_sql(source, by, [value], seed, tag, reps)},
reps{tag} AS (SELECT b, rep, {value} / w AS mean FROM sums{tag} WHERE n >= 2 AND w > 0),
bounds{tag} AS ({interval_sql(f"reps{tag}")})"""


POINT_SQL = """round(avg(rate), 9) AS mean, round(median(rate), 9) AS median, count(*) AS n_clusters,
       round(sum(hits)::DOUBLE / sum(eligible), 9) AS pooled, sum(hits)::BIGINT AS numerator, sum(eligible)::BIGINT AS denominator,
       round(max(lo), 9) AS lo, round(max(hi), 9) AS hi"""


@query(f"""WITH rates AS (SELECT 'urgent' AS estimate, o_custkey AS cluster, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS hits,
       count(*) AS eligible, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH'))::DOUBLE / count(*) AS rate FROM orders GROUP BY o_custkey),
{boot_sql('rates')}
SELECT estimate, {POINT_SQL} FROM rates LEFT JOIN bounds ON estimate = b GROUP BY estimate""")
def cluster_estimate_urgent(spark, sf_dir):
    return rounded(E.cluster_estimates(table(spark, sf_dir, "orders"), "o_custkey", {"urgent": (urgent(), None)}, R, SEED), *FIGURES)


@query(f"""WITH counts AS (SELECT 'urgent' AS estimate, o_custkey AS cluster, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS hits, count(*) AS eligible FROM orders GROUP BY o_custkey
 UNION ALL SELECT 'urgent_open', o_custkey, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')), count(*) FILTER (o_orderstatus = 'O') FROM orders GROUP BY o_custkey),
rates AS (SELECT *, hits::DOUBLE / eligible AS rate FROM counts WHERE eligible > 0),
{boot_sql('rates')}
SELECT estimate, {POINT_SQL} FROM rates LEFT JOIN bounds ON estimate = b GROUP BY estimate""")
def cluster_estimate_poisson(spark, sf_dir):
    asked = {"urgent": (urgent(), None), "urgent_open": (urgent(), F.col("o_orderstatus") == "O")}
    return rounded(E.cluster_estimates(table(spark, sf_dir, "orders"), "o_custkey", asked, R, SEED), *FIGURES)


@query(f"""WITH base AS (SELECT l_suppkey AS cluster, l_returnflag = 'R' AS y, l_quantity > 25 AS e1, l_discount > 0.05 AS e2 FROM lineitem),
counts AS (SELECT 'all' AS estimate, cluster, count(*) FILTER (y) AS hits, count(*) AS eligible FROM base GROUP BY cluster
 UNION ALL SELECT 'large', cluster, count(*) FILTER (y AND e1), count(*) FILTER (e1) FROM base GROUP BY cluster
 UNION ALL SELECT 'discounted', cluster, count(*) FILTER (y AND e2), count(*) FILTER (e2) FROM base GROUP BY cluster),
rates AS (SELECT *, hits::DOUBLE / eligible AS rate FROM counts WHERE eligible > 0),
{boot_sql('rates')}
SELECT estimate, {POINT_SQL} FROM rates LEFT JOIN bounds ON estimate = b GROUP BY estimate""")
def cluster_estimate_population(spark, sf_dir):
    returned = F.col("l_returnflag") == "R"
    asked = {"all": (returned, None), "large": (returned, F.col("l_quantity") > 25), "discounted": (returned, F.col("l_discount") > 0.05)}
    return rounded(E.cluster_estimates(table(spark, sf_dir, "lineitem"), "l_suppkey", asked, R, SEED), *FIGURES)


@query(f"""WITH rates0 AS (SELECT o_custkey AS cluster, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS hits, count(*) AS eligible FROM orders GROUP BY o_custkey),
rates AS (SELECT *, hits::DOUBLE / eligible AS rate, CASE WHEN eligible <= 1 THEN '1' WHEN eligible <= 5 THEN '2-5' WHEN eligible <= 20 THEN '6-20' ELSE '>20' END AS size_bin FROM rates0),
{boot_sql('rates', 'size_bin')}
SELECT size_bin, {POINT_SQL} FROM rates LEFT JOIN bounds ON size_bin = b GROUP BY size_bin""")
def estimate_by_size_stratum(spark, sf_dir):
    return rounded(E.by_size(table(spark, sf_dir, "orders"), "o_custkey", urgent(), None, (1, 5, 20), R, SEED), *FIGURES)


@query(f"""WITH r AS (SELECT l_suppkey AS cluster, avg((l_discount > 0.05)::INT) FILTER (l_linestatus = 'O') AS ra, avg((l_discount > 0.05)::INT) FILTER (l_linestatus = 'F') AS rb FROM lineitem GROUP BY 1),
gaps AS (SELECT 'b_minus_a' AS estimate, cluster, rb - ra AS gap FROM r WHERE ra IS NOT NULL AND rb IS NOT NULL),
{boot_sql('gaps', 'estimate', 'gap')},
p AS (SELECT estimate, count(*) AS n_clusters, avg(gap) AS difference, max(lo) AS lo, max(hi) AS hi FROM gaps LEFT JOIN bounds ON estimate = b GROUP BY estimate)
SELECT estimate, n_clusters, round(CASE WHEN n_clusters >= 10 THEN difference END, 9) AS difference, round(CASE WHEN n_clusters >= 10 THEN lo END, 9) AS lo,
       round(CASE WHEN n_clusters >= 10 THEN hi END, 9) AS hi, CASE WHEN n_clusters >= 10 THEN lo > 0 OR hi < 0 END AS excludes_zero FROM p""")
def paired_contrast_linestatus(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = E.paired_contrast(lines, "l_suppkey", F.col("l_discount") > 0.05, F.col("l_linestatus") == "O", F.col("l_linestatus") == "F", R, SEED)
    return rounded(out, "difference", "lo", "hi")


@query("""WITH c AS (SELECT l_suppkey, count(*)::DOUBLE AS n, sum((l_discount > 0.05)::INT)::DOUBLE AS s FROM lineitem GROUP BY 1 HAVING count(*) >= 2),
t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS total, sum(n * n) AS n2, sum(s) AS s, sum(s * s / n) AS ss FROM c),
u AS (SELECT *, (ss - s * s / total) / (k - 1) AS msb, (s - ss) / (total - k) AS msw, (total - n2 / total) / (k - 1) AS m0 FROM t),
v AS (SELECT *, (msb - msw) / (msb + (m0 - 1) * msw) AS icc FROM u)
SELECT k::BIGINT AS n_clusters, total::BIGINT AS n_rows, round(icc, 9) AS icc, round(1 + (total / k - 1) * icc, 9) AS design_effect,
       round(total / (1 + (total / k - 1) * icc), 4) AS effective_n FROM v""")
def icc_design_effect(spark, sf_dir):
    out = E.intraclass(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_discount") > 0.05)
    return rounded(rounded(out, "icc", "design_effect"), "effective_n", places=4)


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
       rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT count(*) AS n, round(corr(a::DOUBLE, b::DOUBLE), 9) AS rho FROM r""")
def spearman_qty_price(spark, sf_dir):
    return rounded(S.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "rho")


@query("""WITH r AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem)
SELECT count(*) AS n, round(median(x), 6) AS median, round(max(CASE WHEN k = n // 2 + 1 THEN x END), 6) AS upper_median FROM r""")
def median_prices(spark, sf_dir):
    return rounded(S.medians(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "median", "upper_median", places=6)


WILSON_SQL = """greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))"""


@query(f"""WITH c AS (SELECT n_name, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_name, k::BIGINT AS k, n::BIGINT AS n, round({WILSON_SQL}, 9) AS lo, round(least(1, {WILSON_SQL[12:-1].replace("- 1.96 * sqrt", "+ 1.96 * sqrt")}), 9) AS hi FROM c""")
def wilson_by_nation(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # Counted per nation before names are attached.
    counts = rows.groupBy("c_nationkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    named = counts.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(named.select("n_name", "k", "n", S.wilson(F.col("k"), F.col("n")).alias("w")).select("n_name", "k", "n", "w.*"), "lo", "hi")


@query("""WITH t AS (SELECT o_orderpriority AS g, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1),
u AS (SELECT g, a, b, (sum(a) OVER () - a)::BIGINT AS c, (sum(b) OVER () - b)::BIGINT AS d FROM t),
m AS (SELECT *, a + b AS r, c + d AS s, a + c AS k FROM u),
x AS (SELECT *, unnest(range(greatest(0, k - s), least(r, k) + 1)) AS x FROM m),
w AS (SELECT *, -(lgamma(x + 1) + lgamma(r - x + 1) + lgamma(k - x + 1) + lgamma(s - k + x + 1)) AS lw FROM x),
z AS (SELECT *, max(lw) OVER (PARTITION BY g) AS top, max(CASE WHEN x = a THEN lw END) OVER (PARTITION BY g) AS own FROM w),
p AS (SELECT g, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d,
      least(1.0, exp(ln(sum(CASE WHEN lw <= own + 1e-9 THEN exp(lw - own) ELSE 0 END)) + max(own) - max(top) - ln(sum(exp(lw - top))))) AS p FROM z GROUP BY g),
h AS (SELECT *, row_number() OVER (ORDER BY p, g) AS rn, count(*) OVER () AS m FROM p)
SELECT g, a, b, c, d, round(p, 7) AS p_value, round(max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY p, g), 7) AS p_holm,
       round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))::DOUBLE, 7) AS odds_ratio FROM h""")
def fisher_odds_holm(spark, sf_dir):
    from pyspark.sql import Window

    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") != "F").alias("b"))
    every = Window.partitionBy()
    t = t.select("g", "a", "b", (F.sum("a").over(every) - F.col("a")).alias("c"), (F.sum("b").over(every) - F.col("b")).alias("d"))
    out = S.holm(t.join(S.fisher_exact(t, ["g"]), "g"), "p_value", ["g"])
    out = out.withColumn("odds_ratio", S.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d"))["odds_ratio"])
    return rounded(out.select("g", "a", "b", "c", "d", "p_value", "p_holm", "odds_ratio"), "p_value", "p_holm", "odds_ratio", places=7)


KRIPPENDORFF_SQL = """WITH p AS ({pairs}), v AS (SELECT x AS v FROM p UNION ALL SELECT y FROM p), c AS (SELECT v, count(*)::DOUBLE AS c FROM v GROUP BY v),
e AS (SELECT sum(c) AS n, sum(c * c) AS c2 FROM c), o AS (SELECT count(*) AS n_items, avg((x <> y)::INT) AS d FROM p)
SELECT n_items, round(1 - d, 9) AS agreement, round(1 - d / ((n * n - c2) / (n * (n - 1))), 9) AS alpha FROM o, e"""


@query(KRIPPENDORFF_SQL.format(pairs="SELECT quality::VARCHAR AS x, (n_chars > 1000)::INT::VARCHAR AS y FROM labels JOIN documents USING (doc_id)"))
def krippendorff_labels(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(S.krippendorff(pairs.select("quality", (F.col("n_chars") > 1000).cast("int").alias("long")), "quality", "long"), "agreement", "alpha")


@query("""SELECT round(sum((quality = 1 - toxic)::INT * w)::DOUBLE / sum(w), 9) AS weighted_agreement, round(avg((quality = 1 - toxic)::INT), 9) AS agreement, count(*) AS n
FROM (SELECT quality, toxic, CASE WHEN lang = 'en' THEN 1 ELSE 3 END AS w FROM labels JOIN documents USING (doc_id))""")
def raw_weighted_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    same, w = (F.col("quality") == 1 - F.col("toxic")).cast("int"), F.when(F.col("lang") == "en", 1).otherwise(3)
    return rounded(rows.agg(E.share(F.sum(same * w), F.sum(w)).alias("weighted_agreement"), F.avg(same.cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n")), "weighted_agreement", "agreement")


@query("""WITH v AS (SELECT doc_id, 'a' AS rater, quality AS v FROM labels UNION ALL SELECT doc_id, 'b', 1 - toxic FROM labels UNION ALL SELECT doc_id, 'c', (n_chars > 1000)::INT FROM documents WHERE lang = 'en'),
c AS (SELECT doc_id, v, count(DISTINCT rater) AS c FROM v GROUP BY 1, 2), t AS (SELECT doc_id, sum(c)::BIGINT AS n, max(c) AS top, max_by(v, (c, v)) AS best FROM c GROUP BY 1)
SELECT doc_id, n AS n_votes, CASE WHEN n >= 2 AND 2 * top > n THEN best END AS consensus FROM t""")
def consensus_majority(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    votes = labels.select("doc_id", F.lit("a").alias("rater"), F.col("quality").cast("int").alias("v")).unionByName(labels.select("doc_id", F.lit("b").alias("rater"), (1 - F.col("toxic")).cast("int").alias("v")))
    third = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit("c").alias("rater"), (F.col("n_chars") > 1000).cast("int").alias("v"))
    return S.consensus(votes.unionByName(third), "doc_id", "rater", "v")


@query("""WITH v AS (SELECT 'a' AS r, doc_id, quality AS v FROM labels UNION ALL SELECT 'b', doc_id, 1 - toxic FROM labels UNION ALL SELECT 'c', doc_id, (n_chars > 1000)::INT FROM documents)
SELECT x.r AS rater_a, y.r AS rater_b, count(*) AS n, round(avg((x.v = y.v)::INT), 9) AS agreement FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.r < y.r GROUP BY 1, 2""")
def pairwise_raters(spark, sf_dir):
    from ..operators.relational import rater_pairs

    labels = table(spark, sf_dir, "labels")
    votes = labels.select("doc_id", F.lit("a").alias("r"), F.col("quality").cast("int").alias("v")).unionByName(labels.select("doc_id", F.lit("b").alias("r"), (1 - F.col("toxic")).cast("int").alias("v")))
    votes = votes.unionByName(table(spark, sf_dir, "documents").select("doc_id", F.lit("c").alias("r"), (F.col("n_chars") > 1000).cast("int").alias("v")))
    return rounded(rater_pairs(votes, "doc_id", "r", "v"), "agreement")


@query(f"""WITH pool AS (SELECT lang AS stratum, count(*) AS pool FROM documents GROUP BY 1),
rows AS (SELECT lang AS stratum, doc_id AS cluster, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)),
{boot_sql('rows', 'stratum', 'y', reps=STRATIFIED_R)},
t AS (SELECT 1 AS b, rep, sum(mean * pool) / sum(pool) AS mean FROM reps JOIN pool ON b = stratum GROUP BY rep),
o AS ({interval_sql('t')}),
pt AS (SELECT avg(y) AS p, count(*) AS n, any_value(pool) AS pool FROM rows JOIN pool USING (stratum) GROUP BY stratum)
SELECT round(sum(p * pool) / sum(pool), 9) AS prevalence, sum(n)::BIGINT AS n_sampled, sum(pool)::BIGINT AS n_population,
       (SELECT round(lo, 9) FROM o) AS lo, (SELECT round(hi, 9) FROM o) AS hi FROM pt""")
def stratified_prevalence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    sampled = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rounded(E.stratified_prevalence(sampled, docs, "lang", "doc_id", F.col("quality") == 1, STRATIFIED_R, SEED), "prevalence", "lo", "hi")


@query(f"""WITH base AS (SELECT 1 AS one, doc_id AS cluster, (toxic = 1 AND quality = 1)::INT AS num, (quality = 1)::INT AS den FROM labels),
{weights_sql('base', 'one', ['num', 'den'])},
q AS (SELECT b, rep, num / den AS mean FROM sums WHERE n >= 2 AND den > 0),
o AS ({interval_sql('q')})
SELECT sum(num)::BIGINT AS numerator, sum(den)::BIGINT AS denominator, round(sum(num)::DOUBLE / sum(den), 9) AS ratio,
       (SELECT round(lo, 9) FROM o) AS lo, (SELECT round(hi, 9) FROM o) AS hi FROM base""")
def conditional_ratio_bootstrap(spark, sf_dir):
    return rounded(E.ratio_bootstrap(table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 1, F.col("quality") == 1, R, SEED), "ratio", "lo", "hi")


@query(f"""WITH base AS (SELECT c_custkey AS cluster, c_mktsegment AS g, c_acctbal AS v FROM customer),
ga AS (SELECT * FROM base WHERE g = 'AUTOMOBILE'), gb AS (SELECT * FROM base WHERE g = 'BUILDING'),
{boot_sql('ga', 'g', 'v', f'{SEED}a', 'x')},
{boot_sql('gb', 'g', 'v', f'{SEED}b', 'y')},
q AS (SELECT 1 AS b, repsx.rep, repsy.mean - repsx.mean AS mean FROM repsx JOIN repsy USING (rep)),
o AS ({interval_sql('q')})
SELECT round((SELECT avg(v) FROM gb) - (SELECT avg(v) FROM ga), 6) AS difference, (SELECT round(lo, 6) FROM o) AS lo, (SELECT round(hi, 6) FROM o) AS hi""")
def two_sample_diff(spark, sf_dir):
    return rounded(E.two_sample_difference(table(spark, sf_dir, "customer"), "c_mktsegment", "AUTOMOBILE", "BUILDING", "c_custkey", "c_acctbal", R, SEED), "difference", "lo", "hi", places=6)


@query("""WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), g AS (SELECT size, count(*) AS units FROM s GROUP BY 1),
l AS (SELECT size, units, sum(units) OVER w::DOUBLE / sum(units) OVER () AS u, sum(size * units) OVER w::DOUBLE / sum(size * units) OVER () AS r FROM g WINDOW w AS (ORDER BY size)),
t AS (SELECT *, (u - lag(u, 1, 0) OVER (ORDER BY size)) * (r + lag(r, 1, 0) OVER (ORDER BY size)) / 2 AS area FROM l)
SELECT sum(units)::BIGINT AS n_units, round(1 - 2 * sum(area), 9) AS gini FROM t""".replace("sum(units) OVER w::DOUBLE", "(sum(units) OVER w)::DOUBLE").replace("sum(size * units) OVER w::DOUBLE", "(sum(size * units) OVER w)::DOUBLE"))
def gini_orders(spark, sf_dir):
    return rounded(S.gini(table(spark, sf_dir, "orders"), "o_custkey"), "gini")


@query("""WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), g AS (SELECT size, count(*) AS units FROM s GROUP BY 1)
SELECT size, units, round((sum(units) OVER w)::DOUBLE / sum(units) OVER (), 9) AS unit_share, round((sum(size * units) OVER w)::DOUBLE / sum(size * units) OVER (), 9) AS row_share FROM g WINDOW w AS (ORDER BY size)""")
def lorenz_curve(spark, sf_dir):
    return rounded(S.lorenz(table(spark, sf_dir, "orders"), "o_custkey"), "unit_share", "row_share")


@query("""WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), g AS (SELECT size, count(*) AS units FROM s GROUP BY 1)
SELECT size, units, round((sum(units) OVER (ORDER BY size DESC))::DOUBLE / sum(units) OVER (), 9) AS survival FROM g""")
def survival_sizes(spark, sf_dir):
    return rounded(S.survival(table(spark, sf_dir, "orders"), "o_custkey"), "survival")


@query("""WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), e AS (SELECT i::INT AS bin, power(2, i)::DOUBLE AS low, power(2, i + 1)::DOUBLE AS high FROM range(8) t(i))
SELECT bin, low, high, count(o_custkey) AS n FROM e LEFT JOIN s ON size >= low AND size < high GROUP BY 1, 2, 3""")
def team_size_hist(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    return S.histogram(sizes, "size", [2**i for i in range(9)])


@query("""WITH t AS (SELECT unnest(range(1, 20)) AS i), s AS (SELECT (n_chars % 100) / 100.0 AS s, quality = 1 AS y FROM labels JOIN documents USING (doc_id)),
c AS (SELECT i / 20.0 AS t, count(*) FILTER (s >= i / 20.0 AND y) AS tp, count(*) FILTER (s >= i / 20.0 AND NOT y) AS fp, count(*) FILTER (s < i / 20.0 AND y) AS fn FROM t, s GROUP BY 1)
SELECT t::DOUBLE AS threshold, tp, fp, fn, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9)::DOUBLE AS f1 FROM c""")
def lr_threshold_sweep(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("s", F.col("n_chars") % 100 / F.lit(100.0))
    return rounded(S.threshold_sweep(scored, "s", "quality", [i / 20 for i in range(1, 20)]), "precision", "recall", "f1")


@query("""SELECT round((SELECT sum(size) FROM (SELECT count(*) AS size FROM orders GROUP BY o_custkey ORDER BY size DESC LIMIT (SELECT ceil(count(DISTINCT o_custkey) / 10.0)::BIGINT FROM orders)))::DOUBLE / (SELECT count(*) FROM orders), 9) AS share_top""")
def top_tenth_share(spark, sf_dir):
    from pyspark.sql import Window

    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size"))
    grouped = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("units"))
    down = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    quota = F.ceil(F.sum("units").over(Window.partitionBy()) / 10.0)
    taken = F.greatest(F.lit(0), F.least(F.col("units"), quota - F.coalesce(F.sum("units").over(down), F.lit(0))))
    return rounded(grouped.select(taken.alias("t"), "size", "units").agg(E.share(F.sum(F.col("t") * F.col("size")), F.sum(F.col("units") * F.col("size"))).alias("share_top")), "share_top")
