"""Queries of report aggregates: pivots, margins, shares, months, embeddings."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import estimate as E
from ..operators import statistics as S
from ..session import table
from ..sources import files
from .registry import query


@query("""SELECT event_type, count(*) FILTER (user_id % 4 = 0) AS c0, count(*) FILTER (user_id % 4 = 1) AS c1, count(*) FILTER (user_id % 4 = 2) AS c2, count(*) FILTER (user_id % 4 = 3) AS c3 FROM events GROUP BY 1""")
def heatmap_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("c", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")))
    return e.groupBy("event_type").pivot("c", ["c0", "c1", "c2", "c3"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT quality = 1 AS a, toxic = 1 AS b, count(*) AS n FROM labels GROUP BY 1, 2")
def crosstab_2x2(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, n, sum(n) OVER (ORDER BY month)::BIGINT AS total FROM m""")
def month_histogram(spark, sf_dir):
    from pyspark.sql import Window

    m = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("total", F.sum("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


@query("""WITH c AS (SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) FILTER (l_discount > 0.05) AS k, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus))
SELECT flag, status, k, n, round(k::DOUBLE / n, 9) AS rate FROM c""")
def rollup_cells(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count(F.lit(1)).alias("n"))
    name = lambda x: F.coalesce(x, F.lit("all"))
    return c.select(name("l_returnflag").alias("flag"), name("l_linestatus").alias("status"), "k", "n", F.round(E.share(F.col("k"), F.col("n")), 9).alias("rate"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INT AS g, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_cells(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_qty"))
    return c


@query("""WITH s AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)
SELECT count(*) AS units, round(avg(n), 9) AS mean_n, round(median(n), 9) AS median_n, max(n) AS max_n, sum(p)::BIGINT AS kinds, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi,
       (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS c FROM s) WHERE rn = c // 2 + 1) AS upper_median FROM s""")
def size_summary(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("p"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    # The upper median is a place in the order, without interpolation; sizes are ranked by their counts.
    out = s.agg(
        F.count(F.lit(1)).alias("units"), F.round(F.avg("n"), 9).alias("mean_n"), F.round(F.median("n"), 9).alias("median_n"), F.max("n").alias("max_n"), F.sum("p").alias("kinds"), F.round(F.min("lo"), 6).alias("lo"), F.round(F.max("hi"), 6).alias("hi"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").alias("upper_median"),
    )
    return out.withColumn("upper_median", F.col("upper_median").cast("long"))


@query("SELECT 'text' AS field, count(text) AS present, round(count(text)::DOUBLE / count(*), 9) AS share FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang <> ''), round(count(*) FILTER (lang <> '')::DOUBLE / count(*), 9) FROM documents")
def field_presence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("text"), F.count_if(X.truthy(F.col("lang"))).alias("lang"))
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), F.round(E.share(F.col(f), F.col("n")), 9).alias("share")) for f in ("text", "lang")]))
    return d.select(rows)


@query("""SELECT source, round(avg((text LIKE '%License%')::INT), 9) AS licence, round(avg((text LIKE '%@%')::INT), 9) AS mail, round(avg((text LIKE '%License%' AND text LIKE '%@%')::INT), 9) AS both FROM documents GROUP BY 1""")
def artifact_cooccurrence(spark, sf_dir):
    a, b = F.col("text").contains("License"), F.col("text").contains("@")
    mean = lambda c: F.round(F.avg(c.cast("double")), 9)
    return table(spark, sf_dir, "documents").groupBy("source").agg(mean(a).alias("licence"), mean(b).alias("mail"), mean(a & b).alias("both"))


@query("""WITH r AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS rate, bool_or(o_orderpriority = '1-URGENT') AS yes FROM orders GROUP BY 1)
SELECT yes, count(*) AS n, round(avg(rate), 9) AS mean_rate FROM r GROUP BY 1 HAVING count(*) >= 11""")
def outcome_by_control(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(E.share(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("rate"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("yes"))
    return r.groupBy("yes").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rate"), 9).alias("mean_rate")).where("n >= 11")


@query("""WITH r AS (SELECT l_suppkey, l_returnflag AS g, avg((l_discount > 0.05)::INT) AS rate FROM lineitem GROUP BY 1, 2), m AS (SELECT g, avg(rate) AS mean FROM r GROUP BY 1) SELECT round(min(mean), 9) AS least, arg_min(g, mean) AS which, count(*) AS n_groups FROM m""")
def min_group_estimate(spark, sf_dir):
    flags = ["A", "N", "R"]
    rates = E.cluster_rates(table(spark, sf_dir, "lineitem"), "l_suppkey", {g: (F.col("l_discount") > 0.05, F.col("l_returnflag") == g) for g in flags})
    means = rates.groupBy("estimate").agg(F.avg("rate").alias("mean"))
    return means.agg(F.round(F.min("mean"), 9).alias("least"), F.min_by("estimate", "mean").alias("which"), F.count(F.lit(1)).alias("n_groups"))


@query("SELECT quality::INT AS a, toxic::INT AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def disagreement_matrix(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("quality").cast("int").alias("a"), F.col("toxic").cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, lang, pool FROM documents JOIN (SELECT lang, count(*) AS pool FROM documents GROUP BY 1) USING (lang)), q AS (SELECT lang, count(*) AS quota FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, any_value(pool) AS pool, any_value(quota) AS quota, round(any_value(pool)::DOUBLE / any_value(quota), 9) AS weight FROM d JOIN q USING (lang) GROUP BY 1""")
def stratum_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    pool = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("pool"))
    quota = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("quota"))
    return pool.join(quota, "lang").withColumn("weight", F.round(E.share(F.col("pool"), F.col("quota")), 9))


@query("SELECT 'orders' AS \"table\", count(*) AS n_rows, 6 AS n_columns FROM orders UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'labels', count(*), 3 FROM labels")
def provenance_manifest(spark, sf_dir):
    return files.manifest({n: table(spark, sf_dir, n) for n in ("orders", "customer", "labels")})


CELLS = [("C0", 343, 359), ("C1", 56, 358), ("C2", 359, 359), ("C3", 41, 359), ("C4", 0, 360)]


@query("""SELECT config, pct::DOUBLE AS pct, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES ('C0', 95.5, 92.9, 97.2), ('C1', 15.6, 12.2, 19.8), ('C2', 100.0, 98.9, 100.0), ('C3', 11.4, 8.5, 15.1), ('C4', 0.0, 0.0, 1.1)) t(config, pct, lo, hi)""")
def experiment_cells(spark, sf_dir):
    c = spark.createDataFrame(CELLS, "config string, k long, n long").withColumn("w", S.wilson(F.col("k"), F.col("n")))
    p = lambda x: F.round(x * 100, 1)
    return c.select("config", p(E.share(F.col("k"), F.col("n"))).alias("pct"), p(F.col("w.lo")).alias("lo"), p(F.col("w.hi")).alias("hi"))


@query("""WITH m AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x::DOUBLE) AS x FROM m GROUP BY 1, 2) SELECT label::INT AS label, count(*) AS dims, round(sqrt(sum(x * x)), 6) AS norm FROM c GROUP BY 1""")
def centroid_norms(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = m.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return c.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("dims"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"))


@query("SELECT date_trunc('month', ts) AS month, count(*) AS n FROM events GROUP BY 1")
def calendar_months(spark, sf_dir):
    from ..streaming.incremental import months

    return months(table(spark, sf_dir, "events"), "ts")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
