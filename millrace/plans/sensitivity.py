"""Queries of re-estimates without copies, shares by control, overlaps, label joins and formatted reports."""

from pyspark.sql import functions as F

from ..functions import tools as G
from ..operators import estimate as E
from ..operators import statistics as S
from ..session import table
from ..sources import files
from .estimation import FIGURES, POINT_SQL, SEED, R, boot_sql, rounded
from .registry import query


@query(f"""WITH d AS (SELECT source AS cluster, doc_id, coalesce(text, '') AS t, contains(coalesce(text, ''), 'License') AS y FROM documents),
f AS (SELECT cluster, y FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY cluster, doc_id) AS k FROM d) WHERE k = 1),
counts AS (SELECT 'all' AS estimate, cluster, count(*) FILTER (y) AS hits, count(*) AS eligible FROM d GROUP BY cluster
 UNION ALL SELECT 'dedup', cluster, count(*) FILTER (y), count(*) FROM f GROUP BY cluster),
rates AS (SELECT *, hits::DOUBLE / eligible AS rate FROM counts),
{boot_sql('rates')}
SELECT estimate, {POINT_SQL} FROM rates LEFT JOIN bounds ON estimate = b GROUP BY estimate""")
def dedup_sensitivity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(E.dedup_sensitivity(docs, "source", "text", ("source", "doc_id"), F.contains("text", F.lit("License")), None, R, SEED), *FIGURES)


@query(f"""WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) AS rate, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1),
t AS (SELECT c_custkey AS cluster, coalesce(urgent, false) AS side, rate, n_name, r_name FROM customer LEFT JOIN o ON c_custkey = o_custkey
 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
{boot_sql('t', 'side')},
g AS (SELECT side, count(*) AS n, avg(rate) AS mean_value, sum(count(*)) OVER () AS total FROM t GROUP BY side)
SELECT side, n, round(n::DOUBLE / total, 9) AS share,
 round((n::DOUBLE / total + 1.96 ^ 2 / (2 * total) - 1.96 * sqrt((n::DOUBLE / total * (1 - n::DOUBLE / total) + 1.96 ^ 2 / (4 * total)) / total)) / (1 + 1.96 ^ 2 / total), 6) AS share_lo,
 round((n::DOUBLE / total + 1.96 ^ 2 / (2 * total) + 1.96 * sqrt((n::DOUBLE / total * (1 - n::DOUBLE / total) + 1.96 ^ 2 / (4 * total)) / total)) / (1 + 1.96 ^ 2 / total), 6) AS share_hi,
 round(mean_value, 9) AS mean_value, round(lo, 9) AS lo, round(hi, 9) AS hi FROM g LEFT JOIN bounds ON side = b WHERE n >= 11""")
def control_shares(spark, sf_dir):
    """Customers with their order figures, nation and region by three left joins, then shares by side."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(E.share(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("rate"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    t = c.join(o, c["c_custkey"] == o["o_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left")
    out = E.shares_by_side(t, "c_custkey", F.coalesce("urgent", F.lit(False)), "rate", 11, R, SEED)
    out = out.withColumn("w", S.wilson(F.col("n"), F.col("total")))
    return out.select("side", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), F.round("w.lo", 6).alias("share_lo"), F.round("w.hi", 6).alias("share_hi"), *[F.round(c, 9).alias(c) for c in ("mean_value", "lo", "hi")])


NAMES = ("purchase", "signup", "click")


@query("""WITH g AS (SELECT user_id, list_sort(list_intersect(list(DISTINCT event_type), ['purchase', 'signup', 'click'])) AS names FROM events GROUP BY user_id) SELECT * FROM g WHERE len(names) > 0""")
def grants_overlapping(spark, sf_dir):
    asked = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("requested"))
    return asked.select("user_id", G.overlap(F.col("requested"), NAMES).alias("names")).where(F.size("names") > 0)


@query("""WITH s AS (SELECT source, count(*) AS in_source, avg(n_chars) AS mean_chars FROM documents GROUP BY source)
SELECT l.doc_id, l.quality::INT AS quality, d.source, s.in_source, d.n_chars > s.mean_chars AS long FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN s ON d.source = s.source WHERE l.quality IS NOT NULL""")
def sample_labels_to_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("in_source"), F.avg("n_chars").alias("mean_chars"))
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    return labels.join(docs, "doc_id").join(per, "source").select("doc_id", "quality", "source", "in_source", (F.col("n_chars") > F.col("mean_chars")).alias("long"))


@query("""WITH g AS (SELECT l_returnflag, sum(l_quantity) AS q, max(CASE WHEN l_discount > 0.5 THEN l_discount END) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1)
SELECT rpad(l_returnflag, 16, ' ') || lpad(printf('%.2f', q), 10, ' ') || lpad(coalesce(printf('%.2f', d), '-'), 10, ' ') || lpad(printf('%.2f', t), 10, ' ') AS line FROM g""")
def comparison_table(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.max(F.when(F.col("l_discount") > 0.5, F.col("l_discount"))).alias("d"), F.max("l_tax").alias("t"))
    return files.comparison_lines(g, "l_returnflag", ("q", "d", "t"))


@query("""WITH s AS (SELECT o_orderstatus AS status, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, sum(strlen(o_orderpriority)) AS bytes FROM orders GROUP BY 1)
SELECT 'orders' AS table, sum(n)::BIGINT AS n_rows, 6 AS n_columns, min(first) AS first, max(last) AS last, sum(bytes)::BIGINT AS n_bytes, string_agg(coalesce(status, 'none') || '=' || n, ' ' ORDER BY status) AS statuses FROM s""")
def provenance_orders(spark, sf_dir):
    return files.provenance(table(spark, sf_dir, "orders"), "orders", "o_orderdate", "o_orderstatus", "o_orderpriority")
