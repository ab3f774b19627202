"""Queries of joins, set operations, sampling, batching and curation."""

from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import relational as J
from ..operators import sampling as O
from ..operators.asof import asof
from ..operators.ordering import greedy_batches
from ..session import table
from .registry import query


@query("SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_first_per_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("h", F.md5(F.col("text").cast("binary"))).drop("text")
    return J.first_per_key(docs, "h", "source", "doc_id").select("doc_id", "source", "lang", "n_chars")


@query("WITH c AS (SELECT md5(text) AS h, count(DISTINCT source) AS n FROM documents GROUP BY 1) SELECT doc_id, n AS n_units, n >= 2 AS shared FROM documents JOIN c ON md5(text) = h")
def cross_source_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    return J.shared_across(docs, "h", "source").select("doc_id", "n_units", "shared")


@query("""WITH a AS (SELECT doc_id, quality, toxic, 'first' AS source FROM labels WHERE quality = 1), b AS (SELECT doc_id, quality, 1 - toxic AS toxic, 'second' AS source FROM labels WHERE toxic = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL THEN a.quality ELSE b.quality END AS quality, CASE WHEN a.doc_id IS NOT NULL THEN a.toxic ELSE b.toxic END AS toxic,
       CASE WHEN a.doc_id IS NOT NULL THEN a.source ELSE b.source END AS source FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def precedence_label_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("toxic", F.col("toxic").cast("int"))
    first, second = labels.where("quality = 1"), labels.where("toxic = 0").withColumn("toxic", (1 - F.col("toxic")).cast("int"))
    return J.precedence("doc_id", ("first", first), ("second", second))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN s_name ELSE c_name END AS c_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
WHERE s_suppkey IS NOT NULL UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def override_merge(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    over = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"),
        F.when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).alias("c_name"),
        F.when(F.col("s_suppkey") % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("c_name"))).alias("has"),
    )
    return J.override(base, over, "c_custkey", ["c_name"], "has")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_resume(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.resume(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_population(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return J.within(table(spark, sf_dir, "orders"), rich, "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT k, 'missing' AS status FROM (SELECT doc_id AS k FROM documents EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT k, 'unexpected' FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT doc_id FROM documents)""")
def key_set_diff(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return J.key_difference(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")), returned.select(F.col("l_orderkey").alias("k")), "k")


@query("""SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) = list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS same FROM orders GROUP BY 1""")
def sequence_equality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    by_key = orders.select("o_custkey", F.struct("o_orderkey").alias("at"), F.col("o_orderkey").alias("v"))
    by_date = orders.select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("v"))
    return J.same_sequence(by_key, by_date, "o_custkey", "at", "v")


REMOVED_SQL = """m AS (SELECT l_partkey AS name, max(date_trunc('month', l_shipdate)) AS last FROM lineitem GROUP BY 1),
r AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS d FROM lineitem),
g AS (SELECT name, any_value(last) AS last, min(d) AS removed_on FROM m JOIN r ON d > last GROUP BY name)"""


def month(column):
    return F.date_trunc("month", column).cast("timestamp_ntz")


def removed_parts(spark, sf_dir):
    """Months are releases and hold the parts shipped in them."""
    shipped = table(spark, sf_dir, "lineitem").select("l_partkey", month("l_shipdate").alias("m"))
    releases = shipped.distinct().select("m", F.date_format("m", "yyyy-MM").alias("version"), F.array("l_partkey").alias("names"))
    return J.removals(releases, F.col("m"), F.col("names"), "m")


@query(f"WITH {REMOVED_SQL} SELECT name, strftime(last, '%Y-%m') AS last_with, strftime(removed_on, '%Y-%m') AS first_without, removed_on::TIMESTAMP AS removed_on FROM g")
def asof_version_removal(spark, sf_dir):
    return removed_parts(spark, sf_dir)


@query(f"""WITH {REMOVED_SQL},
i AS (SELECT o_orderkey AS item, o_orderdate AS d, l_partkey AS name FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON o_orderkey = l_orderkey)
SELECT item, count(removed_on)::BIGINT AS n_removed, bool_and(d >= removed_on) FILTER (removed_on IS NOT NULL) AS after_all FROM i LEFT JOIN g USING (name) GROUP BY item""")
def written_after_removal(spark, sf_dir):
    """Orders against the months in which their parts were no longer shipped."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("names"))
    orders = table(spark, sf_dir, "orders")
    items = orders.join(parts, orders["o_orderkey"] == parts["l_orderkey"], "left").select(F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("d"), "names")
    return J.written_after(items, F.col("names"), "d", removed_parts(spark, sf_dir))


@query("""WITH s AS (SELECT l_suppkey, l_shipdate, max(l_orderkey) AS shipped FROM lineitem GROUP BY 1, 2),
l AS (SELECT l_orderkey, l_linenumber, l_suppkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l.l_suppkey AS l_suppkey, l_shipdate AS last_shipped, shipped AS last_order FROM l ASOF LEFT JOIN s ON l.l_suppkey = s.l_suppkey AND o_orderdate >= l_shipdate""")
def asof_last_shipment(spark, sf_dir):
    """For each line the supplier's last shipment on or before the day of its order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    left = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "o_orderdate")
    right = lines.select("l_suppkey", F.col("l_shipdate").alias("last_shipped"), F.col("l_orderkey").alias("last_order"))
    out = asof(left, right.withColumn("at", F.col("last_shipped")), ["l_suppkey"], "o_orderdate", "at", ["last_shipped", "last_order"])
    return out.drop("o_orderdate")


@query("""WITH x AS (SELECT config, model, task, rep, md5('7|' || config || '|' || model || '|' || task || '|' || rep) AS h
FROM (SELECT unnest(['C0', 'C1', 'C2']) AS config), (SELECT unnest(['m1', 'm2']) AS model), (SELECT unnest(['T1', 'T2', 'T3', 'T4']) AS task), (SELECT unnest(range(5)) AS rep))
SELECT config, model, task, rep, (row_number() OVER (ORDER BY h, config, model, task, rep) - 1)::INT AS "order" FROM x""")
def factorial_plan(spark, sf_dir):
    plan = J.factorial(spark, config=["C0", "C1", "C2"], model=["m1", "m2"], task=["T1", "T2", "T3", "T4"], rep=list(range(5)))
    return O.shuffled(plan, "config", "model", "task", "rep", seed=7)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def topk_event_types(spark, sf_dir):
    return J.top(table(spark, sf_dir, "events"), "event_type", 3)


@query("SELECT event_type, count(*)::BIGINT AS n_rows, count(DISTINCT user_id) AS n_clusters FROM events GROUP BY 1")
def occurrences_and_clusters(spark, sf_dir):
    return J.occurrences(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT user_id, sum(c - 1)::BIGINT AS n_shadowed, count(*) FILTER (c > 1) AS n_names FROM c GROUP BY 1""")
def shadowed_names(spark, sf_dir):
    return J.shadowed(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""WITH o AS (SELECT doc_id, quality FROM labels WHERE toxic = 0), n AS (SELECT doc_id, toxic FROM labels WHERE quality = 1)
SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'gone' WHEN quality = toxic THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1""")
def reconcile_versions(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return J.reconcile(labels.where("toxic = 0").select("doc_id", F.col("quality").alias("v")), labels.where("quality = 1").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("""SELECT lang, coalesce(s, 'not-attempted') AS status, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'recovered' ELSE 'missing' END AS s FROM labels) USING (doc_id) GROUP BY 1, 2""")
def coverage_by_kind_status(spark, sf_dir):
    got = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "recovered").otherwise("missing").alias("status"))
    return J.with_default_status(table(spark, sf_dir, "documents").select("doc_id", "lang"), got, ["doc_id"]).groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT user_id, list_distinct(list(event_type)) AS x FROM events GROUP BY 1), a AS (SELECT user_id, list_distinct(list(event_type)) AS y FROM events WHERE value > 60 OR event_type = 'none' GROUP BY 1)
SELECT user_id, len(x)::INT AS n_declared, len(list_intersect(x, coalesce(y, [])))::INT AS n_accepted, (len(x) - len(list_intersect(x, coalesce(y, []))))::INT AS n_rejected,
       (len(coalesce(y, [])) - len(list_intersect(x, coalesce(y, []))))::INT AS n_extra FROM d LEFT JOIN a USING (user_id)""")
def parser_against_oracle(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    sets = lambda df: df.groupBy("user_id").agg(F.collect_set("event_type").alias("names"))
    return J.declared_against_accepted(sets(events), sets(events.where("value > 60")), "user_id", "names")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_event(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.struct("ts", "event_id").alias("at"))
    return J.last_by(events, "user_id", F.col("at")).select("user_id", "event_type", "ts")


@query("SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 50")
def simple_sample(spark, sf_dir):
    return O.simple_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 11)


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('5|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 20")
def stratified_sample(spark, sf_dir):
    return O.per_stratum(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 20, 5)


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('6|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 9 WHEN 'fr' THEN 4 WHEN 'de' THEN 3 ELSE 0 END""")
def quota_sample(spark, sf_dir):
    return O.quota_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 9, "fr": 4, "de": 3}, 6)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3|' || doc_id), doc_id) AS rn FROM documents WHERE n_chars > 500) WHERE rn = 1")
def one_per_cluster(spark, sf_dir):
    return O.one_per_cluster(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", 3, F.col("n_chars") > 500).select("doc_id", "source")


@query("""SELECT part, count(*) AS n FROM (SELECT CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS part FROM (SELECT ('0x' || substr(md5('9|' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)) GROUP BY 1""")
def three_way_split(spark, sf_dir):
    return O.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 9).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT batch, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / 150)::INT AS batch FROM documents) GROUP BY 1")
def batch_fixed(spark, sf_dir):
    return O.fixed_batches(table(spark, sf_dir, "documents").select("doc_id"), 150, "doc_id").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("""WITH RECURSIVE i AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (SELECT source, doc_id, n_chars, rn, n_chars AS used, 0 AS batch FROM i WHERE rn = 1
 UNION ALL SELECT i.source, i.doc_id, i.n_chars, i.rn, CASE WHEN f.used + i.n_chars > 10000 THEN i.n_chars ELSE f.used + i.n_chars END, CASE WHEN f.used + i.n_chars > 10000 THEN f.batch + 1 ELSE f.batch END
 FROM f JOIN i ON i.source = f.source AND i.rn = f.rn + 1)
SELECT source, doc_id, batch FROM f""")
def batch_greedy(spark, sf_dir):
    return greedy_batches(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 10000)


@query("""WITH RECURSIVE i AS (SELECT o_orderpriority AS p, o_orderkey, o_totalprice::BIGINT AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders),
f AS (SELECT p, o_orderkey, s, rn, s AS used, 0 AS batch FROM i WHERE rn = 1
 UNION ALL SELECT i.p, i.o_orderkey, i.s, i.rn, CASE WHEN f.used + i.s > 1000000 THEN i.s ELSE f.used + i.s END, CASE WHEN f.used + i.s > 1000000 THEN f.batch + 1 ELSE f.batch END
 FROM f JOIN i ON i.p = f.p AND i.rn = f.rn + 1)
SELECT p AS o_orderpriority, o_orderkey, batch FROM f""")
def batch_greedy_large_groups(spark, sf_dir):
    """Groups of more than a hundred orders are cut by running sums and pointers."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.round("o_totalprice").cast("long").alias("s"))
    return greedy_batches(orders, "o_orderpriority", "o_orderkey", "s", 1000000, folded=100)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def offset_slice(spark, sf_dir):
    return O.page(table(spark, sf_dir, "documents").select("doc_id"), 40, 20, "doc_id")


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS m, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(n >= 5, false) AS a1, coalesce(m >= 3, false) AS a2, coalesce(last >= TIMESTAMP '1998-01-01', false) AS a3, coalesce(c_acctbal > 0, false) AS a4,
       coalesce(n >= 5 AND m >= 3 AND last >= TIMESTAMP '1998-01-01' AND c_acctbal > 0, false) AS "E1",
       coalesce(n >= 5 AND m >= 3 AND last >= TIMESTAMP '1998-01-01' AND c_acctbal > 0, false) AND c_mktsegment = 'BUILDING' AS "E2",
       coalesce(n >= 5 AND m >= 3 AND last >= TIMESTAMP '1998-01-01' AND c_acctbal > 0, false) AND c_mktsegment = 'BUILDING' AND n >= 10 AS "E3"
FROM customer LEFT JOIN c ON c_custkey = k""")
def curation_flags(spark, sf_dir):
    return _curated(spark, sf_dir).select("c_custkey", "a1", "a2", "a3", "a4", "E1", "E2", "E3")


def _curated(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.date_trunc("month", "o_orderdate")).alias("m"), F.max("o_orderdate").alias("last"))
    j = table(spark, sf_dir, "customer").join(per, "c_custkey", "left")
    conditions = {"a1": F.col("n") >= 5, "a2": F.col("m") >= 3, "a3": F.col("last") >= F.lit("1998-01-01").cast("timestamp_ntz"), "a4": F.col("c_acctbal") > 0}
    return C.nested(j.withColumns(C.screens(conditions)), ["a1", "a2", "a3", "a4"], F.lit(True), F.col("c_mktsegment") == "BUILDING", F.col("n") >= 10)


@query("""WITH c AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS m FROM orders GROUP BY 1), j AS (SELECT * FROM customer LEFT JOIN c ON c_custkey = k)
SELECT 0 AS step, 'ALL' AS name, count(*) AS n FROM j UNION ALL SELECT 1, 'orders', count(*) FILTER (n >= 5) FROM j UNION ALL SELECT 2, 'months', count(*) FILTER (n >= 5 AND m >= 3) FROM j
UNION ALL SELECT 3, 'balance', count(*) FILTER (n >= 5 AND m >= 3 AND c_acctbal > 0) FROM j""")
def population_ladder(spark, sf_dir):
    return C.ladder(_curated(spark, sf_dir), {"orders": F.col("n") >= 5, "months": F.col("m") >= 3, "balance": F.col("c_acctbal") > 0})


@query("""WITH m AS (SELECT o_custkey, strftime(o_orderdate, '%Y%m') AS k, count(*) AS n FROM orders GROUP BY 1, 2),
t AS (SELECT o_custkey, count(*)::INT AS active_months, sum(n)::BIGINT AS observed, max(n)::DOUBLE / sum(n) >= 0.8 AS single_burst, count(*) >= 3 AS sustained,
      NOT bool_or(k IN ('199808', '199807', '199806', '199805', '199804', '199803')) AS dormant FROM m GROUP BY 1) SELECT * FROM t""")
def lifecycle_customers(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    per = months.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("monthly"))
    return per.select("o_custkey", C.lifecycle(F.col("monthly"), F.lit("1998-08-15").cast("date")).alias("l")).select("o_custkey", "l.*")


@query("""WITH b AS (SELECT (n_chars >= 0)::INT + (n_chars >= 500)::INT + (n_chars >= 1000)::INT + (n_chars >= 5000)::INT AS band FROM documents), c AS (SELECT band, count(*) AS n FROM b GROUP BY 1) SELECT band, n, n >= 300 AS truncated FROM c""")
def size_bands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(C.bands(F.col("n_chars"), [0, 500, 1000, 5000])["band"].alias("band"))
    return docs.groupBy("band").agg(F.count(F.lit(1)).alias("n")).withColumn("truncated", F.col("n") >= 300)
