"""Queries of labels, raters, models and streams."""

import uuid

from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import models as M
from ..operators import sampling as O
from ..session import shared_dir, table
from .registry import query


@query("SELECT * FROM (VALUES (1), (5)) t(id)")
def label_domains_inline(spark, sf_dir):
    rows = [(1, "ENGINEERED", "high", ["QUALITY"]), (2, "NOT_SOFTWARE", "high", ["QUALITY"]), (3, "UNCLEAR", None, ["QUALITY"]), (4, "UNCLEAR", "low", []), (5, "UNCLEAR", "low", ["OTHER", "VCS"]), (6, "UNCLEAR", "low", ["X"])]
    return A.valid(spark.createDataFrame(rows, "id int, category string, confidence string, topics array<string>"), ["category", "confidence"], ["topics"]).select("id")


@query("""SELECT role AS part, 'c' || (conv_id % 3) AS coder, count(*) AS n_items, count(text) AS n_coded, count(*) FILTER (turn % 4 = 0) AS n_unsure,
quantile_disc(length(text), 0.5 ORDER BY length(text) DESC)::INT AS median_seconds FROM conversations GROUP BY 1, 2""".replace("quantile_disc(length(text), 0.5 ORDER BY length(text) DESC)", "list_sort(list(length(text)))[count(*) // 2 + 1]"))
def coder_statistics(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    answers = t.select(F.col("role").alias("part"), F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")).alias("coder"), F.col("text").alias("label"), (F.col("turn") % 4 == 0).alias("unsure"), F.char_length("text").alias("seconds"))
    return A.coder_statistics(answers)


@query("SELECT md5(text) AS item, count(*)::BIGINT AS n_specs, count(DISTINCT source) AS n_repos FROM documents GROUP BY 1")
def item_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("item"), "doc_id", "source")
    return A.item_table(docs, "item", "doc_id", "source")


@query("""WITH a AS (SELECT doc_id, quality AS x FROM labels), b AS (SELECT doc_id, 1 - toxic AS y FROM labels WHERE (quality = 1 OR toxic = 1)), p AS (SELECT x::VARCHAR AS x, y::VARCHAR AS y FROM a JOIN b USING (doc_id)),
c AS (SELECT v, count(*)::DOUBLE AS c FROM (SELECT x AS v FROM p UNION ALL SELECT y FROM p) GROUP BY v), e AS (SELECT sum(c) AS n, sum(c * c) AS c2 FROM c), o AS (SELECT count(*) AS n_items, avg((x <> y)::INT) AS d FROM p)
SELECT n_items, round(1 - d, 9) AS agreement, round(1 - d / ((n * n - c2) / (n * (n - 1))), 9) AS alpha, (SELECT count(*) FROM labels WHERE quality = 0 AND toxic = 0) AS n_missing FROM o, e""")
def third_rater(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    out = A.third_rater(labels.select("doc_id", F.col("quality").cast("int").alias("v")), labels.where("(quality = 1 OR toxic = 1)").select("doc_id", (1 - F.col("toxic")).cast("int").alias("v")), "doc_id", "v")
    return out.withColumns({c: F.round(c, 9) for c in ("agreement", "alpha")})


@query("SELECT * FROM (VALUES ('r', 'a', 'x', true), ('r', 'a', 'y', false), ('r', 'a', 'general', false)) t(repo, config_root, name, registered)")
def census_inline(spark, sf_dir):
    specs = spark.createDataFrame([("r", "a", "x"), ("r", "a", "y"), ("r", "a", "general"), ("r", "b", "z"), ("q", "a", "x")], "repo string, config_root string, name string")
    census = spark.createDataFrame([("r", "a", True, ["x", "general"], ["general"]), ("q", "a", False, ["x"], [])], "repo string, config_root string, ok boolean, agents array<string>, builtin array<string>")
    return A.registered(specs, census)


@query("""WITH c AS (SELECT lang, avg((quality = 1)::INT) AS one, avg((toxic = 0)::INT) AS two FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT lang, round(one, 9) AS one, round(two, 9) AS two FROM c""")
def rater_sensitivity(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("v"))
    other = A.with_label(rows, table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("w")), "doc_id", "w", "v")
    mean = lambda df, n: df.groupBy("lang").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias(n))
    return mean(rows, "one").join(mean(other, "two"), "lang")


@query("SELECT 3::BIGINT AS n_tests, 0.4857142857::DOUBLE AS min_p, 4::BIGINT AS n_least, 9::BIGINT AS n_most")
def build_comparison_inline(spark, sf_dir):
    cells = spark.createDataFrame([("x", 1, 3, 4), ("x", 2, 1, 4), ("y", 1, 0, 9), ("y", 2, 0, 9), ("z", 1, 1, 5), ("w", 1, 2, 4), ("w", 3, 2, 4)], "cell string, build int, k long, n long")
    return A.smallest_build_difference(cells, "cell", "build", "k", "n").withColumn("min_p", F.round("min_p", 10))


@query("SELECT event_type AS task, 'c' || (user_id % 2) AS config, 'm' AS model, count(*) AS n, count(*) FILTER (value > 50) AS n_changed, count(*) FILTER (value > 90) AS n_found, count(*) FILTER (event_id % 3 = 0) AS n_file_tool, count(*) FILTER (event_id % 3 = 1) AS n_shell FROM events GROUP BY 1, 2")
def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("task"), F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("config"), F.lit("m").alias("model"), (F.col("value") > 50).alias("changed"), (F.col("value") > 90).alias("found"),
        F.when(F.col("event_id") % 3 == 0, "file-tool").when(F.col("event_id") % 3 == 1, "shell").otherwise("none").alias("pathway"),
    )
    return A.summarise_runs(e)


@query("SELECT * FROM (VALUES ('label', 'b'), ('macro', '\\section'), ('macro', '\\ref'), ('macro', '\\label'), ('macro', '\\newcommand')) t(kind, name)")
def manuscript_references_inline(spark, sf_dir):
    rows = spark.createDataFrame([("x", r"\section \label{a} \ref{a} \ref{b} \newcommand{\num} \num")], "path string, text string")
    return A.document_references(rows)


@query()
def vector_classifier(spark, sf_dir):
    v = O.split(table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id", 4, (0.7, 0.3), ("train", "test"))
    out = M.one_vs_rest(v.where("part = 'train'"), v.where("part = 'test'"), "embedding", "label", 0)
    return out.select("vec_id", "label", "score")


@query()
def topics_by_density(spark, sf_dir):
    """Clusters of at least five vectors by density, outliers as -1."""
    from ..operators import density

    return density.topics(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", smallest=5, k=3)


@query()
def vector_clusters(spark, sf_dir):
    return M.clusters(table(spark, sf_dir, "embeddings"), "embedding", 8).select("vec_id", "label", "cluster")


@query("""WITH f AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{2,}')) AS word FROM documents), tf AS (SELECT lang, word, count(*) AS tf FROM f GROUP BY 1, 2),
s AS (SELECT lang, sum(tf) AS size FROM tf GROUP BY 1), o AS (SELECT word, sum(tf) AS al FROM tf GROUP BY 1), m AS (SELECT avg(size) AS mean FROM s),
r AS (SELECT lang, word, tf::DOUBLE / size * ln(1 + mean / al) AS score, row_number() OVER (PARTITION BY lang ORDER BY tf::DOUBLE / size * ln(1 + mean / al) DESC, word) AS rank FROM tf JOIN s USING (lang) JOIN o USING (word), m)
SELECT lang, rank::INT AS rank, word, round(score, 9) AS score FROM r WHERE rank <= 5""")
def cluster_words(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z0-9+#.-]{2,}"), F.lit(0))
    return M.cluster_words(table(spark, sf_dir, "documents").select("lang", "text"), "lang", words, 5).withColumn("score", F.round("score", 9))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    """The table as a stream; every window's last count is what a batch would give."""
    from ..streaming.incremental import windowed_counts

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = _events_stream(spark, sf_dir, schema)
    base = shared_dir(spark)
    root = f"{base}/streamed-{uuid.uuid4().hex}"
    counts = windowed_counts(stream.withColumn("at", F.col("ts").cast("timestamp")), "at", "event_type", "1 day", "1 hour")

    def keep(batch, number):
        batch.select("window.start", "event_type", "n").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(f"{root}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR AS goes_on FROM events WHERE ts IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
c AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run)
SELECT * FROM c WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def runs_closed_by_time(spark, sf_dir):
    """The table as a stream: runs of a user's events no more than six hours apart, given out once an hour has passed their end by as much."""
    from ..streaming.stateful import closed_runs, run_to_table

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    run_to_table(closed_runs(_events_stream(spark, sf_dir, schema), "ts", "user_id", 6 * 3600), f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema("user_id long, first timestamp_ntz, last timestamp_ntz, n long").parquet(f"{root}/out")


def _events_stream(spark, sf_dir, schema):
    if _is_folder(spark, sf_dir):
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir)


def _is_folder(spark, sf_dir):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
