"""Exact dedup: streaming state keyed by digest, kept on disk and never expired."""

from pyspark.sql import functions as F

from .common import SPACES, scratch_path, stored, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Else each partition's store sets megabytes of disk aside, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text_col="text"):
    return F.translate(text_or_empty(text_col), SPACES, "")


def digests(docs, id_col="doc_id", text_col="text"):
    """Digest, stable identifier, length and content locator of every row."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(normalised(text_col), 256).alias("digest"),
        F.char_length(text_or_empty(text_col)).alias("n_code_points"),
        F.input_file_name().alias("locator"),
    )


def keyed_state(spark, source, state_dir=None):
    """Stream a folder of digests through keyed state and return its last values.

    The state holds, for each digest ever seen, the row that stays (most code points,
    then smallest id), its locator and the number of rows. It lives in RocksDB under
    the checkpoint in `state_dir`; given the same folder again, only files that came
    since are read. No watermark: a key never expires.
    """
    root = state_dir or scratch_path(spark, "exact-state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        state = rows.groupBy("digest").agg(
            F.min(F.struct((-F.col("n_code_points")).alias("rank"), "doc_id", "locator")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )

        def emit(batch, number):
            batch.write.mode("overwrite").parquet(f"{root}/updates/batch={number}")

        run = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(emit)
            .start()
        )
        run.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    schema = "digest string, best struct<rank:int,doc_id:long,locator:string>, group_size long, batch int"
    updates = spark.read.schema(schema).parquet(f"{root}/updates")
    last = updates.groupBy("digest").agg(F.max(F.struct("batch", "group_size", "best")).alias("u"))
    return last.select("digest", F.col("u.best.doc_id").alias("keep_id"), F.col("u.best.locator").alias("locator"), F.col("u.group_size").alias("group_size"))


def exact_groups(docs, id_col="doc_id", text_col="text", state_dir=None):
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as empty, so
    all empty texts form one group. Ties on length go to the smallest id. Rows that
    repeat an id are counted and answered each, with the same decision. Every hit is
    checked on its full bytes; a document that shares a digest but not the bytes is
    answered as its own group of one.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "digests")
    digests(docs, id_col, text_col).write.parquet(path)
    seen = spark.read.parquet(path)
    state = stored(keyed_state(spark, path, state_dir), "exact-groups")
    members = seen.join(state.drop("locator"), "digest")
    hits = members.where("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "keep_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalised(text_col), 256).alias("digest"), normalised(text_col).alias("bytes"))
    of_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    held = stored(texts.join(hits, of_row).drop("_id", "_digest"), "exact-hits")  # read twice; texts are shuffled once
    keepers = held.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", F.col("bytes").alias("kept_bytes")).dropDuplicates(["digest"])
    others = held.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    unequal = others.join(keepers, "digest").where(F.col("bytes") != F.col("kept_bytes")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    checked = members.join(unequal.withColumn("_unequal", F.lit(True)), of_row, "left")
    return checked.select(
        "doc_id",
        F.when(F.col("_unequal"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(F.col("_unequal"), 1).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (F.coalesce("_unequal", F.lit(False)) | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs, id_col="doc_id", text_col="text"):
    """The documents that stay, with their own columns: one row for each id and text, so texts under a repeated or null id all stay."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_keep_digest")).distinct()
    rows = docs.withColumn("_digest", F.sha2(normalised(text_col), 256))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("_keep_digest"))
    return rows.join(kept, same).dropDuplicates([id_col, "_digest"]).drop("_keep", "_keep_digest", "_digest")
