"""Structured Streaming forms of the incremental behaviours: append-only logs, dispatch, calendar windows."""

from pyspark.sql import functions as F


def append_log(spark, source, schema, sink, checkpoint, fmt="json"):
    """Copy what is new in a folder of files to a table, exactly once; restart goes on from the checkpoint."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream, time, key, width="1 hour", late="10 minutes"):
    """Counts per event-time window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def dispatch(schedule, ledger, count):
    """The next rows of a schedule that are not in the ledger, in order."""
    return schedule.join(ledger.select("run_id"), "run_id", "left_anti").orderBy("order").limit(count)


def months(df, time):
    """Counts per calendar month."""
    return df.groupBy(F.date_trunc("month", F.col(time)).cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))
