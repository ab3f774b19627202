"""Keyed state that outlives a run: outcomes frozen when first seen, runs closed by event-time timers."""

import contextlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def keyed_state(spark):
    """The state store that this kind of state needs, while a query is started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def plain(value):
    """A pandas value as the state takes it."""
    if value is None or (not isinstance(value, list | tuple | dict) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


class FirstOutcome(StatefulProcessor):
    """Gives out a key's first outcome, the least of each column in the batch that brings it, and nothing ever after."""

    def __init__(self, schema, n_keys):
        self.schema, self.n_keys = schema, n_keys

    def init(self, handle):
        self.frozen = handle.getValueState("frozen", StructType(self.schema.fields[self.n_keys :]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known = self.frozen.exists()
        names = [f.name for f in self.schema.fields[self.n_keys :]]
        least = dict.fromkeys(names)
        for frame in rows:  # read to the end, kept or not
            for name in names if not known else ():
                for value in map(plain, frame[name]):
                    if value is not None and (least[name] is None or value < least[name]):
                        least[name] = value
        if not known:
            values = tuple(least[name] for name in names)
            self.frozen.update(values)
            yield pd.DataFrame([(*key, *values)], columns=self.schema.names, dtype=object)

    def close(self):
        pass


def score_once(stream, key, frozen, sink, checkpoint):
    """Append each key's first outcome to a table, once for ever: what is frozen lives in the checkpoint's state.

    The table is never read. A restart goes on from the checkpoint; later rows of a key
    change nothing. Within the batch that brings a key first each column's least value
    counts; NULL where it has none. A NULL key is a key.
    """
    schema = StructType([StructField(c, stream.schema[c].dataType) for c in (key, *frozen)])
    with keyed_state(stream.sparkSession):
        first = stream.select(key, *frozen).groupBy(key).transformWithStateInPandas(FirstOutcome(schema, 1), schema, "append", "none")
        return first.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class ClosedRuns(StatefulProcessor):
    """Open runs of a key as (first, last, rows); a timer at the end of the first to be over gives out and forgets all that are."""

    def __init__(self, schema, gap):
        self.schema, self.gap = schema, gap

    def init(self, handle):
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def runs(self):
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def keep(self, runs):
        if runs:
            self.open.put(runs)
            self.handle.registerTimer(min(self.ends(last) for _, last, _ in runs))  # the next that may be over
        else:
            self.open.clear()

    def ends(self, last):
        """The first millisecond by which a run with this last event is over."""
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        spans = self.runs()
        for frame in rows:
            spans += [(int(t), int(t), 1) for t in frame["micros"]] if len(frame) else []
        joined = []
        for first, last, n in sorted(spans):
            if joined and first - joined[-1][1] <= self.gap:
                joined[-1] = (joined[-1][0], max(last, joined[-1][1]), joined[-1][2] + n)
            else:
                joined.append((first, last, n))
        self.keep(joined)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now, runs = timerValues.getCurrentWatermarkInMs(), self.runs()
        over = [r for r in runs if self.ends(r[1]) <= now]
        if runs and not over:
            self.keep(runs)  # the run of this timer has grown
        if over:
            self.keep([r for r in runs if self.ends(r[1]) > now])
            yield pd.DataFrame([(*key, *r) for r in over], columns=self.schema.names)

    def close(self):
        pass


def closed_runs(stream, time, key, gap, late="1 hour"):
    """key, first, last, n of every run of events no further apart than `gap` (seconds), given out once it is over.

    A run is over when the watermark, `late` behind the latest event, has passed its last
    event by the gap; its state goes then. Events may come in any order within `late`, and
    join runs that they fall between; those behind the watermark are left out, and so are
    events without a time.
    """
    known = stream.where(F.col(time).isNotNull()).withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", late)
    rows = known.select(key, "event_time", F.unix_micros("event_time").alias("micros"))
    schema = StructType([StructField(key, stream.schema[key].dataType), *StructType.fromDDL("first long, last long, n long").fields])
    with keyed_state(stream.sparkSession):
        runs = rows.groupBy(key).transformWithStateInPandas(ClosedRuns(schema, int(gap * 1_000_000)), schema, "append", "EventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return runs.select(key, at("first"), at("last"), "n")


def run_to_table(df, sink, checkpoint):
    """Append a stream's rows to a table, as far as its input reaches now."""
    with keyed_state(df.sparkSession):
        df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
