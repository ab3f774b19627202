"""Substring dedup over word windows: a log-structured index of sorted fingerprint runs.

Documents are cut into chunks of ascending ids. Each chunk is a batch: its distinct
window hashes, sorted, are one immutable run per bucket of the hash space. A bucket's
task takes the runs in chunk order, after those of history, and keeps them in levels:
runs of like size are merge-joined, hits verified by an independent check hash, and
compacted. It answers every chunk with one bit per fingerprint: seen earlier or not.
The chunk then recomputes its windows and drops the words those bits cover. A bucket's
runs hold one entry per chunk and distinct window, so a passage of a third of all
documents costs one entry per chunk, not one per document.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import words as W
from .common import scratch_path, ship

CHUNK_BYTES = 8 << 20
MAX_CELLS = 1024
SEED, CHECK_SEED = 41, 43


def encode_run(values, check):
    """Sorted 64-bit values as byte planes of their differences, and the 16-bit checks."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.uint32(len(values)).tobytes() + bytes([width]) + np.ascontiguousarray(planes).tobytes() + check.astype("<u2").tobytes()


def decode_run(data):
    n, width = int(np.frombuffer(data, "<u4", 1)[0]), data[4]
    planes = np.frombuffer(data, np.uint8, n * width, 5).reshape(width, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), np.frombuffer(data, "<u2", n, 5 + n * width)


def run_length(data):
    return int(np.frombuffer(data, "<u4", 1)[0])


def in_order(values, check):
    """Order that sorts the values (and checks, where equal values differ in these), the earlier first; and which then repeat the one before."""
    order = np.argsort(values, kind="stable")  # of two ascending runs one after the other: a single merge
    ordered, checks = values[order], check[order]
    equal = ordered[1:] == ordered[:-1]
    if (equal & (checks[1:] != checks[:-1])).any():
        order = np.lexsort((check, values))
        ordered, checks = values[order], check[order]
        equal = ordered[1:] == ordered[:-1]
    return order, np.concatenate((np.zeros(min(1, len(order)), bool), equal & (checks[1:] == checks[:-1])))


class Runs:
    """Immutable sorted runs in levels, oldest first.

    A run is merge-joined with the one before it once they are of like size: what both
    hold, the check hash being equal too, is marked as seen in the younger, and the two
    become one run. So every entry takes part in about log n merges.
    """

    def __init__(self, total):
        self.levels, self.seen, self.n = [], np.zeros(total, bool), 0

    def add(self, values, check):
        if len(values):
            self.levels.append((values, check, np.arange(self.n, self.n + len(values))))
            self.n += len(values)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self.join_last()

    def join_last(self):
        values, check, place = (np.concatenate(x) for x in zip(*self.levels[-2:], strict=True))
        order, again = in_order(values, check)
        self.seen[place[order[again]]] = True
        order = order[~again]
        self.levels[-2:] = [(values[order], check[order], place[order])]

    def compact(self):
        """The one run that is left; from then on `seen` holds for every entry."""
        while len(self.levels) > 1:
            self.join_last()
        return self.levels[0][:2] if self.levels else (np.empty(0, np.uint64), np.empty(0, np.uint16))


def bucket_slices(fingerprints, count):
    """Bucket number and slice of the sorted fingerprints, for each bucket that has some."""
    bucket = ((fingerprints >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[i]), slice(i, j)) for i, j in zip(edges, [*edges[1:], len(bucket)], strict=True)] if len(edges) else []


class Chunk:
    """The words and window fingerprints of one chunk, in the order of ids."""

    def __init__(self, table, size):
        ids = table.column("_id").combine_chunks()
        nulls, values = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
        order = np.lexsort((values, ~nulls))  # null ids count as the smallest
        self.order = order
        nulls, values = nulls[order], values[order]
        fresh = np.concatenate(([0], (values[1:] != values[:-1]) | (nulls[1:] != nulls[:-1]))).astype(np.int64)
        rank = np.cumsum(fresh)
        self.words, self.offsets = W.split(table.column("_text").combine_chunks().take(pa.array(order)))
        h = W.hashes(self.words)
        wide = W.windows(h, size, SEED)
        ok = W.starts_within(self.offsets, size, len(wide))
        self.at = np.flatnonzero(ok)
        wide = W.mix(wide[self.at])
        # Of other hashes of the words, so that words which one hash confuses are told apart by the other.
        check = W.windows(W.hashes(self.words, seed=CHECK_SEED), size, CHECK_SEED)[self.at]
        check = (W.mix(check) >> np.uint64(48)).astype(np.uint16)
        doc = np.repeat(rank, np.diff(self.offsets))[self.at]
        by, again = in_order(wide, check)
        first = ~again
        self.fingerprints, self.check = wide[by][first], check[by][first]
        self.which = np.empty(len(by), np.int64)
        self.which[by] = np.cumsum(first) - 1
        self.later = doc > doc[by][first][self.which] if len(by) else np.empty(0, bool)


def _emit(size, n_buckets):
    def run(table: pa.Table) -> pa.Table:
        chunk, number = Chunk(table, size), table.column("chunk")[0].as_py()
        parts = [(b, encode_run(chunk.fingerprints[s], chunk.check[s])) for b, s in bucket_slices(chunk.fingerprints, n_buckets)]
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in parts], pa.int32()),
                "chunk": pa.array([number] * len(parts), pa.int32()),
                "data": pa.array([x for _, x in parts], pa.binary()),
            }
        )

    return run


def _merge(keep_runs):
    def run(table: pa.Table) -> pa.Table:
        numbers, data = table.column("chunk").to_pylist(), [x.as_py() for x in table.column("data")]
        runs, spans, fresh = Runs(sum(map(run_length, data))), [], []
        for i in sorted(range(len(numbers)), key=lambda i: numbers[i]):  # history, numbered -1, comes first
            values, check = decode_run(data[i])
            span = slice(runs.n, runs.n + len(values))
            if numbers[i] >= 0:
                spans.append((numbers[i], span))
                fresh.append((values, check, span))
            runs.add(values, check)
        runs.compact()
        out = [(c, np.packbits(runs.seen[span]).tobytes()) for c, span in spans]
        if keep_runs:  # what this call adds to history
            values = np.concatenate([np.empty(0, np.uint64), *(v[~runs.seen[span]] for v, _, span in fresh)])
            check = np.concatenate([np.empty(0, np.uint16), *(c[~runs.seen[span]] for _, c, span in fresh)])
            order, _ = in_order(values, check)
            if len(order):
                out.append((-1, encode_run(values[order], check[order])))
        return _runs_table(table.column("bucket")[0].as_py(), out)

    return run


def _runs_table(bucket, runs):
    return pa.table(
        {
            "bucket": pa.array([bucket] * len(runs), pa.int32()),
            "chunk": pa.array([c for c, _ in runs], pa.int32()),
            "data": pa.array([x for _, x in runs], pa.binary()),
        }
    )


def _compact(table: pa.Table) -> pa.Table:
    """All runs of a bucket as one."""
    data = [x.as_py() for x in table.column("data")]
    runs = Runs(sum(map(run_length, data)))
    for x in data:
        runs.add(*decode_run(x))
    return _runs_table(table.column("bucket")[0].as_py(), [(-1, encode_run(*runs.compact()))])


def _redeal(n_buckets):
    """Runs of another number of buckets, cut anew."""

    def run(batches):
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                values, check = decode_run(data.as_py())
                for b, s in bucket_slices(values, n_buckets):
                    yield from _runs_table(b, [(chunk, encode_run(values[s], check[s]))]).to_batches()

    return run


def _remove(size, n_buckets):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _result(pa.array([], pa.int64()), np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.string()))
        chunk = Chunk(docs, size)
        seen = np.zeros(len(chunk.fingerprints), bool)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
        for b, s in bucket_slices(chunk.fingerprints, n_buckets):
            seen[s] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=s.stop - s.start).astype(bool)
        gone = chunk.at[seen[chunk.which] | chunk.later]
        edge = np.zeros(len(chunk.words) + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(covered)))[chunk.offsets]
        ids = docs.column("_id").combine_chunks().take(pa.array(chunk.order))
        return _result(ids, np.diff(chunk.offsets), np.diff(total), W.join_words(chunk.words, chunk.offsets, ~covered))

    return run


def _result(ids, n_words, n_removed, kept):
    return pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": kept.cast(pa.string())})


RUN_SCHEMA = "bucket int, chunk int, data binary"


def chunk_number(base, chunk_bytes):
    """Expression that numbers chunks by ascending id, and how many there are at most.

    Ids are cut into cells of like counts, at most MAX_CELLS, and each cell into parts of
    like width; so the number is found in bounded time however many chunks there are.
    """
    size = base.agg(F.sum(F.octet_length("_text")).alias("bytes"), F.min("_id").alias("low"), F.max("_id").alias("high")).first()
    n_chunks = max(1, -(-(size["bytes"] or 0) // chunk_bytes))
    if n_chunks == 1 or size["low"] is None:
        return F.lit(0), 1
    n_cells = min(n_chunks, MAX_CELLS)
    shares = [i / n_cells for i in range(1, n_cells)]
    bounds = sorted(set(base.agg(F.percentile_approx("_id", shares, max(10000, 20 * n_cells))).first()[0]))
    parts = -(-n_chunks // (len(bounds) + 1))
    # Cell i holds the ids above bounds[i - 1] up to and with bounds[i].
    cell = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("_id"))), F.lit(0))
    if parts == 1:
        return cell, len(bounds) + 1
    lows, highs = ([size["low"] - 1, *bounds], [*bounds, size["high"]])
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), cell)
    part = F.floor((F.col("_id") - at(lows) - 1) * F.lit(float(parts)) / F.greatest(F.lit(1), at(highs) - at(lows)))
    return cell * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.coalesce(part, F.lit(0)))), parts * (len(bounds) + 1)


def remove_seen_windows(docs, id_col="doc_id", text_col="text", size=13, index=None, chunk_bytes=CHUNK_BYTES):
    """Remove each word covered by a `size`-word window that also starts in a document of smaller id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), one
    row per input row. Null texts have no words; texts shorter than a window lose none;
    rows that share an id are not earlier than each other; null ids count as the
    smallest. With `index`, a folder, all windows of earlier calls count as seen and
    those that this call brings are added as a generation of their own; generations of
    like size are compacted into one. One call at a time may write to an index.
    Equality of windows is that of 64 bits of hash, verified by 16 bits that come from
    other hashes of the words.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chunk, n_chunks = chunk_number(base, chunk_bytes)
    n_buckets, history = n_chunks, None
    if index is not None:
        live = _generations(spark, index)
        held = sum(g["bytes"] for g in live)
        n_buckets = max([n_buckets, -(-held // chunk_bytes), *(g["buckets"] for g in live)])
        history = _history(spark, live, n_buckets)
    # One exchange of the texts serves both passes.
    dealt = base.withColumn("chunk", chunk.cast("int")).repartition("chunk")
    runs = dealt.groupBy("chunk").applyInArrow(_emit(size, n_buckets), RUN_SCHEMA)
    if history is not None:
        runs = runs.unionByName(history)
    merged = runs.groupBy("bucket").applyInArrow(_merge(index is not None), RUN_SCHEMA)
    if index is not None:
        path = scratch_path(spark, "window-runs")
        merged.write.parquet(path)
        merged = spark.read.schema(RUN_SCHEMA).parquet(path)
        _add_history(spark, index, merged.where("chunk = -1"), n_buckets)
    answers = merged.where("chunk >= 0")
    return (
        dealt.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(_remove(size, n_buckets), "doc_id long, n_words long, n_removed long, kept_text string")
    )


def _files(spark, path):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _generations(spark, index):
    """Complete generations, oldest first, each with the calls it holds; those that a compacted one holds too are left out."""
    fs, path = _files(spark, index)
    found = []
    for status in fs.listStatus(path) if fs.exists(path) else []:
        at = status.getPath()
        if fs.exists(at.suffix("/_SUCCESS")):
            first, last, buckets = map(int, at.getName().split("-")[1:])
            found.append({"first": first, "last": last, "buckets": buckets, "path": str(at), "bytes": fs.getContentSummary(at).getLength()})
    held = [g for g in found if not any(h is not g and h["first"] <= g["first"] and g["last"] <= h["last"] for h in found)]
    return sorted(held, key=lambda g: g["first"])


def _history(spark, generations, n_buckets):
    """Runs of some generations, dealt to as many buckets; None without any."""
    runs = None
    for g in generations:
        its = spark.read.schema(RUN_SCHEMA).parquet(g["path"])
        if g["buckets"] != n_buckets:
            its = its.mapInArrow(_redeal(n_buckets), RUN_SCHEMA)
        runs = its if runs is None else runs.unionByName(its)
    return runs


def _add_history(spark, index, runs, n_buckets):
    """Add a generation, then compact the last two as long as they are of like size."""
    live = _generations(spark, index)
    number = live[-1]["last"] + 1 if live else 0
    runs.write.mode("overwrite").parquet(f"{index}/generation-{number:06d}-{number:06d}-{n_buckets}")
    live = _generations(spark, index)
    while len(live) > 1 and live[-2]["bytes"] < 2 * live[-1]["bytes"]:
        a, b = live[-2:]
        count = max(a["buckets"], b["buckets"])
        both = _history(spark, [a, b], count).groupBy("bucket").applyInArrow(_compact, RUN_SCHEMA)
        both.write.mode("overwrite").parquet(f"{index}/generation-{a['first']:06d}-{b['last']:06d}-{count}")
        for g in (a, b):
            fs, path = _files(spark, g["path"])
            fs.delete(path, True)
        live = _generations(spark, index)
