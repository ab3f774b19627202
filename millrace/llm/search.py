"""Ranked lexical search by windowed bucket scoring.

The index holds postings of the terms that a slice of queries asks for. Each task numbers
the documents it reads; a window is a fixed range of WINDOW numbers, and its postings are
one row, ordered by term. Scoring takes window by window and, for a query, term by term:
scores are scatter-added into an array of one place per document of the window, which
stays in the cache, and a bit is set for every document met. The bits name the places to
harvest into the query's heap and to clear again. No document's text or postings are
shuffled: only document frequencies and each task's best rows are.
"""

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import ship, stored

#: Documents in a window: 32 KB of scores.
WINDOW = 4096
#: Postings from which a window is closed early, and bytes of query text in a slice.
MAX_POSTINGS, SLICE_BYTES = 4 << 20, 4 << 20
#: Parts that a query's best rows are first ranked in, so that no task gathers those of all tasks.
PARTS = 32

#: Bytes of a term: digits, letters and all that is not ASCII; only A-Z are lower-cased.
INSIDE = np.zeros(256, bool)
INSIDE[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
INDEX = "docs array<long>, n array<long>, terms array<int>, df array<int>, slots binary, tf binary"


def terms(texts):
    """Terms of every text: (flat binary array, number of terms per text). Null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = INSIDE[data]
    first = np.zeros(len(data) + 1, bool)
    first[ends] = True  # no term goes on from one text into the next
    first = first[:-1]
    first[1:] |= ~inside[:-1]
    if len(data):
        first[0] = True
    starts = np.flatnonzero(first & inside)
    offsets = np.append(np.cumsum(inside) - 1, inside.sum())[np.append(starts, len(data))].astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWERED[data[inside]])])
    return flat, np.diff(np.searchsorted(starts, ends))


class _Open:
    """The window that is being filled."""

    def __init__(self):
        self.docs, self.n, self.slot, self.term, self.tf, self.filled, self.postings = [], [], [], [], [], 0, 0

    def add(self, part, vocabulary):
        found, n = terms(part.column("_text"))
        at = pc.fill_null(pc.index_in(found, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)[at >= 0]
        keys, tf = np.unique(doc * len(vocabulary) + at[at >= 0], return_counts=True)
        self.docs += part.column("_id").to_pylist()
        self.n.append(n)
        self.slot.append(keys // max(1, len(vocabulary)) + self.filled)
        self.term.append(keys % max(1, len(vocabulary)))
        self.tf.append(tf)
        self.filled += len(n)
        self.postings += len(keys)

    def close(self):
        slot, term, tf = (np.concatenate(x) for x in (self.slot, self.term, self.tf))
        by = np.lexsort((slot, term))
        own, df = np.unique(term, return_counts=True)
        row = {"docs": [self.docs], "n": [np.concatenate(self.n)], "terms": [own], "df": [df], "slots": [slot[by].astype(np.uint16).tobytes()], "tf": [tf[by].astype(np.uint32).tobytes()]}
        kinds = {"docs": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "terms": pa.list_(pa.int32()), "df": pa.list_(pa.int32()), "slots": pa.binary(), "tf": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in row.items()})


def _index(vocabulary, width):
    def run(batches):
        window = _Open()
        for batch in batches:
            for part in W.slices(batch, "_text"):
                while part.num_rows:
                    taken = part.slice(0, width - window.filled)
                    window.add(taken, vocabulary)
                    part = part.slice(taken.num_rows)
                    if window.filled == width or window.postings >= MAX_POSTINGS:
                        yield window.close()
                        window = _Open()
        if window.filled:
            yield window.close()

    return run


def _harvest(heap, top, scores, docs):
    """Push what may be among the best; equal scores by ascending id, documents without an id last."""
    good = scores > 0 if len(heap) < top else scores >= max(1, heap[0][0])
    scores, docs = scores[good], docs[good]
    for i in np.lexsort((docs, -scores))[:top].tolist():
        entry = (int(scores[i]), -int(docs[i]))
        if len(heap) < top:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        else:
            break


#: Stands for a missing id: after all others.
NO_ID = 2**63 - 1


def _score(queries, weights, n_docs, n_terms, top, width):
    """queries: (item_id, terms, their numbers of occurrence); yields each task's best rows."""

    def run(batches):
        heaps = [[] for _ in queries]
        bucket = np.zeros(width, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                docs = np.array([NO_ID if d is None else d for d in batch.column("docs")[row].as_py()], np.int64)
                length = [100 - 25 + 25 * n * n_docs // n_terms if n_terms else 0 for n in batch.column("n")[row].as_py()]
                own, df = (np.asarray(batch.column(c)[row].values, np.int64) for c in ("terms", "df"))
                slots = np.frombuffer(batch.column("slots")[row].as_py(), np.uint16)
                tf = np.frombuffer(batch.column("tf")[row].as_py(), np.uint32).astype(np.int64)
                gain = 1_000_000_000 * tf // (1000 * tf + 12 * np.array(length, np.int64)[slots]) * np.repeat(weights[own], df)
                ends = np.cumsum(df)
                postings = {t: (slots[e - d : e], gain[e - d : e]) for t, d, e in zip(own.tolist(), df.tolist(), ends.tolist(), strict=True)}
                bits = {}
                for heap, (_, asked) in zip(heaps, queries, strict=True):
                    met = np.zeros(width // 8, np.uint8)
                    for term, times in asked:
                        if term not in postings:
                            continue
                        at, add = postings[term]
                        bucket[at] += add * times  # a term meets a document once, so no place is named twice
                        if term not in bits:
                            flags = np.zeros(width, bool)
                            flags[at] = True
                            bits[term] = np.packbits(flags)
                        met |= bits[term]
                    at = np.flatnonzero(np.unpackbits(met))
                    if len(at):
                        _harvest(heap, top, bucket[at], docs[at])
                        bucket[at] = 0
        best = [(k, item, score, None if -doc == NO_ID else -doc) for k, (heap, (item, _)) in enumerate(zip(heaps, queries, strict=True)) for score, doc in heap]
        columns = list(zip(*best, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for name, kind, values in zip(("k", "item_id", "score", "doc_id"), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), columns, strict=True)})

    return run


def ranked(best, top):
    """The best of each query's rows over all tasks, first within parts, then over these."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("k", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where(F.col("rank") <= top)


def search(docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", top=20, window=WINDOW, slice_bytes=SLICE_BYTES):
    """item_id, rank (from 1), doc_id, score: the `top` best documents with a score above 0 for each item.

    A term is a run of digits, letters and characters beyond ASCII, A-Z lower-cased. Its
    weight falls with the documents that hold it, its gain with the length of a document;
    all but the weight is in integers. Equal scores go by ascending id, documents without
    an id last. Each row is a document and an item of its own, those that repeat an id
    included. Null and empty texts hold no term: such documents are counted nowhere, such
    items find nothing. Texts of any length are read whole, extra columns and clashing
    names do not matter, an empty table of either kind gives an empty result. Items are
    sent to the workers in slices of `slice_bytes` of text, with the same result however
    many; `window` is a multiple of eight, and changes nothing either.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    asked = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL")
    n_slices = max(1, -(-(asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // slice_bytes))
    parts = []
    for k in range(n_slices):
        rows = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_slices)) == k).orderBy("i", "t").collect()
        found, n = terms(pa.array([r["t"] for r in rows], pa.string()))
        coded = found.dictionary_encode()
        vocabulary, codes = coded.dictionary, np.asarray(coded.indices)
        queries = []
        for row, start, stop in zip(rows, np.cumsum(n) - n, np.cumsum(n), strict=True):
            own, times = np.unique(codes[start:stop], return_counts=True)
            queries.append((row["i"], list(zip(own.tolist(), times.tolist(), strict=True))))
        index = stored(base.mapInArrow(_index(vocabulary, window), INDEX), "search-index")
        total = index.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        holding = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for row in holding:  # as many as the slice's terms
            weights[row["terms"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * row["df"] + 1)))
        best = index.mapInArrow(_score(queries, weights, total["docs"], total["terms"], top, window), "k int, item_id long, score long, doc_id long")
        parts.append(ranked(best, top).select("item_id", "rank", "doc_id", "score"))
    return functools.reduce(DataFrame.unionByName, parts)
