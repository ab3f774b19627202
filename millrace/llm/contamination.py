"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An alignment of m matches and e edits falls into e + 1 runs of matches at most, so one of
score m - e holds that score less one matching pairs of neighbouring words. So many pairs
are asked for before a passage is aligned with the item word by word, and nothing that
reaches the score is missed. Pairs are counted over all documents: of those that occur,
an item's seeds leave out the commonest, but so few that every alignment holds SEEDS others.
"""

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import row_key, ship
from .worker import lean

SEED_WORDS, SEED_MIX = 2, 59
#: Test items held by a worker at a time; more are taken in turns.
SLICE_BYTES = 32 << 20
STRIP = ".,;:!?\"'()[]{}<>*#%&$|-"
#: Pairs of words an alignment must share with an item outside the pairs left out.
SEEDS = 3
#: Items of fewer words are not looked for.
MIN_WORDS = 3


def tokens(texts):
    words, offsets = W.split(texts, lower=True)
    return W.hashes(words, STRIP), offsets


def need(n_words):
    """Least alignment score that counts as a copy: 60 % of a short item, 13 words of a long one, never under 8 (or the whole item)."""
    return min(n_words, max(8.0, min(0.6 * n_words, 13.0)))


def smith_waterman(item, passage):
    """Best local alignment score of two arrays: match 1, mismatch -1, gap -1 a word."""
    if not len(passage):
        return 0.0
    place = np.arange(1, len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, np.int64), 0
    for word in item:
        step = np.where(passage == word, 1, -1)
        new = np.maximum(0, np.maximum(row[:-1] + step, row[1:] - 1))
        new = np.maximum(new, np.maximum.accumulate(new + place) - place)  # gaps along the passage
        row = np.concatenate(([0], new))
        best = max(best, int(new.max()))
    return float(best)


class Items:
    """Test items with their pairs of words, and what an alignment with each of them takes."""

    def __init__(self, ids, texts):
        self.ids = ids
        h, offsets = tokens(pa.array(texts, pa.string()))
        self.words = [h[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        self.pairs = [W.windows(w, SEED_WORDS, SEED_MIX) if len(w) >= MIN_WORDS else np.empty(0, np.uint64) for w in self.words]
        self.grams = np.unique(np.concatenate(self.pairs)) if self.pairs else np.empty(0, np.uint64)
        least = [int(np.ceil(need(len(w)) - 1e-9)) for w in self.words]
        #: Matching pairs in every alignment that is a copy, and the words of a document it extends over at most.
        self.least = np.array([x - 1 for x in least], np.int64)
        self.reach = np.array([2 * len(w) - x for w, x in zip(self.words, least, strict=True)], np.int64)
        #: Seeds in every such alignment.
        self.seeded = np.minimum(self.least, SEEDS)

    def seeds(self, counts):
        """Gram and item of every seed, sorted by gram; counts are those of self.grams."""
        gram, item = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i, pairs in enumerate(self.pairs):
            times = counts[np.searchsorted(self.grams, pairs)]
            some = np.flatnonzero(times)
            if len(some) < self.least[i]:
                continue  # the documents hold too few of its pairs for any copy
            rare = some[np.argsort(times[some], kind="stable")][: len(some) - (self.least[i] - self.seeded[i])]
            own = np.unique(pairs[rare])
            gram.append(own)
            item.append(np.full(len(own), i))
        gram, item = np.concatenate(gram), np.concatenate(item)
        order = np.argsort(gram, kind="stable")
        return gram[order], item[order]


def _grams(texts):
    h, offsets = tokens(texts)
    g = W.windows(h, SEED_WORDS, SEED_MIX)
    return h, offsets, g, W.starts_within(offsets, SEED_WORDS, len(g))


def _count(grams):
    def run(batches):
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            for part in W.slices(batch, "_text"):
                _, _, g, ok = _grams(part.column("_text"))
                if len(g) and len(grams):
                    at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                    total += np.bincount(at[(grams[at] == g) & ok], minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    return run


def spans(places, times, reach):
    """Where `times` of the ascending places lie within `reach` words: the first and last place of each, overlaps joined."""
    some = np.flatnonzero(places[times - 1 :] - places[: max(0, len(places) - times + 1)] <= reach)
    if not len(some):
        return []
    first, last = places[some], places[some + times - 1]
    cut = np.flatnonzero(first[1:] > last[:-1] + 2 * reach) + 1
    return list(zip(first[[0, *cut]], last[[*(cut - 1), -1]], strict=True))


def match(h, offsets, g, ok, items, seeds):
    """For each document of a slice: item numbers and scores of the copies found in it."""
    gram, item = seeds
    found = [[] for _ in offsets[:-1]]
    if not len(g) or not len(gram):
        return found
    low = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
    hit = np.flatnonzero((gram[low] == g) & ok)
    if not len(hit):
        return found
    count = np.searchsorted(gram, g[hit], side="right") - low[hit]
    place = np.repeat(hit, count)
    it = item[np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    doc = np.searchsorted(offsets, place, side="right") - 1
    order = np.lexsort((place, it, doc))
    place, it, doc = place[order], it[order], doc[order]
    # Enough seeds of one item within the reach of an alignment.
    last = np.arange(len(place)) + items.seeded[it] - 1
    to = np.minimum(last, len(place) - 1)
    near = np.flatnonzero((last < len(place)) & (doc[to] == doc) & (it[to] == it) & (place[to] - place <= items.reach[it]))
    if not len(near):
        return found
    group = np.flatnonzero(np.concatenate(([True], (doc[near[1:]] != doc[near[:-1]]) | (it[near[1:]] != it[near[:-1]]))))
    for a, b in zip(group, [*group[1:], len(near)], strict=True):
        rows = near[a:b]
        d, i = doc[rows[0]], it[rows[0]]
        words, reach, least = items.words[i], items.reach[i], items.least[i]
        n, best = len(words), 0.0
        begin, end = max(offsets[d], place[rows[0]] - reach), min(offsets[d + 1], place[to[rows[-1]]] + reach + SEED_WORDS)
        shared = begin + np.flatnonzero(np.isin(g[begin : end - SEED_WORDS + 1], items.pairs[i]))
        for first, final in spans(shared, least, reach):
            start, stop = max(offsets[d], first - reach), min(offsets[d + 1], final + reach + SEED_WORDS)
            best = max(best, smith_waterman(words, h[start:stop]))
            if best >= n:
                break
        if best >= need(n):
            found[d].append((int(i), best / n))
    return found


def _match(items, seeds):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "_text"):
                found = match(*_grams(part.column("_text")), items, seeds)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("_id"),
                        "k1": part.column("k1"),
                        "k2": part.column("k2"),
                        "items": pa.array([sorted({items.ids[i] for i, _ in f}) for f in found], pa.list_(pa.int64())),
                        "score": pa.array([max((s for _, s in f), default=0.0) for f in found], pa.float64()),
                    }
                )

    return run


def slices_of(docs, benchmark, text_col, item_id, item_text):
    """Test items in slices of bounded size, each with its seeds: n-grams are counted over all documents."""
    base = docs.select(F.col(text_col).cast("string").alias("_text"))
    tests = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL")
    n_slices = max(1, -(-(tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // SLICE_BYTES))
    for k in range(n_slices):
        rows = tests.where(F.pmod(F.xxhash64("i"), F.lit(n_slices)) == k).orderBy("i", "t").collect()
        items = Items([r["i"] for r in rows], [r["t"] for r in rows])
        counts = np.zeros(len(items.grams), np.int64)
        for row in base.mapInArrow(lean(_count(items.grams)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            counts[row["gram"]] = row["n"]
        yield items, items.seeds(counts)


def contaminated(docs, benchmark, id_col="doc_id", text_col="text", item_id="item_id", item_text="text"):
    """doc_id, items (sorted ids of the test items it copies), score (best alignment over item words), contaminated.

    One row per input row, those that repeat an id or lack one included. Null and empty
    texts copy nothing; items of under MIN_WORDS words are never found. The score is
    that of 0 to 1 where a copy is found, else 0. Items are sent to the workers in slices
    of bounded size, with the same result however many. Texts of any length are read whole;
    items that repeat an id are named once; extra columns and clashing names do not
    matter; an empty table, of either kind, finds nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    schema = "doc_id long, k1 long, k2 long, items array<long>, score double"
    parts = [base.mapInArrow(lean(_match(items, seeds)), schema) for items, seeds in slices_of(docs, benchmark, text_col, item_id, item_text)]
    out = parts[0]
    if len(parts) > 1:
        # Each slice's finds by row, joined to the rows: few documents copy anything, and rows that repeat an id stay apart.
        hits = functools.reduce(DataFrame.unionByName, parts).where(F.size("items") > 0).groupBy("k1", "k2")
        hits = hits.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("score").alias("score"))
        empty, zero = F.array().cast("array<bigint>"), F.lit(0.0)
        rows = base.select(F.col("_id").alias("doc_id"), "k1", "k2").join(hits, ["k1", "k2"], "left")
        out = rows.select("doc_id", F.coalesce("items", empty).alias("items"), F.coalesce("score", zero).alias("score"))
    return out.select("doc_id", "items", "score", (F.size("items") > 0).alias("contaminated"))


def _drop(column, items, seeds):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, column):
                found = match(*_grams(part.column(column)), items, seeds)
                yield part.filter(pa.array([not f for f in found], pa.bool_()))

    return run


def drop_contaminated(docs, benchmark, text_col="text", item_id="item_id", item_text="text"):
    """The documents that copy no test item, with all their columns and without a shuffle.

    Rows are judged by their own text alone, so repeated and null ids need no care; null
    and empty texts stay; empty tables give empty results.
    """
    ship(docs.sparkSession)
    out = docs
    for items, seeds in slices_of(docs, benchmark, text_col, item_id, item_text):
        out = out.mapInArrow(lean(_drop(text_col, items, seeds)), docs.schema)
    return out
