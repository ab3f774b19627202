"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A text's k-mers are its runs of five words, labelled by occurrence so that repeats
differ. Each of several sketches takes the few k-mers of least hash under its own seed
and keeps them in text order, so two sketches agree only if the k-mers and their order
do. Texts are grouped first into classes of equal words; classes that share a sketch are
candidates, and aligned: the k-mers they have in common and in one order, within a band
around the diagonal, must be 0.8 of all.

A bucket of n classes has n * n pairs, but only its groups are asked for. So each member is
aligned with one of the bucket, and linked members are one group from then on. Members of
buckets that still hold several groups find each other by their rarest k-mers: texts alike
at 0.8 share one among the rarest fifth of each (prefix filtering), so only pairs of
different groups that meet there, and whose counts allow the similarity, are aligned. Each
link between different texts that share a sketch is found so, or lies within a group.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import words as W
from .common import among, beside, rows_of, ship, sized, stored
from .components import tied
from .worker import lean

K, KMER_SEED = 5, 71
SKETCHES, TAKEN = 20, 3
SIMILARITY = 0.8
SEEDS = W.constants(SKETCHES, 73)
ORDER = W.constants(TAKEN, 79)


def labelled(kmers):
    """K-mers marked with their number of occurrence, so that each is met once."""
    if not len(kmers):
        return kmers
    by = np.argsort(kmers, kind="stable")
    ordered = kmers[by]
    start = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    out = np.empty_like(kmers)
    out[by] = ordered + (np.arange(len(by)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return W.mix(out)


def sketches(kmers):
    """One hash per seed of the least k-mers in text order; none for a text without k-mers."""
    n = len(kmers)
    if n == 0:
        return np.empty(0, np.uint64)
    taken = min(TAKEN, n)
    ranks = kmers[None, :] * SEEDS[:, None]
    ranks ^= ranks >> np.uint64(31)
    ranks *= np.uint64(0xD6E8FEB86659FD93)
    places = np.argpartition(ranks, taken - 1, axis=1)[:, :taken] if n > taken else np.broadcast_to(np.arange(n), (SKETCHES, n))
    chosen = kmers[np.sort(places, axis=1)]
    return W.mix((chosen * ORDER[:taken]).sum(1, dtype=np.uint64) + SEEDS)


def similarity(a, b, band=0.25):
    """Share of labelled k-mers that two sequences have in common and in one order.

    Common k-mers further off the middle diagonal than the band (a share of the longer
    text) are left out, and of the rest the longest chain counts: k-mers that a moved
    block brings out of order do not. Where too few are common the share of these, in
    any order, is returned, an upper bound below SIMILARITY.
    """
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    common = len(i)
    if common < SIMILARITY * (total - common):
        return common / (total - common)
    by = np.argsort(i)
    i, j = i[by], j[by]
    off = j - i
    j = j[np.abs(off - np.median(off)) <= max(K, band * max(len(a), len(b)))]
    if (j[1:] > j[:-1]).all():
        chain = len(j)
    else:
        tails = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        chain = len(tails)
    return chain / (total - chain)


def kmers_of(texts):
    """Labelled k-mers of every text, and two hashes of its whole word sequence."""
    words, offsets = W.split(texts, lower=True)
    h = W.hashes(words)
    g = W.windows(h, K, KMER_SEED)
    for start, stop in zip(offsets, offsets[1:], strict=False):
        w = h[start:stop]
        weights = np.arange(1, len(w) + 1, dtype=np.uint64)
        whole = [int(np.sum(W.mix(w + weights * np.uint64(c)), dtype=np.uint64)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        yield labelled(g[start : max(start, stop - K + 1)]), whole


def _sketch(batches):
    for batch in batches:
        for part in W.slices(batch, "_text"):
            one, two, size, out = [], [], [], []
            for kmers, whole in kmers_of(part.column("_text")):
                one.append(whole[0])
                two.append(whole[1])
                size.append(len(kmers))
                out.append(sketches(kmers).view(np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "node": part.column("node"),
                    "h1": pa.array(np.array(one, np.uint64).view(np.int64)),
                    "h2": pa.array(np.array(two, np.uint64).view(np.int64)),
                    "size": pa.array(size, pa.int64()),
                    "sketches": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64())),
                }
            )


def _verify(batches):
    for batch in batches:
        for part in W.slices(batch, "text_a", 1 << 20):
            pairs = zip(kmers_of(part.column("text_a")), kmers_of(part.column("text_b")), strict=True)
            found = [similarity(a, b) for (a, _), (b, _) in pairs]
            yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "similarity": pa.array(found, pa.float64())})


def _kmers(batches):
    for batch in batches:
        for part in W.slices(batch, "text"):
            out = [kmers.view(np.int64) for kmers, _ in kmers_of(part.column("text"))]
            ends = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
            yield pa.RecordBatch.from_pydict({"node": part.column("node"), "kmers": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out), pa.int64()))})


NODE_TYPE = "struct<id:bigint,key:bigint>"


def node_of(id_col="doc_id", text_col="text"):
    """What tells a row's text from others of the same id."""
    return F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))


def near_groups(docs, id_col="doc_id", text_col="text"):
    """doc_id, class_id (least id of its group), kept: one row per input row.

    Texts whose words are equal but for case and white space are one class; classes are
    linked at a similarity of 0.8 or more, and a group is what hangs together by links.
    Texts of under five words are grouped only with texts of the same words; null and
    empty texts are one class. Rows that repeat an id and a text get the same answer;
    rows without an id are left out, as a group is named by an id. Very long texts are
    read whole, extra columns and clashing names do not matter, an empty table gives an
    empty result. Of equal ids the text's hash decides which stays.
    """
    return _answers(docs, id_col, text_col).drop("node")


def alike(pairs, texts):
    """The pairs of nodes whose texts align."""
    pairs = sized(stored(pairs, "pairs"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).join(beside(pairs), "a")
    asked = among(texts, pairs.select(F.col("b").alias("node")), rows_of(pairs))  # few texts are moved
    both = left.join(asked.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    found = both.mapInArrow(lean(_verify), f"a {NODE_TYPE}, b {NODE_TYPE}, similarity double")
    return sized(stored(found.where(F.col("similarity") >= SIMILARITY).select("a", "b"), "near-links"))


def grouped(members, groups):
    """Members with the group that they are in by the links so far."""
    out = members.join(beside(groups.withColumnRenamed("root", "group"), groups), "node")
    out._millrace_rows = rows_of(members)
    return out


def divided(members, *key):
    """Members of the buckets that hold several groups, each bucket's largest being named."""
    several = members.groupBy(*key, "group").agg(F.count(F.lit(1)).alias("times")).groupBy(*key)
    several = several.agg(F.max_by("group", F.struct("times", "group")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return sized(stored(members.join(several.drop("groups"), [*key]), "divided"))


def may_link():
    """Whether a pair's k-mers allow the similarity, at the first place that brings it together.

    What a text shares with nobody is in the union of both and not in the intersection.
    And what stands before the first rare k-mer that both have is not in common.
    """
    alone = F.col("size") - F.col("shared") + F.col("size_b") - F.col("shared_b")
    counts = F.least("shared", "shared_b") >= (F.greatest("shared", "shared_b") + alone) * (SIMILARITY - 1e-9)
    left = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    return (F.col("group") != F.col("group_b")) & counts & (left >= (F.col("size") + F.col("size_b")) * (SIMILARITY / (1 + SIMILARITY) - 1e-9))


def pairs(members, others, *key):
    other = others.select(*key, *(F.col(c).alias(f"{c}_b") for c in ("node", "size", "shared", "group", "at")))
    met = members.join(other, [*key]).where(may_link())  # both sides grow with the buckets: dealt out by key at any size
    return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def across(members, *key):
    """Pairs of one bucket and different groups; members of its largest group are no first of a pair."""
    return pairs(members.where(F.col("group") != F.col("top")), members, *key)


def stars(members, *key, turn=0):
    """Each member of the buckets that hold several groups with one of its bucket: its first, or in later turns one drawn by hash, so that every bucket asks another."""
    drawn = F.xxhash64(F.lit(turn), *key, "node") if turn else F.lit(0).cast("long")
    least = F.min(F.struct(drawn.alias("drawn"), "node", "size", "shared", "group", "at")).alias("x")
    first = members.groupBy(*key).agg(least, F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high")
    return pairs(members, first.select(*key, "x.*"), *key)


def by_rare_kmers(members, texts):
    """A bucket for every k-mer among the rarest fifth of a member's that another member has too, and how many it shares in all."""
    held = stored(among(texts, members.select("node"), rows_of(members)).mapInArrow(lean(_kmers), f"node {NODE_TYPE}, kmers array<long>"), "kmers")
    each = held.select("node", F.explode("kmers").alias("kmer"))
    times = each.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = each.join(times, "kmer").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "kmer"))).alias("met"))
    counted = ranked.join(members, "node").withColumn("shared", F.size("met").cast("long"))
    # k-mers of one member alone are its rarest: they fill the first places and meet nobody.
    alone = F.col("size") - F.col("shared")
    places = F.greatest(F.lit(0), F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1 - alone).cast("int")
    some = counted.where(F.col("shared") >= F.col("size") * (SIMILARITY - 1e-9))  # who shares too little links with nobody
    rare = some.select("node", "size", "shared", alone.alias("alone"), F.posexplode(F.slice("met", F.lit(1), places)).alias("place", "x"))
    return sized(stored(rare.select("node", "size", "shared", (F.col("alone") + F.col("place")).alias("at"), F.col("x.kmer").alias("kmer")), "rare-kmers"))


def _answers(docs, id_col, text_col):
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(node_of(id_col, text_col).alias("node"), F.col(text_col).cast("string").alias("_text")).where("node.id IS NOT NULL")
    every = stored(base.mapInArrow(lean(_sketch), f"node {NODE_TYPE}, h1 long, h2 long, size long, sketches array<long>"), "sketches")
    classes = stored(every.groupBy("h1", "h2").agg(F.min(F.struct("node", "sketches", "size")).alias("m")).select("h1", "h2", "m.*"), "word-classes")
    spread = classes.select("node", "size", F.posexplode("sketches").alias("band", "sketch"))
    buckets = spread.groupBy("band", "sketch").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = sized(stored(spread.join(buckets, ["band", "sketch"]).withColumns({"group": F.col("node"), "shared": F.col("size"), "at": F.lit(0).cast("long")}), "met"))
    # From here on only the texts of classes that met others are moved.
    met_nodes = sized(stored(met.select("node").distinct(), "met-nodes"))
    texts = stored(among(base, met_nodes, rows_of(met_nodes)).groupBy("node").agg(F.first("_text").alias("text")), "met-texts")

    alone = met_nodes.select("node", F.col("node").alias("root"))
    alone._millrace_rows = rows_of(met_nodes)
    groups = tied(alone, alike(stars(met, "band", "sketch"), texts))
    without_group = met.drop("group")
    without_group._millrace_rows = rows_of(met)
    now = grouped(without_group, groups)
    several = now.groupBy("band", "sketch").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("band", "sketch")
    rest = now.join(several, ["band", "sketch"], "left_semi").select("node", "size").distinct()
    rare = by_rare_kmers(sized(stored(rest, "rest")), texts)
    for turn in (1, 2):  # each draws as many pairs as there are places, and leaves fewer groups
        groups = tied(groups, alike(stars(grouped(rare, groups), "kmer", turn=turn), texts))
    roots = tied(groups, alike(across(divided(grouped(rare, groups), "kmer"), "kmer"), texts))
    known = stored(
        classes.select("h1", "h2", "node").join(roots, "node", "left")
        .select("h1", "h2", F.coalesce("root", "node").alias("root"), (F.coalesce("root", "node") == F.col("node")).alias("leads")),
        "near-classes",
    )
    return every.select("node", "h1", "h2").join(known, ["h1", "h2"]).select(
        F.col("node.id").alias("doc_id"), F.col("root.id").alias("class_id"), (F.col("leads") & (F.col("node") == F.col("root"))).alias("kept"), "node"
    )


def drop_near_copies(docs, id_col="doc_id", text_col="text"):
    """One document of each group, that of least id; rows without an id stay as they are, and those that share one are judged by text.

    Repeated rows of the one that stays all stay. Null and empty texts are one group; an empty table gives an empty one.
    """
    gone = _answers(docs, id_col, text_col).where(~F.col("kept")).select(F.col("node").alias("_gone")).distinct()
    return docs.withColumn("_node", node_of(id_col, text_col)).join(gone, F.col("_node") == F.col("_gone"), "left_anti").drop("_node")
