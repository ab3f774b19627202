"""Suffix-array dedup: remove bytes covered by long strings that start more than once.

A string of `size` bytes is found through its anchor, its k-mer of least hash: equal
strings share it, at the same place. All strings of one anchor lie in one segment of
text. Segments that are equal whole need no more work. The rest are dealt to blocks by
anchor, cut into phrases at content-defined places, and a suffix array of the phrase
numbers is built by grouping in linear time. Neighbouring suffixes with a long common
run of phrases form classes; strings that start a class are then compared on all their
bytes' hashes, which settles them to the byte.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import words as W
from .common import row_key, ship, stored

KMER, PHRASE_WINDOW, PHRASE_KMER = 32, 64, 8
#: Distinct segments of one anchor that one block takes; beyond, strings are counted by hash over the cluster.
BLOCK_SEGMENTS = 20_000
TOP = np.uint64(2**64 - 1)


def kmer_hashes(data, k):
    """A hash of every k bytes, k a multiple of eight."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    c = W.constants(k // 8, 7)
    total = W.mix(eight[:n] * c[0])
    for j in range(1, k // 8):
        total = (total ^ (total >> np.uint64(29))) + eight[8 * j : 8 * j + n] * c[j]
    return W.mix(total)


def sliding_min(h, width):
    """Least value of every `width` consecutive ones, from running minima of blocks."""
    n = len(h)
    padded = np.full(-(-n // width) * width, TOP)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data, size):
    """Anchor, start and end of every segment, the union of consecutive strings with one anchor, and how often the anchor is in it."""
    if len(data) < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), []
    h = kmer_hashes(data, KMER)
    least = sliding_min(h, size - KMER + 1)
    turn = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.concatenate(([0], turn)), np.concatenate((turn, [len(least)]))
    anchor, end = least[first], last - 1 + size
    times = [np.count_nonzero(h[b : e - KMER + 1] == a) for a, b, e in zip(anchor, first.tolist(), end.tolist(), strict=True)]
    return anchor, first, end, times


def string_hashes(data, size, seed):
    """A hash of every `size` bytes by prefix sums of mixed 8-grams, each place weighed by a power."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = W.constants(2, seed)
    grams = W.mix(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * c[1])
    inverse = np.uint64(pow(int(c[0]), -1, 2**64))
    powers = np.cumprod(np.full(len(grams), c[0]), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(grams * powers, dtype=np.uint64)))
    back = np.cumprod(np.full(n, inverse), dtype=np.uint64)
    span = size - 7
    return W.mix((sums[span : span + n] - sums[:n]) * back)


def suffix_array(text):
    """Order of the suffixes of a list of small numbers, by grouping on Lyndon prefixes.

    First phase: groups, at first by leading number, are taken in descending order. Each
    suffix of the group points to the nearest earlier suffix of a lower group; suffixes
    pointed to move to new groups just above their own, those with more pointers higher,
    so that groups end up as those of equal Lyndon prefixes in order. Second phase:
    suffixes in final order place, along the pointers, those whose Lyndon prefix ends
    where they start.
    """
    n = len(text)
    heads = sorted(set(text))
    number = {x: g for g, x in enumerate(heads)}
    group = [number[x] for x in text]
    members = [[] for _ in heads]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(heads) - 1))
    above = [*range(1, len(heads)), -1]
    previous = [-1] * n
    done = bytearray(n)
    at = len(heads) - 1
    top = at
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        for i in own:
            done[i] = 1
        counts = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        by_count = {}
        for j, c in counts.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):
            moved = {}
            for j in by_count[c]:
                g = group[j]
                new = moved.get(g)
                if new is None:
                    new = moved[g] = len(members)
                    members.append([])
                    size.append(0)
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    if up >= 0:
                        below[up] = new
                    else:
                        top = new
                group[j] = new
                members[new].append(j)
                size[g] -= 1
                size[new] += 1
        at = below[at]
    # Where each group begins in the final order.
    begin, total, g = {}, n, top
    while g >= 0:
        total -= size[g]
        begin[g] = total
        g = below[g]
    order, placed = [-1] * n, bytearray(n)
    order[0] = n - 1  # the last number is less than all others and occurs once
    placed[n - 1] = 1
    begin[group[n - 1]] += 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[begin[g]] = j
            begin[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


def common_runs(text, order, weight):
    """Weight of the numbers that each suffix shares with the one before it in order, up to a separator (0 or 1)."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    sums = [0, *np.cumsum(weight).tolist()]
    out, h = [0] * n, 0
    for i in range(n):
        k = rank[i]
        if k == 0:
            h = 0
            continue
        j = order[k - 1]
        while text[i + h] == text[j + h] and text[i + h] > 1:
            h += 1
        out[k] = sums[i + h] - sums[i]
        if h:
            h -= 1
    return out


def phrase_cuts(data):
    """Content-defined places, at least one in every PHRASE_WINDOW bytes."""
    h = kmer_hashes(data, PHRASE_KMER)
    width = PHRASE_WINDOW - PHRASE_KMER + 1
    if len(h) < width:
        return np.empty(0, np.int64)
    least = np.zeros(len(h) + width - 1, np.uint64)
    least[width - 1 : len(h)] = sliding_min(h, width)
    # A place is a cut if its k-mer is the least of some window around it, ties included.
    return np.flatnonzero(~sliding_min(~least, width) == h)


def repeated_strings(datas, size):
    """For each segment of a block, a mask of the strings in it that start elsewhere too."""
    text, weight, place, phrases = [], [], [], {}
    margin = PHRASE_WINDOW - PHRASE_KMER + 1
    cuts_of = []
    for s, data in enumerate(datas):
        cuts = phrase_cuts(np.frombuffer(data, np.uint8))
        cuts_of.append(cuts)
        edges = [*cuts.tolist(), len(data)]
        for a, b in zip(edges, edges[1:], strict=False):
            piece = data[a:b]
            number = phrases.get(piece)
            if number is None:
                number = phrases[piece] = len(phrases) + 2
            text.append(number)
            weight.append(b - a)
            place.append(s)
        text.append(1)
        weight.append(0)
        place.append(s)
    text.append(0)
    weight.append(0)
    order = suffix_array(text)
    shared = np.array(common_runs(text, order, weight))
    # Every string holds whole phrases between its margins: what lies there is common to equal strings.
    least = size - 2 * margin - 2 * PHRASE_WINDOW
    joined = shared >= least
    in_class = joined.copy()
    in_class[:-1] |= joined[1:]
    candidate = np.zeros(len(text), bool)
    candidate[np.array(order)[in_class]] = True
    hashes, checks, owner, at = [], [], [], []
    row = 0
    for s, data in enumerate(datas):
        cuts, n = cuts_of[s], len(data) - size + 1
        starts = np.arange(n)
        which = np.searchsorted(cuts, starts + margin)
        inside = which < len(cuts)
        ok = np.zeros(n, bool)
        ok[inside] = candidate[row + which[inside]]
        row += len(cuts) + 1
        p = np.flatnonzero(ok)
        if len(p):
            buffer = np.frombuffer(data, np.uint8)
            hashes.append(string_hashes(buffer, size, 3)[p])
            checks.append(string_hashes(buffer, size, 5)[p])
            owner.append(np.full(len(p), s))
            at.append(p)
    masks = [np.zeros(len(d) - size + 1, bool) for d in datas]
    if hashes:
        h, c, o, p = map(np.concatenate, (hashes, checks, owner, at))
        by = np.lexsort((c, h))
        h, c, o, p = h[by], c[by], o[by], p[by]
        same = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
        hit = same.copy()
        hit[:-1] |= same[1:]
        p, o = p[hit], o[hit]
        by = np.argsort(o, kind="stable")
        p, o = p[by], o[by]
        first = np.flatnonzero(np.diff(o, prepend=-1))
        for a, b in zip(first, [*first[1:], len(o)], strict=False):
            masks[o[a]][p[a:b]] = True
    return masks


def runs_of(mask, size, start):
    """Byte spans covered by the strings that a mask marks."""
    if not mask.any():
        return []
    at = np.flatnonzero(mask)
    split = np.flatnonzero(np.diff(at) > size) + 1
    first, last = np.concatenate(([0], split)), np.concatenate((split, [len(at)])) - 1
    return [(int(start + at[f]), int(start + at[l] + size)) for f, l in zip(first, last, strict=True)]


def _signed(values):
    return np.asarray(values, np.uint64).view(np.int64)


def _find(size):
    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("k1", "k2")]
            out = {c: [] for c in ("k1", "k2", "anchor", "content", "begin", "end", "times")}
            for r, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                anchor, begin, end, times = segments(np.frombuffer(data, np.uint8), size)
                digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
                content = [digest(view[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
                out["k1"].append(np.full(len(begin), keys[0][r]))
                out["k2"].append(np.full(len(begin), keys[1][r]))
                out["anchor"].append(_signed(anchor))
                out["content"].append(_signed(content))
                out["begin"].append(begin)
                out["end"].append(end)
                out["times"].append(np.asarray(times, np.int64))
            joined = {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v.astype(np.int64), pa.int64()) for c, v in joined.items()})

    return run


def _settle(size):
    def run(table: pa.Table) -> pa.Table:
        datas = table.column("data").to_pylist()
        many = table.column("n").to_pylist()
        k1, k2, begin = (table.column(c).to_pylist() for c in ("k1", "k2", "begin"))
        masks = repeated_strings(datas, size)
        rows = [(k1[i], k2[i], a, b) for i, mask in enumerate(masks) if many[i] == 1 for a, b in runs_of(mask, size, begin[i])]
        return pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(("k1", "k2", "begin", "end"))})

    return run


def _open_strings(size):
    def run(batches):
        for batch in batches:
            k1, k2, begin, n = (batch.column(c).to_pylist() for c in ("k1", "k2", "begin", "n"))
            for i, data in enumerate(batch.column("data").to_pylist()):
                buffer = np.frombuffer(data, np.uint8)
                h, c = string_hashes(buffer, size, 3), string_hashes(buffer, size, 5)
                yield pa.RecordBatch.from_pydict(
                    {
                        "k1": pa.array(np.full(len(h), k1[i])),
                        "k2": pa.array(np.full(len(h), k2[i])),
                        "begin": pa.array(np.arange(len(h)) + begin[i]),
                        "end": pa.array(np.arange(len(h)) + begin[i] + size),
                        "n": pa.array(np.full(len(h), n[i])),
                        "h": pa.array(_signed(h)),
                        "c": pa.array(_signed(c)),
                    }
                )

    return run


def _cut(batches):
    for batch in batches:
        n_removed, n_spans, kept = [], [], []
        begins, ends = batch.column("begins").to_pylist(), batch.column("ends").to_pylist()
        for data, b, e in zip(batch.column("data").to_pylist(), begins, ends, strict=True):
            if not b:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(data)
                continue
            parts, at, spans, removed, reach = [], 0, 0, 0, -1
            for x, y in sorted(zip(b, e, strict=True)):
                if x > reach:
                    parts.append(data[at:x])
                    spans += 1
                    removed += y - x
                elif y > reach:
                    removed += y - reach
                reach = at = max(reach, y)
            parts.append(data[at:])
            n_removed.append(removed)
            n_spans.append(spans)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([len(d.as_py()) for d in batch.column("data")], pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def remove_repeated_bytes(docs, id_col="doc_id", text_col="text", size=400):
    """Remove every byte covered by a `size`-byte string that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary) for each input row. Texts
    are UTF-8; null counts as empty; texts shorter than `size` lose nothing. Matches may
    overlap and lie in one document; rows that repeat a document repeat all its strings.
    """
    if size < 320:
        raise ValueError("strings of under 320 bytes may hold no whole phrase between their margins")
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = "k1 long, k2 long, anchor long, content long, begin long, end long, times long"
    found = stored(keyed.where(F.octet_length("text") >= size).select("k1", "k2", "text").mapInArrow(_find(size), columns), "segments")
    classes = stored(
        found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "begin", "end")).alias("first"), F.max("times").alias("times")),
        "segment-classes",
    )
    many = classes.where("n > 1").select("anchor", "content")
    whole = found.join(many, ["anchor", "content"]).select("k1", "k2", "begin", "end")
    # Anchors in several distinct segments, or several times in one, need the suffix array; oversize ones go another way.
    anchors = stored(
        classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.max("times").alias("times")).where("m > 1 OR times > 1").select("anchor", "m"),
        "segment-anchors",
    )
    open_classes = classes.join(anchors, "anchor").select("anchor", "n", "m", "first.*")
    oversize = not anchors.where(F.col("m") > BLOCK_SEGMENTS).isEmpty()
    texts = keyed.select("k1", "k2", F.encode("text", "UTF-8").alias("data"), "doc_id").repartition("k1", "k2")

    def cut_out(which):
        per_text = which.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "begin", "end", "n")).alias("parts"))
        one = texts.select("k1", "k2", "data").join(per_text, ["k1", "k2"])
        return one.select("k1", "k2", "data", F.explode("parts").alias("p")).select(
            "k1", "k2", "p.anchor", "p.begin", "p.n", F.substring("data", F.col("p.begin").cast("int") + 1, (F.col("p.end") - F.col("p.begin")).cast("int")).alias("data")
        )

    n_blocks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_out(open_classes.where(F.col("m") <= BLOCK_SEGMENTS)).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)))
    spans = whole.unionByName(dealt.groupBy("block").applyInArrow(_settle(size), "k1 long, k2 long, begin long, end long"))
    if oversize:
        strings = stored(
            cut_out(open_classes.where(F.col("m") > BLOCK_SEGMENTS)).select("k1", "k2", "begin", "n", "data")
            .mapInArrow(_open_strings(size), "k1 long, k2 long, begin long, end long, n long, h long, c long"),
            "open-strings",
        )
        twice = stored(strings.groupBy("h", "c").agg(F.sum("n").alias("total")).where("total > 1").select("h", "c"), "open-strings-twice")
        spans = spans.unionByName(strings.where("n = 1").join(twice, ["h", "c"]).select("k1", "k2", "begin", "end"))
    per_text = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("s"))
    joined = texts.join(per_text, ["k1", "k2"], "left").select("doc_id", "data", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
