"""Words as arrays: split, hash and window whole Arrow columns of text at once."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64


def constants(count, seed):
    """Odd 64-bit multipliers drawn from one seed."""
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.integers(0, 2**63, count, dtype=np.uint64) * U64(2) + U64(1)


def mix(x):
    """Spread 64-bit values so that their order is unrelated to their source."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def split(texts, lower=False):
    """Words between ASCII white space of every text: (flat words, offsets). Null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    ends = np.concatenate(([0], np.cumsum(full)))
    starts = np.asarray(lists.offsets)
    return words.filter(pa.array(full)), ends[starts - starts[0]].astype(np.int64)


def hashes(words, strip=None, seed=0):
    """A 64-bit hash of every word, `strip` characters at its ends left out; equal words are hashed once."""
    coded = words.dictionary_encode()
    different = coded.dictionary.to_pylist()
    if strip:
        different = [w.strip(strip) for w in different]
    each = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in different), np.uint64, len(different))
    return each[np.asarray(coded.indices)] if len(words) else np.empty(0, np.uint64)


def windows(h, size, seed):
    """A hash of every `size` consecutive values, regardless of document ends."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = constants(size, seed)
    total = h[:n] * c[0]
    for j in range(1, size):
        total += h[j : j + n] * c[j]
    return total


def starts_within(offsets, size, n):
    """For each of `n` window starts, whether the window ends in the document it starts in."""
    ok = np.zeros(max(n, 0), bool)
    if n <= 0:
        return ok
    edge = np.zeros(n + 1, np.int32)
    first, last = offsets[:-1], offsets[1:] - size + 1
    some = last > first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    return np.cumsum(edge[:n]) > 0


def join_words(words, offsets, keep=None):
    """Every document's words joined by one space, those outside the mask `keep` left out."""
    if keep is not None:
        ends = np.concatenate(([0], np.cumsum(keep)))
        words, offsets = words.filter(pa.array(keep)), ends[offsets]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def slices(batch, column, max_bytes=2 << 20):
    """Cut a record batch so that each part holds few bytes of text, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // max_bytes
    edges = np.flatnonzero(np.diff(part)) + 1
    for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        if stop > start:
            yield batch.slice(start, stop - start)
