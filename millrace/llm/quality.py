"""Quality by a factorisation machine.

Inputs of a text: its words hashed to buckets (counts, scaled to unit length) and
statistics of its structure and size, standardised. The score adds to a linear part the
pairwise interactions of all inputs through short vectors v, in linear time by
sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over factors ((sum v x)^2 - sum v^2 x^2).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from . import words as W
from .common import ship
from .labelled import sample

BUCKETS, FACTORS = 4096, 8
#: Classes of bytes whose shares are inputs.
KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\x0b\x0c\r", "line": b"\n", "stop": b".,", "bang": b"!?", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "quote": b"\"'():;-"}
N_STATS = len(KINDS) + 7


def inputs(texts):
    """Sparse hashed words as (document, bucket, value) and the table of statistics, for an Arrow array of texts."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    words, offsets = W.split(texts, lower=True)
    h = W.hashes(words)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(n), counts)
    bucket = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    keys, times = np.unique(doc * BUCKETS + bucket, return_counts=True)
    at, value = keys // BUCKETS, np.log1p(times)
    norm = np.sqrt(np.bincount(at, value**2, n))
    value = value / np.maximum(norm[at], 1e-9)
    data = np.frombuffer(b"".join(x.as_buffer().to_pybytes() if len(x.as_py()) else b"" for x in texts), np.uint8) if n else np.empty(0, np.uint8)
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    stats = np.zeros((n, N_STATS))
    length = np.maximum(sizes, 1)
    for j, kind in enumerate(KINDS.values()):
        table = np.zeros(256, np.int32)
        table[list(kind)] = 1
        stats[:, j] = np.diff(np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))[ends]) / length
    high = np.concatenate(([0], np.cumsum(data > 127, dtype=np.int64)))
    distinct = np.unique(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ h, return_index=True)[1]
    different = np.bincount(doc[distinct], minlength=n)
    widths = np.asarray(pc.binary_length(words)).astype(float)
    many = np.maximum(counts, 1)
    k = len(KINDS)
    stats[:, k] = np.diff(high[ends]) / length
    stats[:, k + 1] = np.log1p(sizes)
    stats[:, k + 2] = np.log1p(counts)
    stats[:, k + 3] = np.bincount(doc, widths, n) / many
    stats[:, k + 4] = different / many
    stats[:, k + 5] = np.bincount(at, np.expm1(np.log1p(times)) ** 2, n) / many**2
    stats[:, k + 6] = counts == 0
    return at, keys % BUCKETS, value, stats


class Machine:
    """Weights of a fitted machine; inputs are the buckets followed by the statistics."""

    def __init__(self, bias, linear, factors, mean, scale):
        self.bias, self.linear, self.factors, self.mean, self.scale = bias, linear, factors, mean, scale

    def margins(self, at, bucket, value, stats):
        """Linear part plus interactions, one pass over the inputs."""
        n = len(stats)
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        v, w = self.factors, self.linear
        total = x @ v[BUCKETS:]
        squares = (x**2) @ (v[BUCKETS:] ** 2)
        plain = self.bias + x @ w[BUCKETS:] + np.bincount(at, value * w[bucket], n)
        for f in range(v.shape[1]):
            part = value * v[bucket, f]
            total[:, f] += np.bincount(at, part, n)
            squares[:, f] += np.bincount(at, part**2, n)
        return plain + 0.5 * (total**2 - squares).sum(1)

    def scores(self, texts):
        return 1 / (1 + np.exp(-np.clip(self.margins(*inputs(texts)), -30, 30)))


def train(texts, y, epochs=25, batch=256, rate=0.02, decay=1e-4, seed=17):
    """Fit by Adam on the log loss, on a bounded sample."""
    at, bucket, value, stats = inputs(pa.array(texts, pa.string()))
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    x = np.zeros((len(texts), BUCKETS + N_STATS), np.float32)
    x[at, bucket] = value
    x[:, BUCKETS:] = np.clip((stats - mean) / scale, -4, 4)
    draw = np.random.Generator(np.random.PCG64(seed))
    share = (y.sum() + 1) / (len(y) + 2)
    params = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(x.shape[1], np.float32), draw.normal(0, 0.02, (x.shape[1], FACTORS)).astype(np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            xb, step = x[rows], step + 1
            b, w, v = params
            sums = xb @ v
            margin = b[0] + xb @ w + 0.5 * (sums**2 - (xb**2) @ (v**2)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            grads = [np.array([g.sum()], np.float32), xb.T @ g + decay * w, xb.T @ (g[:, None] * sums) - v * ((xb**2).T @ g)[:, None] + decay * v]
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    b, w, v = (p.astype(float) for p in params)
    return Machine(float(b[0]), w, v, mean, scale)


def fit(docs, labels, label="quality", id_col="doc_id", text_col="text", max_rows=4000):
    """Fit on a bounded sample of labelled rows that are not held out."""
    texts, y = sample(docs, labels, label, id_col, text_col, max_rows)
    if not len(texts):
        return Machine(0.0, np.zeros(BUCKETS + N_STATS), np.zeros((BUCKETS + N_STATS, FACTORS)), np.zeros(N_STATS), np.ones(N_STATS))
    return train(texts, y)


def _score(machine):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "_text"):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("_id"), "score": pa.array(machine.scores(part.column("_text")))})

    return run


def score_texts(docs, machine, id_col="doc_id", text_col="text"):
    """doc_id and score of every row, from the whole text; null and empty texts are scored by their statistics."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return base.mapInArrow(_score(machine), "doc_id long, score double")
