"""A bounded sample of labelled rows for fitting on the driver."""

import numpy as np
from pyspark.sql import functions as F

from .common import held_out

#: Most labelled rows a classifier is fitted on, the first in the order of a hash of their ids.
MAX_ROWS = 4000
#: Most bytes of text in it, so that it fits the driver: rows are taken in that order, whole texts of any length, until the next would not fit.
MAX_BYTES = 64 << 20


def sample(docs, labels, label, id_col="doc_id", text_col="text", max_rows=MAX_ROWS, max_bytes=MAX_BYTES):
    """Texts and 0/1 labels of at most `max_rows` rows and `max_bytes` of text that are not held out.

    Rows without a text or label are left out; equal texts are taken once. The bounds are
    those of the sample alone: a text is taken whole, whatever its size.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col(text_col).isNotNull()).join(F.broadcast(ids), "_id")
    rows = rows.groupBy("_id", "_text").agg(F.max("_label").alias("_label"))
    sizes = rows.select("_id", F.octet_length("_text").alias("n")).groupBy("_id").agg(F.sum("n").alias("n"), F.xxhash64("_id").alias("h")).orderBy("h", "_id").collect()
    total = np.cumsum([r["n"] for r in sizes])
    if len(total) and total[-1] > max_bytes:
        fits = [int(r["_id"]) for r, t in zip(sizes, total, strict=True) if t <= max_bytes]
        rows = rows.where(F.col("_id").isin(fits))
    found = {}
    for row in rows.select("_id", "_text", "_label").collect():
        found.setdefault(row["_text"], []).append((int(row["_id"]), int(row["_label"])))
    found = {text: min(of) for text, of in found.items()}
    texts = sorted(found, key=lambda t: found[t])
    return texts, np.array([found[t][1] for t in texts], float)


def with_split(scored, threshold, id_col="doc_id"):
    """The digest columns of a classifier's query."""
    return scored.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col("score"), (F.col("score") >= threshold).cast("int").alias("predicted")
    )
