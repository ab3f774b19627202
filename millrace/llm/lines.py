"""Line dedup: drop lines whose normalised form occurs in many documents."""

from pyspark.sql import functions as F

from .common import LOWER, SPACES, UPPER, row_key, stored, text_or_empty


def _lines(text_col):
    return F.split(text_or_empty(text_col), "\n", -1)


def _key(line):
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def drop_repeated_lines(docs, id_col="doc_id", text_col="text", min_docs=10, min_chars=1):
    """Drop every line whose key is found in at least `min_docs` distinct documents.

    Adds n_lines, n_dropped, kept_text to one row per input row.

    Keys are compared by 128 bits of hash. Null and empty texts hold one empty line,
    whose key is too short to be dropped. A document whose lines all go keeps the
    empty text. Rows that repeat an id count as one document; each row is answered.
    Existing columns called n_lines, n_dropped or kept_text are replaced. An empty
    table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), F.transform(_lines(text_col), _key).alias("keys"))
    lines = (
        keyed.select("_id", "k1", "k2", F.posexplode("keys").alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select("_id", "k1", "k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    # Distinct (line, document) pairs first: a line of a third of all documents is spread by document.
    frequent = stored(
        lines.select("h1", "h2", "_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"),
        "frequent-lines",
    )
    dropped = lines.join(frequent, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("pos").alias("_drop"))
    plain = docs.drop("n_lines", "n_dropped", "kept_text")
    keys = row_key(F.col(id_col), F.col(text_col))
    joined = plain.withColumns({"_k1": keys[0], "_k2": keys[1]}).join(
        dropped.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_drop"), ["_k1", "_k2"], "left"
    )
    lines_of = _lines(text_col)
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.array_except(places, "_drop")
    return (
        joined.withColumn("_lines", lines_of)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long"))
        .withColumn(
            "kept_text",
            F.when(F.col("_drop").isNull(), text_or_empty(text_col)).otherwise(
                F.concat_ws("\n", F.transform(kept, lambda i: F.get("_lines", i)))
            ),
        )
        .drop("_lines", "_drop", "_k1", "_k2")
    )
