"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from pyspark.sql import functions as F

from millrace.llm import bpe, contamination, exact, nearcopies, toxicity
from millrace.llm.common import discard, stored
from millrace.session import table


def toxicity_stage(spark, docs, sf_dir):
    """Documents that the clause grammar rejects go."""
    return toxicity.drop_toxic(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def exact_stage(spark, docs, sf_dir):
    return exact.drop_exact_copies(docs)


def near_stage(spark, docs, sf_dir):
    return nearcopies.drop_near_copies(docs)


def decontamination_stage(spark, docs, sf_dir):
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark, docs, sf_dir):
    """Token ids of what is left, and a digest of the text they decode to."""
    import public_tokenizers

    out = bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Learned scores, alignments and token tables have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)  # the next stage reads this one's rows alone
        before = docs
    return docs
