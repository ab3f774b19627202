"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets are shares of all words by weight, held to three times what a source has. The
blocks of the mix go to the sources by highest quotients (target over odd numbers), and
each source's blocks in the same way to its shards, which hash its documents into parts
of like size: integer quotas, of which every shard then draws its own by a seeded order.
A shard's quota takes all its blocks as often as it can and the rest once more, so no
word is taken over three times. All draws are md5, so any engine repeats them.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import SPACES, stored
from .ordered import indexed, same

WEIGHTS, MOST = (5, 2, 1), 3
#: Most words in a block, blocks a mix has of each source on average at least, and blocks in a shard.
BLOCK, FINE, SHARD = 1024, 1000, 1024
SEED = "17"


def n_words(text_col="text"):
    """Runs of other characters than the six ASCII spaces; null has none. Linear in the text."""
    runs = F.regexp_replace(F.btrim(F.col(text_col), F.lit(SPACES)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.char_length(runs), F.lit(0)).cast("long")


def number(*parts):
    """A portable pseudo-random number: the first 60 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 15), 16, 10).cast("long")


def targets(sources):
    """source, size, weight -> target, capped: shares of all words by weight, none above MOST times a source's words.

    Each round holds those above and shares the rest anew by weight, until none is; a round
    is one aggregate over the sources.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    cap = F.col("size") * MOST
    free, weights, before = total, None, -1
    while True:
        above = F.lit(False) if weights is None else F.col("weight") * F.lit(float(free)) / F.lit(float(weights)) > cap
        row = sources.agg(F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if row[2] == before or not row[1]:
            break
        free, weights, before = total - (row[0] or 0), row[1], row[2]
    if weights is None:
        return sources.withColumns({"target": F.lit(0.0), "capped": F.lit(False)})
    share = F.col("weight") * F.lit(float(free)) / F.lit(float(weights))
    return sources.withColumns({"target": F.least(share, cap.cast("double")), "capped": share > cap})


def highest_quotients(claims, seats, group, key, name):
    """claims: group, key, claim (double), most (long) -> seats given to each by Sainte-Lague, as `quota`.

    No group or key is null. seats: group, seats. With S claims the divisor lies between total / (seats + S / 2) and
    total / (seats - S / 2), so all seats but those of at most three quotients a claim are
    settled at once; these few are ranked, equal ones by key. No claim gets more than `most`.
    """
    sums = claims.where("claim > 0").groupBy(*group).agg(F.sum("claim").alias("_total"), F.count(F.lit(1)).alias("_s"))
    meet = lambda left, right: left.join(right, group) if group else left.crossJoin(F.broadcast(right))  # noqa: E731  (one row without a group)
    asked = meet(claims.where("claim > 0"), meet(sums, seats))
    ratio = F.col("claim") / F.col("_total")
    low = F.greatest(F.lit(0), F.floor(ratio * (F.col("seats") - F.col("_s") / 2) + 0.5))
    high = F.ceil(ratio * (F.col("seats") + F.col("_s") / 2) + 0.5)
    asked = asked.withColumns({"_low": F.least(low, "most").cast("long"), "_high": F.least(high, "most").cast("long")})
    asked = stored(asked, f"{name}-claims")
    settled = asked.groupBy(*group).agg(F.max("seats").alias("_seats"), F.sum("_low").alias("_settled"))
    settled = settled.select(*group, (F.col("_seats") - F.col("_settled")).alias("_left"))
    open_ = asked.where("_high > _low").select(*group, *key, "claim", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_a"))
    ranked = indexed(open_.withColumn("_less", -F.col("claim") / (2 * F.col("_a") - 1)), group, ["_less", *key], f"{name}-quotients").drop("n")
    won = meet(ranked, settled).where(F.col("index") < F.col("_left")).groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_won"))
    joined = asked.join(won, [*group, *key], "left")
    return joined.select(*group, *key, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs, id_col="doc_id", source_col="source", text_col="text"):
    """doc_id, size, source, source_size, target, taken: how many of each document's words the mix takes, repeats counted.

    Sources go by code point, null last, and weigh 5, 2, 1 in turn. A source held to three
    times its words gives every word three times; the others' words come within half a
    block, and a part of one for each shard's last, of their targets. Null and empty texts
    have no words and are in no shard; rows that repeat an id are rows each, those equal in
    id and text get any of each other's counts; documents longer than a shard make it so
    much longer; extra columns do not matter; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"),
        F.md5(F.concat_ws("|", F.lit(SEED), F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"),
    )
    rows = stored(rows, "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size")).withColumn("_last", F.col("source").isNull())
    sources = indexed(sources, [], ["_last", "source"], "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("index") % len(WEIGHTS) + 1).cast("int"))
    sources = stored(targets(sources.select("source", "size", F.col("index").alias("place"), weight.alias("weight"))), "targets")
    total, n_sources, held = sources.agg(F.sum("size"), F.count(F.lit(1)), F.sum(F.when(F.col("capped"), F.col("size") * MOST))).first()
    block = min(BLOCK, max(1, (total or 0) // (FINE * max(1, n_sources))))
    per_shard = SHARD * block

    blocks = lambda size: F.ceil(size / F.lit(float(block))).cast("long")
    seats = docs.sparkSession.range(1).select(F.lit((2 * ((total or 0) - (held or 0)) + block) // (2 * block)).cast("long").alias("seats"))
    claims = sources.where("NOT capped").select("place", F.col("target").alias("claim"), (blocks(F.col("size")) * MOST).alias("most"))
    quotas = highest_quotients(claims, seats, [], ["place"], "of-sources").withColumnRenamed("quota", "seats")
    sources = sources.join(quotas, "place", "left").withColumn("n_shards", F.ceil(F.col("size") / F.lit(float(per_shard))).cast("long"))
    sources = stored(sources.select("source", "place", F.col("size").alias("source_size"), "target", "capped", "seats", "n_shards"), "quotas")

    named = rows.join(sources, same(rows, sources, ["source"])).drop(sources["source"])
    some = named.where("size > 0 AND NOT capped").withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 15), 16, 10).cast("long"), F.col("n_shards")))
    shards = stored(some.groupBy("place", "shard").agg(F.sum("size").alias("shard_size")).withColumn("n", blocks(F.col("shard_size"))), "shards")
    claims = shards.select("place", "shard", F.col("shard_size").cast("double").alias("claim"), (F.col("n") * MOST).alias("most"))
    given = highest_quotients(claims, sources.where("seats IS NOT NULL").select("place", "seats"), ["place"], ["shard"], "of-shards")
    # The blocks of a shard that are taken once more are those of the least numbers; `bound` is the last of them.
    order = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: number(F.col("place").cast("string"), F.col("shard").cast("string"), j.cast("string"))))
    drawn = shards.join(given, ["place", "shard"]).withColumns({"times": F.floor(F.col("quota") / F.col("n")), "extra": F.col("quota") % F.col("n")})
    drawn = drawn.select("place", "shard", "times", F.when(F.col("extra") > 0, F.element_at(order, F.col("extra").cast("int"))).otherwise(-1).alias("bound"))

    run = Window.partitionBy("place", "shard").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = some.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0))).join(drawn, ["place", "shard"])
    end = F.col("start") + F.col("size")
    met = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))

    def overlap(j):
        inside = F.least(end, (j + 1) * block) - F.greatest(F.col("start"), j * block)
        return F.when(number(F.col("place").cast("string"), F.col("shard").cast("string"), j.cast("string")) <= F.col("bound"), inside).otherwise(0)

    once_more = F.when(F.col("bound") >= 0, F.aggregate(met, F.lit(0).cast("long"), lambda total, j: total + overlap(j))).otherwise(0)
    out = ["doc_id", "size", "source", "source_size", "target"]
    taken = placed.select(*out, (F.col("times") * F.col("size") + once_more).cast("long").alias("taken"))
    rest = named.where("size = 0 OR capped").select(*out, (F.col("size") * MOST).alias("taken"))
    return taken.unionByName(rest)
