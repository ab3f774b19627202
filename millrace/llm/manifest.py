"""Merkle manifest of a table: a tree of digests per group, a root over the groups, a proof per row.

Leaves are numbered within their group, so the size of every level, and with it the arity
of every parent, is known before a parent is met. Building is driven by events: a task
combines children by key into partial parents, each an index of child digests, and the
child that completes a parent makes the task emit it and hand it on to its own parent.
As ranges of leaves lie together, only parents at the edges of a range stay open; their
children are the frontier, which is shuffled by an ancestor and combined again, a few
levels a round. An emitted parent links back to its children; following these links down
from the root gives every leaf its proof.
"""

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ship, stored
from .ordered import indexed

ARITY = 8
#: Levels that a round of the frontier climbs, and that a step of the proofs goes down: ARITY to the power of it bounds what a key holds.
CLIMB, DESCENT = 6, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.binary()), ("kids", pa.binary())])
NODE_TYPE = "tree string, n long, level int, index long, digest binary, kids binary"


def encoded(column):
    """A field of a leaf: `-` if null, else its bytes counted, a colon and itself."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(**fields):
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in fields.values()]), 256))


def digest_of(digests):
    """H of digests given as bytes one after the other, taken as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def _count(n, level):
    """Nodes on a level of a tree of n leaves."""
    return -(-n // ARITY**level)


def height(n):
    level = 0
    while _count(n, level) > 1:
        level += 1
    return level


def _batch(rows, schema):
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _combine(top):
    """Partial parents by key, up to a level: completed ones with the digests of their children, then what is left open."""

    def run(batches):
        held = {}
        for batch in batches:
            out = []
            for tree, n, level, index, digest in zip(*[batch.column(c).to_pylist() for c in ("tree", "n", "level", "index", "digest")], strict=True):
                while True:
                    width = _count(n, level)
                    if width == 1 or level >= top:
                        out.append((tree, n, level, index, digest, None))
                        break
                    key = (tree, n, level + 1, index // ARITY)
                    partial = held.setdefault(key, {})
                    partial[index % ARITY] = digest
                    if len(partial) < min(ARITY, width - ARITY * key[3]):
                        break
                    kids = b"".join(partial[i] for i in sorted(held.pop(key)))
                    level, index, digest = level + 1, key[3], digest_of(kids)
                    out.append((tree, n, level, index, digest, kids))
            yield _batch(out, NODE)
        yield _batch([(tree, n, level - 1, parent * ARITY + i, d, None) for (tree, n, level, parent), partial in held.items() for i, d in partial.items()], NODE)

    return run


def forest(leaves, name):
    """Parents of all trees with their children (nodes), the top of every tree (tops), and the tallest tree's height.

    leaves: tree, n, index, digest; best in the order of tree and index.
    """
    start = leaves.select("tree", "n", F.lit(0).alias("level"), "index", "digest")
    tallest = height(start.agg(F.max("n")).first()[0] or 1)
    done = stored(start.mapInArrow(_combine(1 << 30), NODE_TYPE), f"{name}-nodes")
    nodes, front, climbed = [done.where("kids IS NOT NULL")], done.where("kids IS NULL"), 0
    top = lambda df: df.where(F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), "level")) == 1)
    tops = [top(front)]
    while climbed < tallest:
        climbed += CLIMB
        front = front.where(F.ceil(F.col("n") / F.pow(F.lit(float(ARITY)), "level")) > 1)
        below = front.where(F.col("level") < climbed)
        span = lambda level: F.pow(F.lit(float(ARITY)), level).cast("long")
        below = below.withColumns({"_under": F.floor(F.col("index") / span(F.lit(climbed) - F.col("level"))), "_from": F.col("index") * span(F.col("level"))})
        below = below.repartition("tree", "_under").sortWithinPartitions("tree", "_under", "_from", "level")
        found = stored(below.select("tree", "n", "level", "index", "digest").mapInArrow(_combine(climbed), NODE_TYPE), f"{name}-frontier")
        nodes.append(found.where("kids IS NOT NULL"))
        resolved = found.where("kids IS NULL")
        tops.append(top(resolved))
        front = resolved.unionByName(front.where(F.col("level") >= climbed))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, tops), tallest


def _siblings(kids, i):
    """One step of a proof: the child's place, how many siblings it has, and their digests."""
    others = kids[: 32 * i] + kids[32 * i + 32 :]
    return bytes((i, len(others) // 32)) + others


def unfold(path):
    """(place, sibling digests) of a proof, level by level."""
    at = 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        yield place, path[at + 2 : at + 2 + 32 * count]
        at += 2 + 32 * count


def fold(digest, path):
    """The root that a leaf's digest and a proof lead to."""
    for place, others in unfold(path):
        digest = digest_of(others[: 32 * place] + digest + others[32 * place :])
    return digest


def proof_digest(path):
    return digest_of(b"".join(others for _, others in unfold(path)))


def _follow(names, schema, finish):
    """Paths of the rows of `kind` 2 from those of their tree's upper node (0) and the links of the nodes between (1)."""

    def run(batches):
        key, paths, carried = None, {}, None
        for batch in batches:
            out = []
            for row in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                r = dict(zip(names, row, strict=True))
                if (r["tree"], r["under"]) != key:
                    key, paths = (r["tree"], r["under"]), {}
                if r["kind"] == 0:
                    paths, carried = {(r["level"], r["index"]): r["bytes"]}, (r["subroot"], r["root"])
                    continue
                path = paths[r["level"], r["index"]]
                if r["kind"] == 1:
                    for i in range(len(r["bytes"]) // 32):
                        paths[r["level"] - 1, r["index"] * ARITY + i] = _siblings(r["bytes"], i) + path
                else:
                    out.append(finish(r, path, *carried))
            yield _batch(out, schema)

    return run


def follow(nodes, uppers, lowers, low, high, schema, types, finish):
    """Go down from the level `high` to `low`: what `finish` makes of every row of lowers, its path, subroot and root.

    A key holds what is under one node of the level `high`, so at most ARITY ** DESCENT lower rows.
    """
    under = lambda df: df.withColumn("under", F.floor(F.col("index") / F.pow(F.lit(float(ARITY)), F.lit(high) - F.col("level"))))
    parts = [
        under(uppers.select("tree", "n", "level", "index", F.col("path").alias("bytes"), "subroot", "root", F.lit(0).alias("kind"))),
        under(nodes.where((F.col("level") > low) & (F.col("level") <= high)).select("tree", "n", "level", "index", F.col("kids").alias("bytes"), F.lit(1).alias("kind"))),
        under(lowers.withColumns({"level": F.lit(low), "kind": F.lit(2)})),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.repartition("tree", "under").sortWithinPartitions("tree", "under", "kind", F.desc("level"), "index")
    return rows.mapInArrow(_follow(rows.columns, schema, finish), types)


PATHS = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
PATHS_TYPE = "tree string, n long, level int, index long, path binary, subroot binary, root binary"


def _pass_on(r, path, subroot, root):
    return r["tree"], r["n"], r["level"], r["index"], path, subroot, root


def proofs(nodes, tops, tallest, leaves, schema, types, finish, name):
    """What `finish` makes of every leaf and its path; tops: the uppermost node of each tree with the path above it."""
    at_step = lambda low: tops.where((F.col("level") > low) & (F.col("level") <= low + DESCENT))
    low = DESCENT * max(0, -(-tallest // DESCENT) - 1)
    uppers = at_step(low)
    while low > 0:
        lowers = nodes.where(F.col("level") == low).select("tree", "n", "index")
        # Trees that end on this level enter at the next step.
        lowers = lowers.where(F.ceil(F.col("n") / F.lit(float(ARITY**low))) > 1)
        gone = stored(follow(nodes, uppers, lowers, low, low + DESCENT, PATHS, PATHS_TYPE, _pass_on), f"{name}-paths")
        low -= DESCENT
        uppers = gone.unionByName(at_step(low))
    return follow(nodes, uppers.unionByName(tops.where("level = 0")), leaves, 0, DESCENT, schema, types, finish)


ROWS = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_()), ("proof", pa.binary())])
ROWS_TYPE = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary"


def _answer(r, path, subroot, root):
    folded = fold(r["digest"] if r["bent"] is None else r["bent"], path)
    return r["doc_id"], r["digest"].hex(), subroot.hex(), root.hex(), proof_digest(path).hex(), folded.hex(), folded == root, path


def manifest(docs, bent=None, id_col="doc_id", group_col="lang", fields=FIELDS, text_col="text"):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof: one row per input row.

    A leaf is the digest of a row's fields. Leaves of a group, in the order of their ids
    (missing ones first, equal ones by digest), make a tree whose top is the group's
    subroot; subroots in the order of their groups, null first, make the tree of the root.
    `proof` holds each level's place and sibling digests (see `unfold`); folded_root is
    what it makes of the leaf, or of `bent` (an expression for a changed text, null where
    it is not changed), and verified whether that is the root. A null text or field has a
    code of its own, an empty one another; texts of any length are hashed whole; rows that
    repeat are leaves each; a group of one row is its own subroot; extra columns do not
    matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    of = {c: F.col(c) for c in fields}
    changed = F.lit(None).cast("binary") if bent is None else F.when(bent.isNotNull(), leaf(**(of | {text_col: bent})))
    rows = docs.select(F.col(group_col).cast("string").alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf(**of).alias("digest"), changed.alias("bent"))
    leaves = stored(indexed(stored(rows, "leaves"), ["tree"], ["doc_id", "digest"], "ordered-leaves"), "indexed-leaves")
    nodes, tops, tallest = forest(leaves, "leaf")
    groups = indexed(tops.select("tree", F.col("n").alias("leaves"), F.col("level").alias("at"), "digest"), [], ["tree"], "subroots")
    groups = stored(groups.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "leaves", "at", "digest", "index", "n"), "indexed-subroots")
    upper, root, above = forest(groups, "subroot")
    start = root.select("tree", "n", "level", "index", F.unhex(F.lit("")).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    paths = proofs(upper, start, above, groups, PATHS, PATHS_TYPE, lambda r, path, _, root: (r["of"], r["leaves"], r["at"], 0, path, r["digest"], root), "subroot")
    return proofs(nodes, stored(paths, "subroot-paths"), tallest, leaves, ROWS, ROWS_TYPE, _answer, "leaf")


def lowered_thirds(id_col="doc_id", text_col="text"):
    """The tampering that the query tests: texts lower-cased where 3 divides the CRC of the id."""
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.translate(F.col(text_col), UPPER, LOWER))
