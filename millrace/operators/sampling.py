"""Deterministic samples, splits, schedules and batches, all by the order of a keyed hash."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Ranges that a column is cut into to be numbered; a bounded list of bounds, whatever the rows.
CELLS = 256


def order_key(seed, *ids):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") if hasattr(i, "cast") else F.col(i).cast("string") for i in ids]))


def simple_sample(df, id_col, k, seed=0):
    """k rows without replacement."""
    return df.orderBy(order_key(seed, id_col), id_col).limit(k)


#: Rows that a task holds before it gives out what it has so far.
HELD = 1 << 17


def _kept(table, stratum, id_col, want, before=(None, 0)):
    """Rows of a sorted table that are among the first `want` of their stratum; `before` is the open stratum and its rows so far."""
    codes = table.column(stratum).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    n = len(codes)
    starts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
    rank = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    first = table.column(stratum)[0].as_py()
    if before[1] and first == before[0]:
        rank[: starts[1] if len(starts) > 1 else n] += before[1]
    wanted = table.column("_want").to_numpy() if want is None else want
    return table.filter(pa.array(rank < wanted)), (table.column(stratum)[n - 1].as_py(), int(rank[-1]) + 1)


def _least(stratum, id_col, want):
    """Keep each stratum's least rows of what a task has read."""
    order = [(c, "ascending") for c in (stratum, "_key", id_col)]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            held = _kept(held.sort_by(order), stratum, id_col, want)[0]
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return run


def _first(stratum, id_col, want):
    """The first rows of each stratum, of rows that come in order."""

    def run(batches):
        before = (None, 0)
        for batch in batches:
            if batch.num_rows:
                out, before = _kept(pa.Table.from_batches([batch]), stratum, id_col, want, before)
                yield from out.to_batches()

    return run


def per_stratum(df, stratum, id_col, k, seed=0):
    """At most k rows of each stratum, those of least keyed hash, equal ones by id; k is a number, or a column that is one within a stratum.

    Tasks keep the least rows of what they read, so only these are shuffled: first by
    stratum and a part of the hash, then by stratum alone. A task holds a bounded number
    of rows; a NULL stratum is one.
    """
    fixed = k if isinstance(k, int) else None
    keyed = df.withColumns({"_key": order_key(seed, id_col), "_want": F.lit(k) if fixed is not None else k})
    least = keyed.mapInArrow(_least(stratum, id_col, fixed), keyed.schema)
    fewer = least.repartition(stratum, F.substring("_key", 1, 1)).mapInArrow(_least(stratum, id_col, fixed), keyed.schema)
    ordered = fewer.repartition(stratum).sortWithinPartitions(stratum, "_key", id_col)
    return ordered.mapInArrow(_first(stratum, id_col, fixed), keyed.schema).drop("_key", "_want")


def quota_sample(df, stratum, id_col, quotas, seed=0):
    """Exactly the quota of each stratum; a stratum that is short is an error when the rows are read."""
    want = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum)), F.lit(0))
    counts = df.groupBy(F.col(stratum).alias("_of")).agg(F.count(F.lit(1)).alias("_have"))
    short = F.raise_error(F.concat(F.lit("stratum too small: "), F.col(stratum).cast("string")))
    sized = df.withColumn("_quota", want).where(F.col("_quota") > 0).join(counts, F.col(stratum).eqNullSafe(F.col("_of")))
    checked = sized.withColumn("_quota", F.when(F.col("_have") >= F.col("_quota"), F.col("_quota")).otherwise(short.cast("int")))
    return per_stratum(checked, stratum, id_col, F.col("_quota"), seed).drop("_quota", "_have", "_of")


def one_per_cluster(df, cluster, id_col, seed=0, where=None):
    """One row of each cluster, among those that meet a condition."""
    return per_stratum(df.where(where) if where is not None else df, cluster, id_col, 1, seed)


def split(df, id_col, seed=0, shares=(0.6, 0.2, 0.2), names=("train", "validation", "test")):
    """Three-way split by hash bucket; a row's part never depends on other rows."""
    u = F.conv(F.substring(order_key(seed, id_col), 1, 8), 16, 10).cast("double") / 2**32
    part, edge = F.lit(names[-1]), sum(shares[:-1])
    for name, share in reversed(list(zip(names[:-1], shares[:-1], strict=True))):
        part = F.when(u < edge, name).otherwise(part)
        edge -= share
    return df.withColumn("part", part)


def numbered(df, cell, *order, name="number"):
    """Rows numbered from 0 in an order that `cell`, an expression, does not break: later cells hold later rows.

    Each cell is sorted by itself, and what stands before it is summed over the cells
    alone, so no task sorts the whole table. Rows equal in `order` get any of their numbers.
    """
    celled = df.withColumn("_cell", cell)
    sizes = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_cell").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    ranked = celled.withColumn("_within", within).join(F.broadcast(offsets), F.col("_cell").eqNullSafe(F.col("_of")))
    return ranked.withColumn(name, F.col("_before") + F.col("_within")).drop("_cell", "_of", "_before", "_within")


def range_bounds(df, *columns, cells=CELLS):
    """One row that cuts each numeric column into at most so many ranges of like counts: arrays `_bounds_<column>`, of all columns in one pass.

    A column that is no number has no bounds and is a single range.
    """
    shares = [i / cells for i in range(1, cells)]
    of = lambda c: F.percentile_approx(c, shares, 4 * cells).cast("array<double>") if isinstance(df.schema[c].dataType, NumericType) else F.lit(None).cast("array<double>")
    return df.agg(*[of(c).alias(f"_bounds_{c}") for c in columns])


def range_of(value, bounds, cells=CELLS):
    """How many bounds a value exceeds, found by halving; NULL is a range of its own, before the others.

    Any bounds give right numbers, since equal values share a range; a value of many rows makes its range large.
    """
    steps = [1 << i for i in reversed(range((cells - 1).bit_length()))]
    found = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))
    return F.when(value.isNull(), -1).when(bounds.isNull(), 0).otherwise(found)


def shuffled(df, *ids, seed=0):
    """A seeded order of a schedule, numbered from 0; the key is a hash, so its first digits are cells of like size."""
    key = order_key(seed, *ids)
    return numbered(df, F.substring(key, 1, 2), key, *ids, name="order").withColumn("order", F.col("order").cast("int"))


def fixed_batches(df, size, *order):
    """Number of the batch of `size` rows that each row falls in; best where the first column of the order is a number."""
    bounds = f"_bounds_{order[0]}"
    cut = df.crossJoin(F.broadcast(range_bounds(df, order[0])))
    cell = range_of(F.col(order[0]), F.col(bounds)) if isinstance(df.schema[order[0]].dataType, NumericType) else F.lit(0)
    rows = numbered(cut, cell, *order, name="_number")
    return rows.withColumn("batch", F.floor(F.col("_number") / size).cast("int")).drop("_number", bounds)


def page(df, start, count, *order):
    return df.orderBy(*order).offset(start).limit(count)


def two_raters(df, id_col, label, categories, noise=0.1, seed=0):
    """A second rater made from the first: with probability `noise` another category, by hash."""
    key = order_key(seed, id_col)
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2**32
    other = F.element_at(F.array(*[F.lit(c) for c in categories]), (F.conv(F.substring(key, 9, 6), 16, 10).cast("int") % len(categories)) + 1)
    return df.withColumn("second", F.when(u < noise, other).otherwise(F.col(label)))
