"""Connected components of links, without gathering any of them in one place."""

from pyspark.sql import functions as F

from .common import beside, discard, rows_of, sized, stored


def connected_components(links, a="a", b="b", max_rounds=60):
    """node and root (the least node of its component) for every node of a link table.

    Each round takes the least label among neighbours, then the label of that label;
    labels are stored between rounds. A chain of n links needs about log n rounds.
    """
    both = sized(stored(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))), "links"))
    after = sized(stored(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")).select(F.col("x").alias("node"), "root"), "labels"))
    labels = after
    for _ in range(max_rounds):
        to = beside(labels.withColumnRenamed("node", "y"), after)
        near = beside(both.join(to, "y").groupBy("x").agg(F.min("root").alias("least")), after)
        better = labels.join(near, labels["node"] == near["x"], "left").select("node", "root", F.least("root", F.coalesce("least", "root")).alias("least"))
        jump = beside(labels.select(F.col("node").alias("least"), F.col("root").alias("further")), after)
        before, after = after, sized(stored(better.join(jump, "least", "left").select("node", F.least("least", F.coalesce("further", "least")).alias("next"), "root"), "labels"), rows_of(after))
        discard(before)
        labels = after.select("node", F.col("next").alias("root"))
        if after.where("next <> root").isEmpty():
            discard(both)
            labels._millrace_rows = after._millrace_rows
            return labels
    raise RuntimeError("components did not settle; links form a chain of extreme length")


def tied(groups, links):
    """Groups (node, root) after further links (a, b) between their nodes: only roots that the links tie are looked at again.

    Every end of a link must be a node of `groups`, best a sized frame, as the result is; the least node of a group stays its root.
    """
    ends = links.select("a", "b").join(beside(groups.select(F.col("node").alias("a"), F.col("root").alias("x")), groups), "a")
    ends = ends.join(beside(groups.select(F.col("node").alias("b"), F.col("root").alias("y")), groups), "b").where("x <> y")
    ends = sized(stored(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "ties"))
    if ends.isEmpty():
        return groups
    found = connected_components(ends)
    roots = beside(found.select(F.col("node").alias("root"), F.col("root").alias("now")), found)
    return sized(stored(groups.join(roots, "root", "left").select("node", F.coalesce("now", "root").alias("root")), "groups"), rows_of(groups))
