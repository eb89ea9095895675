"""Connected components of a table of links, without bringing links or members to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every end of a link (a, b: long); comp is the smallest node that can be reached.

    Rounds: each node takes the smallest label among its neighbours' and its own, then the label of its label, so a
    path of n nodes takes about log n rounds. Each round is written, so a lost executor costs one round at most.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("before"))
        least = materialize(least, "labels")
        above = least.select(F.col("node").alias("n"), F.col("comp").alias("up"))
        after = materialize(least.join(above, F.col("comp") == F.col("n")).select("node", F.least("comp", "up").alias("comp"), "before"), "labels")
        if not after.where("comp <> before").limit(1).count():
            return after.select("node", "comp")
        labels = after.select("node", "comp")


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links, whose ends are nodes: only groups are linked anew, by their labels."""
    if labels is None:
        return components(links)
    a, b = (labels.select(F.col("node").alias(f"n{x}"), F.col("comp").alias(f"c{x}")) for x in "ab")
    grouped = links.join(a, F.col("a") == F.col("na"), "left").join(b, F.col("b") == F.col("nb"), "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(grouped)
    up = more.select(F.col("node").alias("n"), F.col("comp").alias("up"))
    old = labels.join(up, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("up", "comp").alias("comp"))
    new = more.join(labels.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new), "labels")
