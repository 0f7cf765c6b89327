"""Connected components of a table of links, by contraction.

Each round points every node to its smallest neighbour (or itself), follows the
pointers once more, and rewrites the links; nodes only ever move to smaller
ones of their component, and a link between a node and its pointer keeps their
images linked.  It ends when no link joins two different nodes, after a number
of rounds that grows with the logarithm of the longest chain.  A hub's links
meet in joins that adaptive execution splits: both sides are tables read anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each node of links (a, b): the smallest id that it reaches. Null ends are no links."""
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up = written(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("up")), "pointers")
        far = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
        up = written(up.join(far, "up").select("id", F.col("far").alias("up")), "pointers")
        if labels is None:
            labels = up.select("id", F.col("up").alias("component"))
        else:
            step = up.select(F.col("id").alias("component"), F.col("up").alias("next"))
            labels = written(labels.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "labels")
        a, b = (up.select(F.col("id").alias(x), F.col("up").alias("to" + x)) for x in "ab")
        links = written(links.join(a, "a").join(b, "b").where("toa <> tob").select(F.greatest("toa", "tob").alias("a"), F.least("toa", "tob").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
