"""Connected components of a graph that is a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, discard


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of every node that has a link: (id, label), label the smallest id reachable.

    Rounds of large-star and small-star steps (Kiveris et al., 2014): first
    every node ties its larger neighbours to the smallest node it knows, then
    every node ties its smaller neighbours, and itself, to the smallest of
    them.  The number of links never grows, and after about log n rounds, for a
    path of n nodes in any order too, each component is a star around its
    smallest node.  Each round writes its links, so that plans and their size
    estimates stay small.

    A node with very many links costs no single task: minima are reduced before
    the shuffle, and both sides of every join are plain tables, so that Spark
    can split a hot key.  Links may repeat, lie in either direction or join a
    node to itself; rows with a null end are no links.  No links give no rows.
    """
    # Links are read once: two readings may hold different, equally good links.
    links = checkpointed(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    loops = links.where("a = b").select(F.col("a").alias("id"), F.col("b").alias("label"))
    edges = links.where("a != b")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n")))
        if near.where("low < id and (high > id or n > 1)").isEmpty():
            labels = near.select("id", F.least("id", "low").alias("label"))
            return labels.unionByName(loops).groupBy("id").agg(F.min("label").alias("label"))
        large = both.where("b > a").join(near, F.col("a") == F.col("id")).select(F.col("b").alias("a"), F.least("low", "id").alias("b"))
        large = checkpointed(large.distinct())
        low = large.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
        ends = F.explode(F.array("a", "b")).alias("a")
        small = large.join(low, F.col("a") == F.col("id")).select(ends, F.col("low").alias("b")).where("a != b")
        before, edges = edges, checkpointed(small.distinct())
        discard(large, near, *([before] if before is not links else []))
