"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for each node of a link.

    ``links`` has two columns of one type; loops and repeated links may occur. Each round hangs the larger
    neighbours of a node, then the smaller ones, below the smallest (alternating stars), until
    nothing changes: about log2 of the longest path rounds. Smallest neighbours are combined inside the map
    tasks, and each round is written to the shared folder.
    """
    one, other = links.columns
    edges = links.select(F.greatest(one, other).alias("u"), F.least(one, other).alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Used twice below: without this, the join over all links runs again for each use.
        large = stored(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        hung = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = stored(hung.where("u <> v").distinct(), "links")
