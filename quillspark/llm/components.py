"""Connected components of a graph given as links, without any node's links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._common import staged


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(u, v), component being its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
    MapReduce and Beyond" (2014). A step takes each node's smallest neighbour by an aggregation
    (combined before the shuffle), writes it to the shared folder and joins it back, so a hub's links
    are never gathered and the join can split them. Each round is written, too. Self-links and repeated links are allowed; without links
    the result is empty.
    """
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _signature(edges)
    for _ in range(most_rounds):
        # Large-star: a node's larger neighbours go to the smallest node among itself and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components are not found after {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
