"""Connected components of undirected links by alternating star contraction.

Each round every node's larger neighbours are linked to the node's least
neighbour (large star), then its smaller neighbours to the least (small star);
the number of links never grows, and the rounds needed grow with the logarithm
of a component's size. Rounds are written to the shared folder. Minima are
pre-aggregated before the shuffle and joined back, so a hub's links may be split
over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (a, b) with a > b."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("m", "a").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every linked node but the least ones; component is the least node reachable."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") > F.col("b")).distinct()
    edges = store.settled(edges, "links")
    before = None
    for _ in range(most_rounds):
        after = store.settled(_star(_star(edges, True), False), "star")
        state = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the star contraction did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
