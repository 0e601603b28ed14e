"""Connected components of a link table as Spark jobs (alternating large-star and small-star rounds).

Each round is two aggregates with map-side combine and two joins, and is written to the shared checkpoint folder, so
a lost executor repeats one round.  Nothing is collected but two numbers per round (edge count and checksum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v), u > v.  Large star: strictly larger neighbours go to the smallest neighbour (or the node itself);
    small star: the node and its smaller neighbours go to the smallest of them."""
    if small:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where(F.col("v") > F.col("u")).join(low, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link with the smallest node it reaches.  Self links and nulls are ignored.

    Runs until a round changes nothing; there is no cap on rounds.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    edges = edges.where("__a is not null and __b is not null and u != v").select("u", "v").distinct()
    edges = stored(edges, "cc0")
    state, done = _state(edges), False
    while not done and state[0]:
        edges = stored(_star(_star(edges, small=False), small=True), "cc")
        after = _state(edges)
        done, state = after == state, after
    root = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
