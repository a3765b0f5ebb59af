"""Connected components of links, by alternating large-star and small-star rounds; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscore.llm._common import discard, materialize_few


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): every node of a link with the smallest node it reaches, written down.

    Null ends and links of a node with itself are left out. A round costs two joins of as many rows as there are links;
    the number of rounds grows with the logarithm of the longest path.
    """
    clean = links.where("a is not null and b is not null and a != b")
    edges = materialize_few(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", getattr(links, "txscore_rows", None))
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")
        before, edges = edges, materialize_few(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small", 2 * edges.txscore_rows)
        old, state = state, _state(edges)
        discard(before)
        if old == state:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    out = materialize_few(nodes, "components", 2 * edges.txscore_rows)
    discard(edges)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
