"""Connected components of a graph given as a DataFrame of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> (node long, root long) for every node of a link; equal roots are one component.

    Each round every node takes, of itself and its neighbours, the one whose hash is least, and links between the taken
    ones go on to the next round. As hashes order the nodes at random, a constant share of the nodes vanishes a round,
    chains and stars alike. Groups only ever meet as partial minima, and all tables stay in the executors.
    """
    links = cut(links.where("u != v").select("u", "v").distinct(), "links")
    out = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v"))).alias("m"))
        taken = cut(least.select("u", F.least("m", F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v")))["v"].alias("t")), "taken")
        if out is None:
            out = taken.select(F.col("u").alias("node"), F.col("t").alias("root"))
        else:
            out = cut(out.join(taken, out["root"] == taken["u"], "left").select("node", F.coalesce("t", "root").alias("root")), "roots")
        a, b = taken.select(F.col("u"), F.col("t").alias("tu")), taken.select(F.col("u").alias("v"), F.col("t").alias("tv"))
        links = cut(links.join(a, "u").join(b, "v").where("tu != tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct(), "links")
        if links.isEmpty():
            return out
