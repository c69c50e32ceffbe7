"""Connected components of a table of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Of links (a, b) with a > b: a node's larger neighbours go to the smallest of it and its neighbours."""
    near = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    lows = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(lows, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of links (a, b) with a > b: a node and its smaller neighbours go to the smallest of these."""
    lows = edges.groupBy("a").agg(F.min("b").alias("m"))
    both = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    return edges.join(lows, "a").select(F.inline(both)).where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest reachable node) for each node of ``links(a, b)``.

    Alternates large-star and small-star, each a written table: a lost executor costs one of them at most, and
    the driver plans one at a time, not both within each other.  Only two numbers a round reach the driver.
    """
    told = {"n": F.count("*"), "s": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", **told)
    before = None
    for _ in range(most_rounds):
        if edges.told == before or edges.told["n"] == 0:
            break
        before = edges.told
        edges = materialize(_small_star(materialize(_large_star(edges), "links")), "links", **told)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b")).distinct()
