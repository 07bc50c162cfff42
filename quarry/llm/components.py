"""Connected components of a table of links, by alternating star contractions.

Each round sends every node's smallest neighbour to its larger neighbours, then
to its smaller ones, which flattens every component to a star in a number of
rounds that grows with the logarithm of its diameter. Nothing is collected but
two numbers a round, that tell whether the links still change. A table of few
links is held in one partition, so that its rounds need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import checkpointed


#: Links (two keys each) that one task takes in a round, at most; with more, all rounds are dealt out by key.
MAX_LINKS_OF_ONE_TASK = 200_000


def _star(links: DataFrame, own: str, other: str, keep: Column) -> DataFrame:
    """Links every ``other`` of a node ``own`` that ``keep`` admits to the smallest of them all."""
    smallest = links.groupBy(F.col(own).alias("own")).agg(F.least(F.first(F.col(own)), F.min(other)).alias("low"))
    return links.filter(keep).join(smallest, links[own] == smallest["own"]).select(F.col(other).alias("a"), F.col("low").alias("b"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has a link.

    ``links`` has columns a and b of one orderable type, in any direction and
    with any repeats; loops count for nothing. Returns ``node`` and
    ``component``, the smallest node that it reaches. An empty table gives an
    empty table. Raises RuntimeError when the rounds don't settle.
    """
    links = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    few = links.count() <= MAX_LINKS_OF_ONE_TASK
    gathered = lambda df: df.coalesce(1) if few else df
    seen = None
    for _ in range(max_rounds):
        both = gathered(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = _star(both, "a", "b", F.col("b") > F.col("a")).filter("a <> b").distinct()
        small = _star(large, "a", "b", F.lit(True)).filter("a <> b")
        # the node itself joins its smallest neighbour as well
        lowest = large.groupBy("a").agg(F.min("b").alias("b"))
        links = checkpointed(gathered(small.unionByName(lowest)).distinct())
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
