"""Connected components of a link table by alternating star contractions.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Each round shrinks the paths to the smallest member; the number of rounds is
about logarithmic. Edges stay in Spark throughout and every round is cut off
by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
    joined = both.join(least, "hi").where("lo > hi")
    return joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that ``links`` (a, b) touches.

    ``component`` is the smallest node reachable. Repeated links, both
    directions and self links are fine; nodes without links are not returned
    (they are their own component). Null ends are ignored. An empty input
    gives an empty result.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = materialize(e, "links")
    mark = _mark(e)
    while mark[0]:
        before, e = e, materialize(_small_star(_large_star(e)), "links")
        discard(before)
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select("lo", "lo").distinct()
    )
