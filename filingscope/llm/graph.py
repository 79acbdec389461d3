"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.store import narrow, save


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return r[0], r[1] or 0


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node that has an edge to another.

    Large-star hangs larger neighbours under the smallest one, small-star the smaller ones; both keep components,
    and their alternation ends in stars after logarithmically many rounds.  Nothing but totals reach the driver.  The smallest
    neighbours come from a minimum that is combined on the map side and are written before they meet the edges, so that a
    node with very many neighbours meets them in a broadcast or in a join whose large partitions Spark can split.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = save(_hung(both, F.least("a", "m"), name).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        small = _hung(large, F.col("m"), name).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = save(small.distinct(), name)
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _hung(edges: DataFrame, least, name: str) -> DataFrame:
    """``edges`` with ``m``: ``least`` of a and its smallest neighbour."""
    smallest = save(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", least.alias("m")), name)
    return edges.join(narrow(smallest), "a")
