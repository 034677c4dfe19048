"""Connected components as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoweave.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its component) for the nodes of edges (a, b).

    In each round every node moves to the neighbour, or itself, of least hash, and the
    edges are drawn anew between the places moved to; the hash changes with the round, so
    about half of the places are left each time, also along a path. A round is a written
    table, and its minima combine before they shuffle, so a node with very many edges is no
    burden. Nothing but whether edges are left comes to the driver.
    """
    left = cut_lineage(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    places, turn = None, 0
    while not left.isEmpty():
        ways = left.union(left.select("b", "a"))
        key = lambda x: F.struct(F.xxhash64(F.lit(turn), x).alias("h"), x.alias("to"))  # noqa: B023, E731
        moves = cut_lineage(
            ways.groupBy("a").agg(F.min(key(F.col("b"))).alias("best")).select(
                F.col("a").alias("place"), F.least("best", key(F.col("a")))["to"].alias("next")
            )
        )
        if places is None:
            places = moves.select(F.col("place").alias("node"), F.col("next").alias("place"))
        else:
            places = cut_lineage(places.join(moves, "place", "left").select("node", F.coalesce("next", "place").alias("place")))
        first = moves.select(F.col("place").alias("a"), F.col("next").alias("a2"))
        second = moves.select(F.col("place").alias("b"), F.col("next").alias("b2"))
        left = cut_lineage(
            left.join(first, "a").join(second, "b").where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        )
        turn += 1
    if places is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = places.groupBy("place").agg(F.min("node").alias("component"))
    return places.join(least, "place").select("node", "component")
