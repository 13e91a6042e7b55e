"""Connected components by contraction, wholly in Spark.

Each round hooks every vertex to its smallest neighbour, shortens the pointers,
and contracts the edges to the pointers' ends; edges inside one vertex vanish.
Every round removes at least half of the vertices that still have edges, so the
rounds grow with the logarithm of the largest component.  Tables of a round are
stored in the shared folder; only their emptiness comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of non-null integers -> (id, component) for every vertex of an
    edge between different ids; component is the smallest id of its component."""
    e = stored(edges.where("a <> b").select(F.least("a", "b").cast("bigint").alias("a"),
                                            F.greatest("a", "b").cast("bigint").alias("b")).distinct())
    found = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # pointer of a vertex: the smallest of itself and its neighbours
        hook = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("id"), F.least("a", "m").alias("to")))
        # two pointer jumps
        for _ in range(2):
            up = hook.select(F.col("id").alias("to"), F.col("to").alias("top"))
            hook = hook.join(up, "to").select("id", F.col("top").alias("to"))
        hook = stored(hook)
        if found is None:
            found = hook
        else:
            up = hook.select(F.col("id").alias("to"), F.col("to").alias("top"))
            found = stored(found.join(up, "to", "left").select("id", F.coalesce("top", "to").alias("to")))
        ha, hb = hook.select(F.col("id").alias("a"), F.col("to").alias("na")), hook.select(F.col("id").alias("b"),
                                                                                           F.col("to").alias("nb"))
        e = stored(e.join(ha, "a").join(hb, "b").where("na <> nb").select(
            F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    if found is None:
        return edges.sparkSession.createDataFrame([], "id bigint, component bigint")
    return found.select("id", F.col("to").alias("component"))
