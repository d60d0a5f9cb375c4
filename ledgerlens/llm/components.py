"""Connected components of an edge list, as Spark jobs.

Alternating large-star and small-star rounds: every node passes the smallest
node it knows to its larger (then to its smaller) neighbours. Each round is a
grouped minimum (map-side combined) and one equi-join that the optimiser may
split when a node has very many neighbours; the edge list never grows. Rounds
are checkpointed, so lineage stays short and a lost executor costs one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _min_neighbour(e: DataFrame) -> DataFrame:
    return (e.groupBy("u").agg(F.min("v").alias("m"))
            .select(F.col("u").alias("c"), F.least("u", "m").alias("m")))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    j = both.join(_min_neighbour(both), F.col("u") == F.col("c"))
    return (j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    j = down.join(_min_neighbour(down), F.col("u") == F.col("c"))
    pulled = j.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = _min_neighbour(down).select(F.col("c").alias("u"), F.col("m").alias("v"))
    return pulled.union(own).filter("u <> v").distinct()


def _only_stars(e: DataFrame) -> bool:
    """Whether every node has one target at most and no target has one itself: then each component is a star around
    its smallest node, and further rounds would change nothing."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.filter("up + down > 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns ``u``, ``v`` of one orderable type. Returns one row
    per node that has an edge to another node: ``node``, ``component`` (the
    smallest node reachable). Rows with a null end and loops are ignored; an
    empty edge list gives an empty result."""
    e = cut(edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct())
    while True:
        e = cut(_small_star(_large_star(e)))
        if _only_stars(e):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def joined_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (of ``connected_components``) after ``more`` edges: only the components that these join are looked at again."""
    if more.isEmpty():
        return found
    ends = more.select("u", "v")
    for end in ("u", "v"):
        name = found.select(F.col("node").alias("n"), F.col("component").alias("c"))
        ends = ends.join(name, ends[end] == name["n"], "left").withColumn(end, F.coalesce("c", end)).select("u", "v")
    again = cut(connected_components(ends).withColumnsRenamed({"node": "n", "component": "c"}))
    moved = found.join(again, found["component"] == again["n"], "left").select("node", F.coalesce("c", "component").alias("component"))
    fresh = again.join(found.select("node"), again["n"] == found["node"], "left_anti").select(F.col("n").alias("node"), F.col("c").alias("component"))
    return moved.union(fresh)
