"""Bounded breadth-first search over typed edges, and supersession chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chains import walks
from tessera.session import cut


def steps(edges: DataFrame, direction: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """a, side, b: where an edge leads, out (side 0), in (1) or both ways."""
    edges = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    out, into = edges.select(F.col("from_id").alias("a"), F.lit(0).alias("side"), F.col("to_id").alias("b")), edges.select(F.col("to_id").alias("a"), F.lit(1).alias("side"), F.col("from_id").alias("b"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def related(starts: DataFrame, edges: DataFrame, artifacts: DataFrame, direction: str = "out", kinds: tuple[str, ...] = (), depth: int = 1) -> DataFrame:
    """start, id, distance, place: artifacts reached from each start (a column start) in up to depth
    steps, in the order in which a search meets them. Of an artifact's neighbours those that it points
    at come first, then those that point at it, each by id. Each level carries its least way to an
    artifact, whose order is that order, so no level is sorted. The walk passes through superseded
    artifacts but leaves them out, as it does the start."""
    links = steps(edges, direction, kinds)
    frontier = starts.select("start", F.col("start").alias("id")).distinct().withColumn("way", F.array().cast("array<struct<side:int,b:string>>"))
    seen = frontier.withColumn("distance", F.lit(0))
    for distance in range(1, max(depth, 1) + 1):
        way = F.concat("way", F.array(F.struct("side", "b")))
        new = frontier.join(links, F.col("id") == F.col("a")).select("start", F.col("b").alias("id"), way.alias("way")).groupBy("start", "id").agg(F.min("way").alias("way"))
        frontier = cut(new.join(seen.select("start", "id"), ["start", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.withColumn("distance", F.lit(distance)))
    live = artifacts.filter("superseded_by IS NULL").select("id")
    place = F.row_number().over(Window.partitionBy("start").orderBy("distance", "way"))
    return seen.filter("distance > 0").join(live, "id").select("start", "id", "distance", place.alias("place"))


def history(artifacts: DataFrame) -> DataFrame:
    """origin, id, step, current: each supersession chain from its oldest member on. Of two that one
    artifact superseded, both chains lead to it; a cycle ends where it began."""
    links = artifacts.filter("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("next"))
    origins = links.select("id").join(links.select(F.col("next").alias("id")), "id", "left_anti")
    found = walks(origins, links)
    return found.join(artifacts.select("id", F.col("superseded_by").isNull().alias("current")), "id").select("origin", "id", "step", "current")
