"""Walks along single links by doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def walks(starts: DataFrame, links: DataFrame) -> DataFrame:
    """origin, id, step: what each start (a column id) meets on its way along links (id, next; one for
    an id), itself at 0. A walk ends where no link leads on, or where it has been before.

    A round knows each walk's first steps and, of every id, where as many steps lead; both grow fourfold,
    so rounds grow with the logarithm of the longest walk. Each round is checkpointed. Of an id that a
    walk meets again the first meeting stays, and a round without a new one is the last.
    """
    reached, jump, size, known = starts.select(F.col("id").alias("origin"), "id", F.lit(0).alias("step")), cut(links.select("id", "next").filter("next IS NOT NULL")), 1, -1
    twice = lambda j: j.join(j.select(F.col("id").alias("next"), F.col("next").alias("to")), "next").select("id", F.col("to").alias("next"))
    while True:
        met = [reached]
        for _ in range(3):
            met.append(met[-1].join(jump, "id").select("origin", F.col("next").alias("id"), (F.col("step") + size).alias("step")))
        reached = cut(reduce(DataFrame.unionByName, met).groupBy("origin", "id").agg(F.min("step").alias("step")))
        jump, size = cut(twice(twice(jump))), size * 4
        if jump.isEmpty() or (count := reached.count()) == known:
            return reached
        known = count
