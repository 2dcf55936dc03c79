"""Connected components by alternating stars: each round hangs every node's neighbours on the
smallest node near it, first the larger neighbours, then the smaller ones. Rounds grow with the
logarithm of the longest path. Every round's edges go to the shared folder, in as many partitions as their number asks
for; within a single one, a round needs no exchange."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table

#: Edges of a partition at least, where a round's edges are fewer than the session's partitions ask for.
EDGES = 100_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit("v"), "u", "v"))).first())


def components(edges: DataFrame, name: str = "star") -> DataFrame:
    """edges: a, b (64-bit ids). Returns id, component_id for every id that has an edge;
    component_id is the smallest id reachable. No edge gives no rows, nor does one with a null end."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()  # greatest() and least() pass over nulls, so an edge to null is one to itself
    now = table(now, name)
    mark = _mark(now)
    while mark[0]:
        kept = now.coalesce(max(1, ceil(mark[0] / EDGES)))
        both = kept.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        new = table(small.where("u <> v").distinct(), name)
        last, mark = mark, _mark(new)
        drop(now)
        now = new
        if mark == last:
            break
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots.select("u", "u"))
