"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _least(edges: DataFrame) -> DataFrame:
    """u, m: the smallest neighbour of u."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Stars of the components of the undirected graph ``edges(a, b)``: one row (u, m) for each
    vertex u that is not the smallest of its component, m being the smallest.

    Large-star and small-star steps in turn: each hangs neighbours onto the smallest vertex seen,
    and the number of rounds grows with the logarithm of the longest path.  Vertices and edges
    stay in tables; minima are combined before the shuffle, and the join that hands a minimum back
    can be split where a vertex has very many neighbours.  Loops and repeated edges are harmless;
    an edge with a null end is ignored; no edges give no rows."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: larger neighbours of u move to the least of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(_least(both), "least")
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = written(moved, "large")
        # small star: smaller neighbours of u, and u, move to the least of them
        least2 = written(_least(large), "least")
        joined = large.join(least2, "u").select("u", "v", "m")
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u > v").distinct()
        after = written(small, "edges")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        forget(e, least, large, least2)
        e = after
        if mark == before:
            return e.select("u", F.col("v").alias("m"))
        before = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
