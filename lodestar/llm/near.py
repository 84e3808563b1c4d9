"""Exact links between texts that share lists of candidates: used by operators 7 (the pipeline's stage) and 11.

A list's members never meet all with all where that can be helped.  First each meets the list's centre,
which makes stars; then only members that this has left in different components meet, and none of
a list's largest component meets another of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Roller, give_back, hashed, written

CROWD = 32  # members of a list that may meet pair by pair


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of ``words`` words of all texts, one text behind the other, and their number
    in each.  Fewer words than a shingle: all of them; no words: none."""
    split = [(t or "").encode().lower().split() for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    roll = Roller(hashed([w for ws in split for w in ws])[0])
    size = np.minimum(words, count)
    n = np.where(count > 0, count - size + 1, 0)
    starts = np.repeat(np.cumsum(count) - count - (np.cumsum(n) - n), n) + np.arange(n.sum())
    size, out = np.repeat(size, n), np.empty(n.sum(), np.uint64)
    for k in np.unique(size).tolist():
        out[size == k] = roll.at(starts[size == k], k)
    return out, n


def _alike(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(5 * both >= 4 * (len(x) + len(y) - both))  # Jaccard similarity of 0.8 or more
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    give_back()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose whole sets (node, s: sorted hashes as bytes) are alike."""
    x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")


#: Sets of sizes x and y can be alike: the smaller one has four fifths of the larger at least.
_SIZES = "5 * least({0}, {1}) >= 4 * greatest({0}, {1})"


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each member of a list (k, node, score, size) with the one of the highest score, unless
    their sizes are too far apart."""
    centre = members.groupBy("k").agg(F.max(F.struct("score", "node", "size")).alias("c"), F.count("*").alias("n")).filter("n > 1").select("k", F.col("c.node").alias("centre"), F.col("c.size").alias("other"))
    met = members.join(centre, "k").filter(f"node <> centre AND {_SIZES.format('size', 'other')}")
    return met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _apart(rows: DataFrame, key: str) -> DataFrame:
    """key, members, main: of the keys whose rows (key, root) are of different components how many rows there
    are, and the component that most of them have."""
    each = rows.groupBy(key, "root").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.sum("n").alias("members"), F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")


def open_lists(members: DataFrame, roots: DataFrame) -> DataFrame:
    """k, node, size, root, main, crowd: members of the lists that hold different components (roots: stars u, m),
    the list's largest component, and whether the list is too long for all its pairs."""
    rooted = written(members.join(roots, members.node == roots.u, "left").select("k", "node", "size", F.coalesce("m", "node").alias("root")), "near-rooted")
    return rooted.join(_apart(rooted, "k"), "k").select("k", "node", "size", "root", "main", (F.col("members") > CROWD).alias("crowd"))


def _cross(rows: DataFrame, key: str, room: str = "true") -> DataFrame:
    """Pairs (a, b) of rows (key, node, root, main, ...) of one key and different components: those outside
    the key's largest component meet all, so its own rows never meet each other."""
    part = lambda df, n: df.select(key, (F.col("root") != F.col("main")).alias(f"{n}_minor"), *(F.col(c).alias(f"{n}_{c}") for c in rows.columns if c not in (key, "main")))
    x, y = part(rows.filter("root != main"), "x"), part(rows, "y")
    met = x.join(y, key).filter(f"x_root <> y_root AND (NOT y_minor OR x_node < y_node) AND {room}")
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def open_pairs(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, and of sizes near enough, in lists that are no crowd."""
    return _cross(open_.filter("NOT crowd").select("k", "node", "size", "root", "main"), "k", _SIZES.format("x_size", "y_size"))


def _exploded(batches):
    for b in batches:
        size = pa.compute.binary_length(b.column(2)).to_numpy() // 8
        h = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
        columns = [np.repeat(x, size) for x in (b.column(0).to_numpy(), b.column(1).to_numpy(), size.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(h)], ["node", "root", "n", "h"])
    give_back()


def crowd_pairs(sets: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs (a, b) among the nodes of crowds (node, root) that may be alike: those of different components
    that share a shingle of their heads which leaves room for a similarity of 0.8.

    A head is the rarest fifth of a set's n shingles and one more, rare ones first, by counts among
    these nodes, ties by hash.  The first shingle, in this order, that two alike sets share lies in the
    heads of both, and at least four fifths of either set come no earlier; so none is missed."""
    spark = sets.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    dealt = sets.join(crowd, "node").select("node", "root", "s").repartition(tasks)  # sets lie where their texts did
    each = written(dealt.mapInArrow(_exploded, "node long, root long, n long, h long"), "near-shingles")
    rare = each.groupBy("h").agg(F.count("*").alias("often")).filter("often > 1")
    # shingles of one text alone come first in any order, and lead nowhere
    alone = each.groupBy("node").agg(F.count("*").alias("all"))
    shared = each.join(rare, "h")
    mine = written(shared.select("node", "root", "n", "h", "often"), "near-shared")
    behind = mine.groupBy("node").agg(F.count("*").alias("shared"))
    ahead = alone.join(behind, "node").select("node", (F.col("all") - F.col("shared")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "h")) - 1
    heads = written(mine.withColumn("i", place).join(ahead, "node").withColumn("i", F.col("i") + F.col("ahead")).filter("5 * i <= n").select("h", "node", "root", "n", "i"), "near-heads")
    open_ = heads.join(_apart(heads, "h").drop("members"), "h")
    return _cross(open_, "h", "9 * least(x_n - x_i, y_n - y_i) >= 4 * (x_n + y_n)")
