"""Mixing sources to target weights by systematic sampling (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, forget, small_enough, spare, spread, text_hash, written

CAP = 3.0


def _weights(sources: DataFrame, cap: float) -> DataFrame:
    """Adds weight and target to ``sources`` (source, source_size): one row for each source.

    Weights are 1, 2, 3, repeating by code point order, null last.  A source's level is its cap
    over its weight; filling all sources evenly by weight, those with the lowest levels stop
    first, so the stopped ones are a prefix by level, and the share left for the others follows
    from running sums."""
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("fill", F.col("left") / F.col("open"))
    # the fill level is that of the first source that doesn't stop
    level = F.min(F.when(F.col("level") >= F.col("fill"), F.struct("level", "rank", "fill"))).over(every)["fill"]
    s = s.withColumn("final", level)
    return s.select("source", "source_size", "weight", F.coalesce(F.least("cap", F.col("weight") * F.col("final")), F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 17, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, th (hash of the text): one row for each
    row of docs.

    size: words of the text (null: 0).  A document's expected copies are its source's target over
    its source's size.  Over the running sums of expected copies within a source, shifted by one random
    offset, a document is emitted once for each integer it crosses; so its copies are right on average
    over the offsets, and it is taken ``cap`` times (rounded up) at most.  The documents of a source
    stand by size, half of them (by a hash) rising and the rest falling: whether an offset favours the
    end or the beginning of what it steps over, it takes as much more of the one half as it takes less
    of the other.

    The running sum is distributed: rows are dealt by range of (source, place), so a source with
    a third of all rows spreads over many tasks; each task's counts by source are summed up before
    it.  Reruns agree: offsets follow from ``seed`` and the source's name.  A null source is a
    source of its own, last in order; rows with a null id stand first among their size; rows that are
    alike stand side by side; sources without words have target 0; an empty table gives no rows."""
    spark = docs.sparkSession
    n_words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")
    sized = spread(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words.alias("size"), text_hash(text_col).alias("th"))
    falling = F.xxhash64("doc_id", "th", F.lit(seed)) % 2 == 0
    sized = written(sized.withColumn("place", F.when(falling, F.lit(1 << 40) - F.col("size")).otherwise(F.col("size"))), "mix-sizes")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["place", F.col("doc_id").asc_nulls_first(), "th"]
    ranged = written(sized.repartitionByRange(n, F.col("source").asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()), "mix-ranged")
    parts = written(ranged.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-parts")
    sources = _weights(parts.groupBy("source").agg(F.sum("words").alias("source_size")), cap)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    table = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n", "words").alias("p")
    table = table.join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.source", "part", "ahead", "source_size", "target")
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\u0000"))), 44) / F.lit(float(1 << 20))
    table = written(table.withColumn("offset", offset), "mix-table")
    forget(sized, parts)
    within = Window.partitionBy("part", "source").orderBy(*order)
    r = ranged.withColumn("nth", F.row_number().over(within)).alias("r")
    t = (F.broadcast(table) if small_enough(table, 200_000) else table).alias("t")
    r = r.join(t, (F.col("r.part") == F.col("t.part")) & F.col("r.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("ahead") + F.col("nth")
    copies = F.floor(place * rate + F.col("offset")) - F.floor((place - 1) * rate + F.col("offset"))
    return r.select("doc_id", "r.source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "th")


def mix_rows(docs: DataFrame, broadcast_rows: int = 1_000_000, copies: str = "copies", **how) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns and how often, as a column that
    ``copies`` names.  Rows repeated with the same id and text come once, with their copies added up."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    if copies.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {copies}; give another name")
    a, b, n = spare(docs, "row_id", "row_text", "row_count")
    picks = mix_sources(docs, **how).groupBy(F.col("doc_id").alias(a), F.col("th").alias(b)).agg(F.sum("copies").alias(copies), F.count("*").alias(n))
    picks = written(picks.filter(F.col(copies) > 0), "mix-picks")
    keyed = docs.withColumns({a: F.col(f"`{id_col}`").cast("long"), b: text_hash(text_col)})
    hint = F.broadcast if small_enough(picks, broadcast_rows) else lambda df: df
    same = lambda p: keyed[a].eqNullSafe(p[a]) & (keyed[b] == p[b])
    out = lambda p: keyed.join(hint(p), same(p)).select(keyed["*"], p[copies])
    taken = out(picks.filter(F.col(n) == 1))
    if not picks.filter(F.col(n) > 1).isEmpty():
        taken = taken.unionByName(out(picks.filter(F.col(n) > 1)).dropDuplicates([a, b]))
    return taken.drop(a, b)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, repeated rows and empty tables as in :func:`mix_sources`."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
