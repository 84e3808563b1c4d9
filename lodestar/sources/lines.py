"""Lines of text files with their numbers, and the strict rules of JSON Lines, for files of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import envelope


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """file, size, split (where the part of the file begins that a line was read in), at (a number that rises by
    one from line to line of a split), value.  Lines end in line feeds alone."""
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    lines = lines.select("value", meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("split"))
    return lines.withColumn("at", F.monotonically_increasing_id())


def _splits(lines: DataFrame) -> DataFrame:
    """file, size, split, first (its lowest ``at``), ahead (lines of the file before it), n, octets with one more for
    each line: a row for each split."""
    each = lines.groupBy("file", "size", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("octets"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value: the lines of all files at ``path``.

    A large file is read in splits, by as many tasks.  A split's lines are numbered as they come; the lines
    of those before it are counted in a pass of their own and summed up, so nothing but one row a split is
    moved.  A line that ends in a line feed, the last one too, is followed by no further one; an empty file has
    no lines."""
    lines = _scanned(spark, path)
    splits = _splits(lines).select("file", "split", "first", "ahead")
    placed = lines.join(splits, ["file", "split"])
    return placed.select("file", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def line_problem(value: Column) -> Column:
    """What is wrong with a line of JSON Lines, null if nothing is."""
    parsed = envelope.json_strict(value)["ok"]
    return F.when(value == "", "blank line").when(~parsed, "no JSON").when(~F.ltrim(value).startswith("{"), "no object")


def strict_violations(spark: SparkSession, path: str) -> DataFrame:
    """file, line, problem of all files at ``path``: each line is a JSON object, none is blank, and the last one ends
    in a line feed.  Whether it does follows from the size of the file and those of its lines.  A file with
    nothing in it has no lines that could be wrong."""
    lines = numbered_lines(spark, path).withColumn("problem", line_problem(F.col("value")))
    per_line = lines.filter("problem IS NOT NULL").select("file", "line", "problem")
    return per_line.unionByName(open_ends(spark, path))


def open_ends(spark: SparkSession, path: str) -> DataFrame:
    """file, line, problem of the files whose last line has no line feed."""
    files = _splits(_scanned(spark, path)).groupBy("file", "size").agg(F.sum("n").alias("line"), F.sum("octets").alias("octets"))
    return files.filter("octets > size").select("file", "line", F.lit("no line feed at the end").alias("problem"))


def object_count(spark: SparkSession, path: str) -> DataFrame:
    """file, n_objects: lines that are JSON objects."""
    lines = numbered_lines(spark, path).filter(line_problem(F.col("value")).isNull())
    return lines.groupBy("file").agg(F.count("*").alias("n_objects"))
