"""Shared pieces of the training-data operators: shared storage, tokenising, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word separators of every contract here: space and the controls 09-0D.  ``bytes.split()``
#: without arguments splits at exactly these, and ``bytes.lower()`` lower-cases A-Z alone.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ids of null rank below every other id.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  Where the session names
    none a local one is made, but only if driver and executors are one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        handle = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = handle.get() if handle.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of the tables made by :func:`written` that still exist.
_TABLES: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.  Cuts the lineage: what follows
    survives lost executors without recomputing what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _TABLES:
            _TABLES.remove(p)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, [df.table_path] if "table_path" in vars(df) else [])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that no DataFrame refers to any more: its cleaner acts when
    the driver's JVM collects garbage, which a driver with little to do puts off."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def tidy(spark: SparkSession):
    """Deletes, at its end, the tables that operators have written within it and not yet deleted.  An
    operator's result reads such tables: write it to a place of its own before the block ends, or call
    ``keep`` (what the block is given) with a table that shall stay."""
    before, kept = set(_TABLES), set()
    try:
        yield lambda df: kept.add(df.table_path)
    finally:
        _delete(spark, [p for p in _TABLES if p not in before and p not in kept])


def shards(spark: SparkSession, factor: int = 4, least: int = 64) -> int:
    """How many shards to deal data into: it follows the session's shuffle parallelism, which is
    what a cluster's owner sizes by the data."""
    return max(least, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out first if it is read from fewer files than the cluster has cores, and is
    small; tables of many files are left as they are.  Looks at the plan alone and runs nothing."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * (64 << 20) and len(docs.inputFiles()) < cores else docs


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads; extra columns, whatever their names, play no part."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def dealt_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same, for operators that work on texts in Python and so gain from every core."""
    return spread(id_and_text(docs, id_col, text_col))


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` (a written table) has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def without(docs: DataFrame, dropped: DataFrame, keys: list[str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` minus the rows whose keys are in ``dropped`` (a written table of keys).  Up to
    ``broadcast_rows`` keys are broadcast and the texts stay where they are; more are joined by a
    shuffle, which Spark splits where a key is hot."""
    on = None
    for k in keys:
        c = docs[k].eqNullSafe(dropped[k])
        on = c if on is None else on & c
    return docs.join(F.broadcast(dropped) if small_enough(dropped, broadcast_rows) else dropped, on, "left_anti")


def crc32_sql(text: str) -> str:
    """The CRC-32 of an SQL expression of ASCII text that isn't empty, in DuckDB's SQL, which has no such function."""
    step = "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), {byte}), 4294967295)"


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 on of each among those of its group by ``order`` (nulls
    first), and ``size``, how many these are; a written table.

    Rows are dealt by range of group and order, rows that are alike by their number, so that a group of any
    size spreads over many tasks; what lies ahead of a task's rows is summed up from its counts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "row_nr")]
    numbered = written(rows.withColumn("row_nr", F.monotonically_increasing_id()), "numbered")
    ranged = written(numbered.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), "ranged")
    parts = written(ranged.groupBy(group, "part").agg(F.count("*").alias("n")), "parts")
    whole = Window.partitionBy(group)
    ahead = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = parts.select(F.col(group).alias("p_group"), F.col("part").alias("p_part"), ahead.alias("ahead"), F.sum("n").over(whole).alias("size"))
    nth = F.row_number().over(Window.partitionBy("part", group).orderBy(*keys[1:])) - 1
    out = ranged.withColumn("nth", nth).join(table, (F.col("part") == F.col("p_part")) & F.col(group).eqNullSafe(F.col("p_group")))
    out = written(out.select(*rows.columns, (F.col("ahead") + F.col("nth")).alias("pos"), "size"), "positions")
    forget(numbered, ranged, parts)
    return out


# ---------------------------------------------------------------- numpy side


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hashed(words: list[bytes], seed: int = 0) -> tuple[np.ndarray, pa.DictionaryArray]:
    """A 64-bit hash of each word (each distinct word is hashed once), and the dictionary."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    of = np.array([digest(w, seed) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    ids = coded.indices.to_numpy(zero_copy_only=False)
    return (of[ids] if len(words) else np.zeros(0, np.uint64)), coded


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64; the longest asked for is kept."""
    if base not in _POWERS or len(_POWERS[base]) <= n:
        _POWERS[base] = _powers(max(n, 1 << 17), base)
    return _POWERS[base][: n + 1]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Inverses of the bases modulo 2**64: odd numbers have one.
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


class Roller:
    """Hashes of all windows of ``k`` consecutive symbols, whose values are 64-bit numbers:
    sum of value * base**i by prefix sums, moved to exponent zero, then finalised."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        self.n = n
        with np.errstate(over="ignore"):
            self.inverse = powers(n, INVERSES[which])
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(n, BASES[which])[:n], dtype=np.uint64)])

    def windows(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: self.n - k + 1])

    def at(self, starts: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + k] - self.sums[starts]) * self.inverse[starts])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` consecutive hashes the position of the one whose upper half is
    least, the rightmost on ties; fewer hashes than ``w`` make one window of them all."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    w = min(w, n)
    low = np.uint64(0xFFFFFFFF)
    best = (h & ~low) | (low - np.arange(n, dtype=np.uint64))  # one number orders hash and place
    span = 1  # best[i]: of h[i : i + span]
    while span < w:
        step = min(span, w - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return (low - (best & low)).astype(np.int64)


def chunks(batch: pa.RecordBatch, text_at: int = 1, limit: int = 2 << 20):
    """Slices of a batch whose texts have about ``limit`` bytes together, one document at least."""
    size = np.diff(np.frombuffer(batch.column(text_at).buffers()[1], np.int32, batch.num_rows + 1 + batch.column(text_at).offset)[batch.column(text_at).offset :]) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        end, total = at, 0
        while end < batch.num_rows and (end == at or total + size[end] <= limit):
            total += size[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end
    give_back()


_MMAP_THRESHOLD = -3  # glibc's number for the option
try:
    _libc = ctypes.CDLL("libc.so.6")
    _trim = _libc.malloc_trim
    _libc.mallopt(_MMAP_THRESHOLD, 1 << 20)  # arrays of a megabyte or more go back to the system when freed
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Returns freed memory to the system: workers are kept between tasks, and an executor's memory
    is shared by all of them."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null ids as NULL_ID), th (a hash of the text), doc_id, text: id and th together name a
    row; rows that share both are alike."""
    d = dealt_texts(docs, id_col, text_col)
    return d.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"), "doc_id", "text")


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` doesn't have, whatever its own columns are called."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, but those that ``verdict`` names: a written table
    doc_id, th (hash of the text), keep.  Rows it doesn't name stay.  A null id is an id like any
    other, so rows without one are told apart by their text.  ``once``: of kept rows that are named by
    one id and text and that ``verdict`` counts (column n) more than once, a single one stays."""
    a, b = spare(docs, "row_id", "row_text")
    keyed = docs.withColumns({a: F.col(f"`{id_col}`").cast("long"), b: text_hash(text_col)})
    names = lambda part: part.select(F.col("doc_id").alias(a), F.col("th").alias(b))
    left = without(keyed, written(names(verdict.filter("NOT keep")).distinct(), "lost-rows"), [a, b])
    if once:
        again = written(names(verdict.filter("keep AND n > 1")), "repeated-rows")
        if not again.isEmpty():
            on = left[a].eqNullSafe(again[a]) & (left[b] == again[b])
            left = left.join(again, on, "left_anti").unionByName(left.join(again, on, "left_semi").dropDuplicates([a, b]))
    return left.drop(a, b)


def alike_once(src: DataFrame, whole: DataFrame) -> DataFrame:
    """Of keyed rows (id, th, text) that are alike a single one; ``whole`` (written) has a row for each.
    Only rows that do repeat are moved."""
    again = written(whole.groupBy("id", "th").agg(F.count("*").alias("n")).filter("n > 1").select("id", "th"), "alike")
    if again.isEmpty():
        return src
    on = ["id", "th"]
    repeated = src.join(F.broadcast(again) if small_enough(again, 1_000_000) else again, on, "left_semi")
    return without(src, again, on).unionByName(repeated.groupBy(*on).agg(*(F.first(c).alias(c) for c in src.columns if c not in on)).select(*src.columns))


def only(docs: DataFrame, keys: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of keyed ``docs`` whose (id, th) is among ``keys``: where the keys are few enough to be
    broadcast, other texts are left out before any shuffle; else they are left to the join."""
    names = keys.select("id", "th").distinct()
    return docs.join(F.broadcast(names), ["id", "th"], "left_semi") if small_enough(names, broadcast_rows) else docs
