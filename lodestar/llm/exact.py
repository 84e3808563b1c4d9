"""Exact deduplication with a persistent digest index (operator 10).  DataFrame functions only."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, forget, id_and_text, keep_rows, shared_dir, spread, written

ROWS_A_BUCKET = 2_000_000


class DigestIndex:
    """The digests of every text seen so far, as a Parquet table of batches, each bucketed and sorted by
    digest.

    A batch of new digests is one partition of the table, under a hash of the batch's name, which may be any
    text.  ``commit`` replaces that partition, and ``seen`` leaves it out, so a batch that is tried again,
    whether its first try died before the commit or after it, is decided as if for the first time.  The
    name tells the tries of one delivery from another one: a new name for the same rows is a second
    delivery, of which nothing is new.  ``compact`` merges batches, since every one adds a file to each bucket.  The table lies at ``location``; any later session opens
    it again with the same location and bucket count.  Use it as a context, or ``close`` it."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.location = location or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.table = f"digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'")
        path, fs = self._path(self.location)
        fs.mkdirs(path)
        spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    @staticmethod
    def key(batch: str) -> str:
        """What stands for a batch's name in the table and in its paths."""
        return hashlib.sha256(batch.encode()).hexdigest()[:32]

    def batches(self) -> list[str]:
        """The keys of the batches."""
        return [r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]

    def seen(self, *batches: str) -> DataFrame:
        """digest, keep_id of all batches but these."""
        return self.rows().filter(~F.col("batch").isin(*map(self.key, batches)) if batches else F.lit(True)).select("digest", "keep_id")

    def new(self, groups: DataFrame, *batches: str) -> DataFrame:
        """Of ``groups`` (digest, ...) those whose digest batches other than these lack, by a sort-merge
        anti-join; the index is read bucket by bucket, without a shuffle."""
        return groups.join(self.seen(*batches).select("digest").hint("merge"), "digest", "left_anti")

    def commit(self, fresh: DataFrame, batch: str) -> None:
        """Makes (digest, keep_id) the batch's rows, in place of any it had."""
        view = f"fresh_{uuid.uuid4().hex}"
        fresh.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{self.key(batch)}') SELECT digest, keep_id FROM {view}")
        self.spark.catalog.dropTempView(view)
        self.spark.catalog.refreshTable(self.table)

    def compact(self, open_batches: tuple[str, ...] = ()) -> None:
        """Merges all batches into one but ``open_batches``, those that may still be tried again.  If it
        dies half-way a digest is held twice, which changes no answer, and the next call mends it."""
        kept = set(map(self.key, open_batches))
        old = [b for b in self.batches() if b not in kept]
        if len(old) < 2:
            return
        merged = written(self.rows().filter(F.col("batch").isin(old)).groupBy("digest").agg(F.max("keep_id").alias("keep_id")), "digests-merged")
        self.commit(merged, f"merged-{uuid.uuid4().hex}")
        for b in old:
            self.spark.sql(f"ALTER TABLE {self.table} DROP PARTITION (batch = '{b}')")
            self._delete(f"{self.location}/batch={b}")
        self.spark.catalog.refreshTable(self.table)
        forget(merged)

    def _path(self, location: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(location)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, location: str) -> None:
        path, fs = self._path(location)
        fs.delete(path, True)

    def close(self, delete: bool = False) -> None:
        """Forgets the table's name; ``delete`` removes the files too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if delete:
            self._delete(self.location)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digest = F.sha2(ascii_lower(F.col("text")), 256)
    return written(spread(id_and_text(docs, id_col, text_col)).select("doc_id", F.xxhash64("text").alias("th"), digest.alias("digest")), "digests")


def _entries(digests: DataFrame, index: DigestIndex, batch: str, later: tuple[str, ...] = ()) -> DataFrame:
    """digest, keep_id, group_size, is_new of each text of the batch, a written table; the new ones are
    committed to the index.  ``later``: batches of the same delivery whose turn has not come; what an earlier
    try has left of them counts for nothing."""
    groups = written(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    fresh = written(index.new(groups, batch, *later).select("digest", "keep_id"), "fresh")
    known = groups.select("digest").join(index.seen(batch, *later).withColumnRenamed("keep_id", "seen_id").hint("merge"), "digest").groupBy("digest").agg(F.max("seen_id").alias("seen_id"))
    known = known.withColumn("known", F.lit(True))
    entries = groups.join(known, "digest", "left").select("digest", F.when(F.col("known"), F.col("seen_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", F.col("known").isNull().alias("is_new"))
    entries = written(entries, "entries")
    index.commit(fresh, batch)
    forget(groups, fresh)
    return entries


def _decided(digests: DataFrame, entries: DataFrame, group_size: Column) -> DataFrame:
    """One row for each row of ``digests``; of rows alike in id and digest the first copy can be kept."""
    each = digests.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    kept = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
    return each.join(entries, "digest").withColumn("copy", copies).select("doc_id", "keep_id", group_size.alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decides for every row whether it stays, and commits the new texts to ``index`` as ``batch``, the
    delivery's name: tried again under it, the same rows stay; under another one, none does.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row for each input row.  Texts
    are equal if their SHA-256 after lower-casing A-Z is; a null text counts as empty.  Of equal
    texts of one call the row with the largest doc_id stays (a null id ranks below all others; of
    rows repeated with one id a single one stays), and none if another batch of the index has the text:
    then keep_id is the id in the index.  group_size counts the rows of this call.  An empty table gives
    no rows.  Very many copies of a text are counted before the shuffle, and the join that tells
    them their group is one that Spark splits.  The result reads written tables alone, so the index may
    be closed before it is used."""
    digests = _digests(docs, id_col, text_col)
    return _decided(digests, _entries(digests, index, batch), F.col("group_size"))


def exact_dedup_batches(docs: DataFrame, index: DigestIndex, batch: str, parts: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`exact_dedup`, but the rows go through the index in ``parts`` batches, those with the
    largest ids first: so every batch but the first meets an index that is filled, and of equal texts
    the row with the largest id still stays.  group_size counts the rows of all batches.  Rows without
    an id come last.  Where the ids are parted may differ from try to try, so a part takes no notice of what an
    earlier try has left of it and of the parts after it."""
    names = [f"{batch}/{i}" for i in range(parts)]
    digests = _digests(docs, id_col, text_col)
    edges = sorted(set(digests.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.01)), reverse=True)
    low, left, done = F.lit(False), F.lit(True), []
    for edge in [*edges, None]:
        own = F.lit(True) if edge is None else F.coalesce(F.col("doc_id") >= F.lit(int(edge)), low)
        i = len(done)
        done.append(_entries(digests.filter(left & own), index, names[i], tuple(names[i + 1 :])).withColumn("part", F.lit(i)))
        left = left & ~own
    every = reduce(DataFrame.unionByName, done)
    # the first batch with a text has decided who stays
    merged = every.groupBy("digest").agg(F.min_by("keep_id", "part").alias("keep_id"), F.max("is_new").alias("is_new"), F.sum("group_size").alias("group_size"))
    return _decided(digests, merged, F.col("group_size"))


def drop_exact(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever these are
    called.  Of rows alike in id, and in text but for the case of A-Z, one stays, that of the least
    text hash."""
    digests = _digests(docs, id_col, text_col)
    entries = _entries(digests, index, batch)
    rows = digests.groupBy("doc_id", "digest", "th").agg(F.count("*").alias("n")).join(entries, "digest")
    stays = F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = written(rows.select("doc_id", "digest", "th", "n", stays.alias("stays")), "exact-rows")
    first = rows.filter("stays").groupBy("digest").agg(F.min("th").alias("first"))
    verdict = rows.join(first, "digest", "left").select("doc_id", "th", "n", (F.col("stays") & (F.col("th") == F.col("first"))).alias("keep"))
    verdict = written(verdict.withColumn("keep", F.coalesce("keep", F.lit(False))), "exact-verdict")
    forget(digests, entries, rows)
    return keep_rows(docs, verdict, id_col, text_col, once=True)


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents through a fresh index, in three batches; nulls, repeated rows and empty
    tables as in :func:`exact_dedup`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, buckets=max(8, docs.count() // ROWS_A_BUCKET))
    try:
        return exact_dedup_batches(docs, index, "documents")
    finally:
        index.close(delete=True)
