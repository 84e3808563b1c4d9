"""Removal of word windows that repeat across documents, by level-wise doubling (operator 2)."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Roller, alike_once, chunks, forget, hashed, keyed_text, only, window_minima, without, written

WINDOW = 50
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _whole(batches):
    """Count and digest of each text's words."""
    for b in (c for b in batches for c in chunks(b, 3)):
        split = [words_of(t) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(w) for w in split], pa.int64()), pa.array([_sha(w) for w in split])], ["id", "th", "doc_id", "n_words", "digest"])


class Texts:
    """The words of a block of documents in one row, and the windows of two lengths that lie within
    a document.  Each long window has an anchor: the short window in it with the least hash, the
    rightmost on ties.  Equal long windows have equal anchors at equal places."""

    def __init__(self, texts: list[str | None], window: int):
        split = [words_of(t) for t in texts]
        self.length = np.fromiter(map(len, split), np.int64, len(split))
        h, _ = hashed([w for ws in split for w in ws])
        self.n, self.window, self.half = len(h), window, window // 2
        self.doc = np.repeat(np.arange(len(split)), self.length)
        self.first = np.cumsum(self.length) - self.length
        room = (self.first + self.length)[self.doc] - np.arange(self.n)
        self.values, self.one = h, Roller(h)
        short = self.one.windows(self.half)
        self.short = np.where(room[: len(short)] >= self.half, short, LAST)
        self.starts = np.flatnonzero(room >= window)  # of long windows
        minima = window_minima(self.short, window - self.half + 1)
        self.anchor = minima[self.starts] if len(self.starts) else np.zeros(0, np.int64)


def _anchors(window: int):
    def run(batches):
        for b in batches:
            for c in chunks(b, 2):
                t = Texts(c.column(2).to_pylist(), window)
                at = np.unique(t.anchor)
                doc = t.doc[at]
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(doc)), c.column(1).take(pa.array(doc)), pa.array(t.short[at].view(np.int64))], ["id", "th", "h"])

    return run


def _extend(window: int):
    """Long windows around the short ones that repeat."""

    def run(batches):
        for b in batches:
            for c in chunks(b, 2):
                t = Texts(c.column(2).to_pylist(), window)
                if not len(t.starts):
                    continue
                live = np.zeros(t.n, bool)
                at = np.unique(t.anchor)
                for d, known in enumerate(c.column(3).to_pylist()):
                    mine = at[(at >= t.first[d]) & (at < t.first[d] + t.length[d])] if t.length[d] else at[:0]
                    live[mine[np.isin(t.short[mine], np.array(known, np.int64).view(np.uint64))]] = True
                s = t.starts[live[t.anchor]]
                doc = t.doc[s]
                h = t.one.at(s, window)
                check = (Roller(t.values, 1).at(s, window) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([c.column(0).take(take), c.column(1).take(take), pa.array(h.view(np.int64)), pa.array(check), pa.array((s - t.first[doc]).astype(np.int32))], ["id", "th", "h", "check", "at"])

    return run


def _double(length: int):
    """Windows of twice the ``length`` both of whose halves repeat (known: where windows of ``length`` that
    repeat start)."""

    def run(batches):
        for b in batches:
            for c in chunks(b, 2):
                for i, (text, known) in enumerate(zip(c.column(2).to_pylist(), c.column(3).to_pylist())):
                    known = np.array(known, np.int64)
                    at = np.intersect1d(known, known - length, assume_unique=True)
                    if len(at):
                        h, _ = hashed(words_of(text))
                        one, two = Roller(h).at(at, 2 * length), Roller(h, 1).at(at, 2 * length)
                        take = pa.array(np.full(len(at), i))
                        yield pa.RecordBatch.from_arrays([c.column(0).take(take), c.column(1).take(take), pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(at.astype(np.int32))], ["id", "th", "h", "check", "at"])

    return run


def _remove(window: int):
    def run(batches):
        for b in (c for b in batches for c in chunks(b, 3)):
            out = []
            for text, starts in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                words = words_of(text)
                cover = np.zeros(len(words) + 1, np.int64)
                s = np.unique(np.array(starts, np.int64))
                cover[s] += 1
                np.subtract.at(cover, s + window, 1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((int(gone.sum()), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.int64()), pa.array([x.decode() for _, x in out])], ["id", "th", "n_removed", "kept"])

    return run


def _repeating(windows: DataFrame) -> DataFrame:
    """h, check, lo of the windows that occur in two documents or more; lo is the least id.  Combined
    before the shuffle: a frequent window costs one row for each task."""
    both = windows.groupBy("h", "check").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return written(both.filter("lo < hi").select("h", "check", "lo"), "sub-least")


_WINDOWS = "id long, th long, h long, check int, at int"


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Two written tables from keyed documents.  id, th, starts: where windows of ``window`` words start
    that also start in a document of smaller id.  id, th, longest: the longest of the lengths window,
    2 window, 4 window, ... of which a window also starts in a document with another id.

    Level one: short windows of half the length, those that are an anchor of a long one; the ones
    that occur in one document alone are dropped.  Level two: the long windows that hold a short
    one that is left.  Each further level: windows of twice the length whose halves are left, until none
    repeats."""
    src = docs.select("id", "th", "text")
    anchors = written(src.mapInArrow(_anchors(window), "id long, th long, h long"), "sub-anchors")
    again = written(anchors.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h"), "sub-again")
    live = written(anchors.join(again, "h").groupBy("id", "th").agg(F.collect_set("h").alias("known")), "sub-live")
    forget(anchors, again)
    extend = lambda live, how: written(only(src, live).join(live, ["id", "th"]).select("id", "th", "text", "known").mapInArrow(how, _WINDOWS), "sub-windows")
    windows = extend(live, _extend(window))
    starts, longest, length = None, [], window
    while True:
        least = _repeating(windows)
        hits = written(windows.join(least, ["h", "check"]).select("id", "th", "at", (F.col("lo") < F.col("id")).alias("later")), "sub-hits")
        forget(windows, least, live)
        live = written(hits.groupBy("id", "th").agg(F.collect_set("at").alias("known")), "sub-live")
        if starts is None:
            starts = written(hits.filter("later").groupBy("id", "th").agg(F.collect_set("at").alias("starts")), "sub-starts")
        forget(hits)
        if live.isEmpty():
            break
        longest.append(written(live.select("id", "th", F.lit(length).cast("long").alias("longest")), "sub-longest"))
        windows = extend(live, _double(length))
        length *= 2
    none = starts.limit(0).select("id", "th", F.lit(0).cast("long").alias("longest"))
    best = written(reduce(DataFrame.unionByName, longest, none).groupBy("id", "th").agg(F.max("longest").alias("longest")), "sub-longest")
    forget(live, *longest)
    return starts, best


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, longest, kept (the words left, joined by a space; null where nothing
    was removed), kept_sha256: one row for each row of ``docs``.

    A word goes if a window of ``window`` words of its document that covers it also starts in a
    document with a smaller id.  longest: the longest of the lengths window, 2 window, 4 window, ... of
    which a window also starts in a document with another id, 0 if there is none.  A null or empty text
    has no words and loses none.  A null id is
    smaller than any other.  Rows that share an id count as one document: they don't take words from
    each other; rows that are alike are compared once and returned as often as they come.  Of documents
    with equal words all but those of the smallest id lose everything, without being compared further,
    if they have ``window`` words at least.  An empty table gives no rows."""
    src = keyed_text(docs, id_col, text_col)
    whole = written(src.mapInArrow(_whole, "id long, th long, doc_id long, n_words long, digest string"), "sub-whole")
    groups = written(whole.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("digest", "lo"), "sub-groups")
    members = whole.join(groups, "digest").select("id", "th", "n_words", (F.col("id") > F.col("lo")).alias("copy")).distinct()
    members = written(members.withColumn("whole", F.lit(window) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_words") / window))).cast("long")).drop("n_words"), "sub-copies")
    copies = written(members.filter("copy").select("id", "th"), "sub-extra")
    starts, longest = repeated_windows(without(alike_once(src, whole), copies, ["id", "th"]), window)
    cut = only(src, starts).join(starts, ["id", "th"]).select("id", "th", "doc_id", "text", "starts").mapInArrow(_remove(window), "id long, th long, n_removed long, kept string")
    cut = written(cut, "sub-cut").dropDuplicates(["id", "th"])
    out = whole.join(cut, ["id", "th"], "left").join(members, ["id", "th"], "left").join(longest, ["id", "th"], "left")
    forget(groups, copies, starts)
    kept = F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept"))
    return out.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.greatest(F.coalesce("whole", F.lit(0)), F.coalesce("longest", F.lit(0))).alias("longest"),
        kept.alias("kept"), F.when(kept.isNull(), F.col("digest")).otherwise(F.sha2(kept, 256)).alias("kept_sha256"),
    )


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, repeated rows and empty tables as in :func:`remove_repeats`."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
