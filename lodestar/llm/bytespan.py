"""Removal of byte strings that repeat anywhere, by a column-wise Burrows-Wheeler transform
(operator 5)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import Collection
from .common import Roller, alike_once, chunks, forget, keyed_text, mix, only, small_enough, window_minima, without, written

WINDOW = 200
GRAM = 64  # bytes of an anchor
SHARD_BYTES = 1 << 20  # segments of one task
COLLECTION_BYTES = 64 << 10  # segments of one transform
HOT = 2_000  # different segments of one anchor that still go to one transform
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
RUNS = "array<struct<lo:int,hi:int>>"


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def anchors_of(data: np.ndarray, window: int):
    """at, first, n, hash, roller: the anchors of a text, and for each the first of the windows it
    belongs to and their number.  A window's anchor is the GRAM-byte string in it with the least
    hash, the rightmost on ties; so equal windows have equal anchors at equal places."""
    roller = Roller(_VALUES[data])
    grams = roller.windows(GRAM)
    of = window_minima(grams, window - GRAM + 1)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return of[first], first, np.diff(np.append(first, len(of))), grams[of[first]], roller


def _anchors(window: int):
    def run(batches):
        for b in batches:
            for c in chunks(b, 2):
                doc, hashes, times = [], [], []
                for d, text in enumerate(c.column(2).to_pylist()):
                    data = _bytes(text)
                    if len(data) >= window:
                        h, n = np.unique(anchors_of(data, window)[3], return_counts=True)
                        doc.append(np.full(len(h), d))
                        hashes.append(h)
                        times.append(n)
                if doc:
                    take = pa.array(np.concatenate(doc))
                    yield pa.RecordBatch.from_arrays([c.column(0).take(take), c.column(1).take(take), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(times), pa.int32())], ["id", "th", "h", "n"])

    return run


def _segments(window: int):
    """A segment: an anchor's windows, from the first byte of the first to the last of the last."""

    def run(batches):
        for b in batches:
            for c in chunks(b, 2, 1 << 20):
                cols = [[] for _ in range(7)]
                parts = []
                for d, (text, known) in enumerate(zip(c.column(2).to_pylist(), c.column(3).to_pylist())):
                    data = _bytes(text)
                    at, first, n, h, roller = anchors_of(data, window)
                    live = np.isin(h, np.array(known, np.int64).view(np.uint64))
                    at, first, n, h = at[live], first[live], n[live], h[live]
                    size = n + window - 1
                    with np.errstate(over="ignore"):
                        salt = ((at - first).astype(np.uint64) << np.uint64(20)) ^ size.astype(np.uint64)
                        one = mix(roller.at(first, size) ^ mix(salt))
                    two = (Roller(_VALUES[data], 1).at(first, size) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for col, x in zip(cols, (np.full(len(at), d), h.view(np.int64), one.view(np.int64), two, first.astype(np.int32), n.astype(np.int32), (at - first).astype(np.int32))):
                        col.append(x)
                    raw = data.tobytes()
                    parts += [raw[x : x + y] for x, y in zip(first.tolist(), size.tolist())]
                doc, h, one, two, first, n, off = map(np.concatenate, cols)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([c.column(0).take(take), c.column(1).take(take), *map(pa.array, (h, one, two, first, n, off)), pa.array(parts, pa.binary())], ["id", "th", "h", "seg", "check", "first", "n", "off", "bytes"])

    return run


def _runs(starts: np.ndarray) -> list[dict]:
    """Sorted starts as runs lo <= start < hi."""
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [{"lo": int(x[0]), "hi": int(x[-1]) + 1} for x in np.split(starts, cut)] if len(starts) else []


def repeats_in(segments: list[bytes], window: int) -> list[np.ndarray]:
    """For each segment the starts of its windows that also start elsewhere among the segments.

    A symbol of the transform is ``width`` bytes, so each segment enters once for each of the
    ``width`` ways to cut it; a window is then window / width symbols of one of those."""
    width = next(w for w in (8, 4, 2, 1) if window % w == 0)
    texts, ends, of = [], [], []
    for i, s in enumerate(segments):
        data = np.frombuffer(s, np.uint8)
        for phase in range(width):
            k = (len(data) - phase) // width
            if k * width >= window:
                texts.append(data[phase : phase + width * k].copy().view(f"<u{width}"))
                ends.append(k)
                of.append((i, phase))
    out: list[list[np.ndarray]] = [[] for _ in segments]
    if texts:
        _, symbols = np.unique(np.concatenate(texts), return_inverse=True)
        who, start = Collection(symbols + 1, np.cumsum(ends)).repeated(window // width)
        order = np.argsort(who, kind="stable")
        who, start = who[order], start[order]
        for t, x in zip(*np.unique(who, return_index=True)):
            i, phase = of[t]
            out[i].append(start[x : np.searchsorted(who, t, side="right")] * width + phase)
    return [np.sort(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]


def _transform(window: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("h")
        h, size = t.column("h").to_numpy(), t.column("bytes")
        parts = size.to_pylist()
        out, at = [], 0
        while at < len(parts):
            end, total = at, 0
            while end < len(parts) and (total < COLLECTION_BYTES or h[end] == h[end - 1]):
                total += len(parts[end])
                end += 1
            out += [_runs(x) for x in repeats_in(parts[at:end], window)]
            at = end
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.table({"h": t.column("h"), "seg": t.column("seg"), "check": t.column("check"), "runs": pa.array(out, kind)})

    return run


STEP = 8  # windows of a piece of a segment


def _pieces(window: int):
    """A segment's windows in pieces of STEP, counted from the anchor, so that pieces of all segments
    of an anchor match; the first and last may be cut.  Each has the hash of all its bytes and that
    of its core, the bytes that all STEP windows of the piece share, also where it is cut."""

    def run(batches):
        for b in batches:
            for c in chunks(b, 3, 1 << 20):
                row, lo, n, whole, core, parts = [], [], [], [], [], []
                for i, (s, off) in enumerate(zip(c.column(3).to_pylist(), c.column(5).to_pylist())):
                    v = _VALUES[np.frombuffer(s, np.uint8)]
                    full = np.arange(off % STEP - STEP, len(v) - window + 1, STEP)
                    full = full[full > -STEP]
                    at = np.maximum(full, 0)
                    w = np.minimum(full + STEP, len(v) - window + 1) - at
                    rollers = Roller(v), Roller(v, 1)
                    whole.append([r.at(at, w + window - 1) for r in rollers])
                    core.append([r.at(full + STEP - 1, window - STEP + 1) for r in rollers])
                    row.append(np.full(len(at), i))
                    lo.append(at)
                    n.append(w)
                    parts += [s[x : x + y + window - 1] for x, y in zip(at.tolist(), w.tolist())]
                if not row:
                    continue
                take = pa.array(np.concatenate(row))
                sums = [np.concatenate([x[k] for x in part]).view(np.int64) for part in (whole, core) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(c.column(i).take(take) for i in range(3)), pa.array(np.concatenate(lo), pa.int32()), pa.array(np.concatenate(n), pa.int32()), *map(pa.array, sums), pa.array(parts, pa.binary()), c.column(4).take(take)], ["h", "seg", "check", "lo", "w", "one", "two", "core", "core2", "bytes", "n"])

    return run


def _spread(window: int):
    """Every window of a piece, by hash."""

    def run(batches):
        for b in batches:
            for c in chunks(b, 4, 1 << 16):
                one, two, at, row = [], [], [], []
                for i, (s, lo) in enumerate(zip(c.column(4).to_pylist(), c.column(3).to_pylist())):
                    v = _VALUES[np.frombuffer(s, np.uint8)]
                    one.append(Roller(v).windows(window))
                    two.append(Roller(v, 1).windows(window))
                    at.append(lo + np.arange(len(one[-1])))
                    row.append(np.full(len(one[-1]), i))
                take = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(c.column(i).take(take) for i in range(3)), pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), pa.array(np.concatenate(at), pa.int32()), c.column(5).take(take)], ["h", "seg", "check", "one", "two", "at", "n"])

    return run


def _hot_runs(hot: DataFrame, window: int) -> DataFrame:
    """h, seg, check, lo, hi: repeated windows of segments (h, seg, check, bytes, times) of which one
    anchor has very many, found by counting hashes alone.  A piece that occurs twice whole repeats
    whole; one whose core occurs once can't repeat; only the windows of the others are counted."""
    key = ["h", "seg", "check"]
    twice = lambda df, a, b: df.groupBy(a, b).agg(F.sum("n").alias("n")).filter("n > 1").select(a, b)
    pieces = written(hot.mapInArrow(_pieces(window), "h long, seg long, check int, lo int, w int, one long, two long, core long, core2 long, bytes binary, n long"), "bwt-pieces")
    whole = written(twice(pieces, "one", "two"), "bwt-whole-pieces")
    core = written(twice(pieces, "core", "core2"), "bwt-cores")
    done = pieces.join(whole, ["one", "two"]).select(*key, "lo", (F.col("lo") + F.col("w")).alias("hi"))
    open_ = pieces.join(core, ["core", "core2"]).join(whole.withColumn("done", F.lit(True)), ["one", "two"], "left").select(*key, "lo", "bytes", F.when(F.col("done"), F.lit(True)).otherwise(F.lit(False)).alias("done"), "n")
    open_ = written(open_, "bwt-open")
    # pieces that repeat whole stay in the count, since part of an open one may repeat in them: once each is enough
    kept = open_.filter("NOT done").select(*key, "lo", "bytes", "n").unionByName(open_.filter("done").groupBy("bytes").agg(F.min(F.struct(*key, "lo")).alias("x"), F.count("*").alias("n")).select(*(f"x.{k}" for k in key), "x.lo", "bytes", "n"))
    spread = written(kept.mapInArrow(_spread(window), "h long, seg long, check int, one long, two long, at int, n long"), "bwt-spread")
    again = written(twice(spread, "one", "two"), "bwt-twice")
    single = spread.join(again, ["one", "two"]).select(*key, F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    return done.unionByName(single)


def _remove(window: int):
    def run(batches):
        for b in (c for b in batches for c in chunks(b, 2)):
            out = []
            for text, runs in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                data = _bytes(text)
                cover = np.zeros(len(data) + 1, np.int64)
                for r in runs:
                    cover[r["lo"]] += 1
                    cover[r["hi"] + window - 1] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                kept = data[~gone].tobytes()
                out.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string())))], ["id", "th", "n_removed", "n_spans", "kept", "sha"])

    return run


def repeated_runs(pool: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, th, runs: of each keyed document of ``pool`` with strings of ``window`` bytes that also
    start elsewhere, where they start, as runs.

    Only strings around anchors that occur twice can repeat; those strings make the segments.  A
    segment that occurs twice repeats whole.  Different segments of one anchor are compared through
    the transform, in shards of bounded size; those of anchors with more than HOT different segments,
    which no bound would hold, by counting their windows' hashes instead."""
    spark = pool.sparkSession
    src = pool.select("id", "th", "text")
    anchors = written(src.mapInArrow(_anchors(window), "id long, th long, h long, n int"), "bwt-anchors")
    again = written(anchors.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "bwt-again")
    live = written(anchors.join(again, "h").groupBy("id", "th").agg(F.collect_set("h").alias("known")), "bwt-live")
    forget(anchors, again)
    seg = only(src, live).join(live, ["id", "th"]).select("id", "th", "text", "known").mapInArrow(_segments(window), "id long, th long, h long, seg long, check int, first int, n int, off int, bytes binary")
    seg = written(seg.withColumn("nr", F.monotonically_increasing_id()), "bwt-segments")
    forget(live)
    kinds = written(seg.groupBy("h", "seg", "check").agg(F.count("*").alias("times"), F.min("nr").alias("nr"), F.min("n").alias("n")), "bwt-kinds")
    width = written(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "bwt-width")
    picked = written(kinds.join(width, "h").select("nr", "kinds", "times"), "bwt-picked")
    hint = F.broadcast if small_enough(picked, 1_000_000) else lambda df: df
    texts = written(seg.select("nr", "h", "seg", "check", "off", "bytes").join(hint(picked), "nr"), "bwt-texts")
    total = texts.filter(F.col("kinds") <= HOT).agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    n = max(64, int(total // SHARD_BYTES) + 1)
    shard = F.pmod(F.xxhash64("h"), F.lit(n))
    found = texts.filter(F.col("kinds") <= HOT).withColumn("shard", shard).groupBy("shard").applyInArrow(_transform(window), f"h long, seg long, check int, runs {RUNS}")
    hot = _hot_runs(texts.filter(F.col("kinds") > HOT).select("h", "seg", "check", "bytes", "times", "off"), window)
    hot = hot.groupBy("h", "seg", "check").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"))
    found = written(found.unionByName(hot).filter(F.size("runs") > 0), "bwt-found")
    key = ["h", "seg", "check"]
    whole = F.when(F.col("times") > 1, F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))))
    marked = written(kinds.join(found, key, "left").select(*key, F.coalesce(whole, "runs").alias("runs")).filter("runs IS NOT NULL"), "bwt-marked")
    each = seg.select("id", "th", "first", *key).join(marked, key)
    moved = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("first")).alias("lo"), (r["hi"] + F.col("first")).alias("hi")))
    out = written(each.select("id", "th", moved.alias("runs")).groupBy("id", "th").agg(F.flatten(F.collect_list("runs")).alias("runs")), "bwt-runs")
    forget(seg, kinds, width, picked, texts, found, marked)
    return out


def remove_strings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, as binary; null where nothing was
    removed), kept_sha256: one row for each row of ``docs``.

    Texts are UTF-8 bytes; a byte goes if a string of ``window`` bytes that covers it starts anywhere
    else too, in its own text or another.  A null or empty text loses nothing, nor does one of fewer
    bytes.  Each row is a text of its own, rows that are alike too; ids may be null or repeated.  Of
    equal texts one stands for all when strings are compared, and all lose everything.  ``window`` may be
    of any length from GRAM on.  An empty table gives no rows."""
    if window < GRAM:
        raise ValueError(f"a window has {GRAM} bytes at least")
    src = keyed_text(docs, id_col, text_col)
    whole = written(src.select("id", "th", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")), "bwt-whole")
    groups = written(whole.filter(F.col("n_bytes") >= window).groupBy("digest").agg(F.min("id").alias("lo"), F.count("*").alias("n")).filter("n > 1").select("digest", "lo"), "bwt-groups")
    copies = written(whole.join(groups, "digest").select("id", "th", (F.col("id") > F.col("lo")).alias("extra")).distinct(), "bwt-copies")
    extra = written(copies.filter("extra").select("id", "th"), "bwt-extra")
    runs = repeated_runs(without(alike_once(src.select("id", "th", "text"), whole), extra, ["id", "th"]), window)
    forget(groups, extra)
    cut = only(src, runs).join(runs, ["id", "th"]).select("id", "th", "text", "runs").mapInArrow(_remove(window), "id long, th long, n_removed long, n_spans long, kept binary, sha string")
    cut = written(cut, "bwt-cut").dropDuplicates(["id", "th"])
    out = whole.join(cut, ["id", "th"], "left").join(copies.select("id", "th", F.lit(True).alias("copy")), ["id", "th"], "left")
    pick = lambda copy, own, none: F.when(F.col("copy"), copy).when(F.col("sha").isNotNull(), own).otherwise(none)
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(b""), F.col("kept"), F.lit(None)).alias("kept"), pick(F.sha2(F.lit(b""), 256), F.col("sha"), F.col("digest")).alias("kept_sha256"),
    )


def op5_bytespan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, repeated rows and empty tables as in :func:`remove_strings`."""
    return remove_strings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


#: Every 200-byte string of every text by its hash, so for small tables.  Texts are written in hexadecimal, two digits a byte.
SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, CAST(length(x) // 2 AS BIGINT) - 199)) AS i FROM d WHERE length(x) >= 400)),
s AS MATERIALIZED (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM s)),
p AS MATERIALIZED (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
k AS (SELECT d.r, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS kept, max(b) AS last FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_ FROM p) q JOIN d ON d.r = q.r GROUP BY d.r),
n AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM p GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN k.r IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN k ON k.r = d.r
"""
