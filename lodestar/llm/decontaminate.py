"""Benchmark decontamination by winnowed fingerprints (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Roller, chunks, forget, hashed, keep_rows, keyed_text, only, small_enough, spread, window_minima, written

WINDOW = 10  # words that must be shared
GRAM = 5  # words of a fingerprint
SPAN = WINDOW - GRAM + 1  # fingerprints in a window: winnowing keeps the least of each
#: Words: ASCII letters and digits, and everything beyond ASCII.
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_SPACED).split()


def _positions(texts: list[str | None]):
    """The words of all texts as hashes, the number of the text each belongs to, each text's first
    word, and how many words there are from each word to the end of its text."""
    split = [words_of(t) for t in texts]
    length = np.fromiter(map(len, split), np.int64, len(split))
    end = np.cumsum(length)
    h, _ = hashed([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(split)), length)
    return h, doc, end - length, end[doc] - np.arange(len(h))


def _item_windows(batches):
    """k, one, two, item: the windows of an item, by two hashes; k words, WINDOW or all it has."""
    for b in (c for b in batches for c in chunks(b)):
        h, doc, first, room = _positions(b.column(1).to_pylist())
        size = np.bincount(doc, minlength=b.num_rows)
        k = np.minimum(size, WINDOW)[doc]
        one, two = Roller(h), Roller(h, 1)
        at = np.flatnonzero(room >= k)
        yield pa.RecordBatch.from_arrays([pa.array(k[at].astype(np.int32)), pa.array(one.at(at, k[at]).view(np.int64)), pa.array(two.at(at, k[at]).view(np.int64)), b.column(0).take(pa.array(doc[at]))], ["k", "one", "two", "item"])


def _kept_grams(h: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Winnowing: of each window of WINDOW words within a text the place of the least GRAM-word hash."""
    grams = Roller(h).windows(GRAM)
    grams = np.where(room[: len(grams)] >= GRAM, grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    of = window_minima(grams, SPAN)
    return np.unique(of[room[: len(of)] >= WINDOW]) if len(h) >= WINDOW else np.zeros(0, np.int64)


def _item_prints(batches):
    """k, h: the fingerprints of items of WINDOW words or more (k is WINDOW); of a shorter one itself."""
    for b in (c for b in batches for c in chunks(b)):
        h, doc, first, room = _positions(b.column(1).to_pylist())
        kept = _kept_grams(h, room)
        size = np.bincount(doc, minlength=b.num_rows)
        short = np.flatnonzero((size > 0) & (size < WINDOW))
        k = np.concatenate([np.full(len(kept), WINDOW), size[short]]).astype(np.int32)
        x = np.concatenate([Roller(h).at(kept, GRAM), Roller(h).at(first[short], size[short])])
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x.view(np.int64))], ["k", "h"])


def _doc_prints(short: list[int]):
    """id, th, k, h, at: a document's fingerprints; also all its windows of the lengths that short items
    have (nine at most)."""

    def run(batches):
        for b in (c for b in batches for c in chunks(b, 2)):
            h, doc, first, room = _positions(b.column(2).to_pylist())
            roll = Roller(h)
            kept = _kept_grams(h, room)
            parts = [(WINDOW, kept, roll.at(kept, GRAM))]
            for k in short:
                at = np.flatnonzero(room >= k)
                parts.append((k, at, roll.at(at, k)))
            for k, at, x in parts:
                of = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(np.full(len(at), k, np.int32)), pa.array(x.view(np.int64)), pa.array((at - first[doc[at]]).astype(np.int32))], ["id", "th", "k", "h", "at"])

    return run


def _candidates(batches):
    """id, th, k, one, two, at: the windows of a document around its fingerprints that an item has."""
    for b in batches:
        for c in chunks(b, 2):
            h, doc, first, room = _positions(c.column(2).to_pylist())
            if not len(h):
                continue
            k, at = [], []
            for d, found in enumerate(c.column(3).to_pylist()):
                places = np.array([(f["k"], f["at"]) for f in found], np.int64).reshape(-1, 2) + [0, first[d]]
                for size in np.unique(places[:, 0]).tolist():
                    own = places[places[:, 0] == size, 1]
                    if size == WINDOW:  # the windows that hold the fingerprint
                        own = np.unique((own[:, None] - np.arange(SPAN)).ravel())
                        own = own[own >= first[d]]
                    own = own[room[own] >= size]
                    at.append(own)
                    k.append(np.full(len(own), size))
            if not at:
                continue
            k, at = np.concatenate(k), np.concatenate(at)
            of = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays([c.column(0).take(of), c.column(1).take(of), pa.array(k.astype(np.int32)), pa.array(Roller(h).at(at, k).view(np.int64)), pa.array(Roller(h, 1).at(at, k).view(np.int64)), pa.array((at - first[doc[at]]).astype(np.int32))], ["id", "th", "k", "one", "two", "at"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, hits (positions of hit words), items (ids of items with occurring windows): one
    row for each row of ``docs``.

    A window is WINDOW consecutive words of an item, or a shorter item whole.  Both sides keep the
    least GRAM-word hash of every window, so any shared window shares a fingerprint.  The fingerprints
    are joined; around those that meet the windows themselves are, by 128 bits of hash.  Items of fewer
    words are joined with every window of their length.

    The benchmark is tables throughout.  Up to ``broadcast_rows`` rows of it are broadcast, so that the
    documents' side isn't shuffled; a larger one is joined by a shuffle.  Only documents with a
    fingerprint in common are read again.  A null text has no words and matches nothing; rows that are
    alike in id and text are looked up once and returned as often as they come, also where the id is
    null; an item without an id is called ``null``; repeated items count once by id; an empty benchmark
    hits nothing; no documents give no rows."""
    hint = lambda df: F.broadcast(df) if small_enough(df, broadcast_rows) else df
    src = keyed_text(docs, id_col, text_col).select("id", "th", "text")
    items = spread(benchmark).select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    prints = written(items.mapInArrow(_item_prints, "k int, h long").distinct(), "bench-prints")
    windows = written(items.mapInArrow(_item_windows, "k int, one long, two long, item string").distinct(), "bench-windows")
    short = sorted(r.k for r in prints.select("k").distinct().collect() if r.k < WINDOW)
    met = src.mapInArrow(_doc_prints(short), "id long, th long, k int, h long, at int").join(hint(prints), ["k", "h"], "left_semi")
    met = written(met.groupBy("id", "th").agg(F.collect_set(F.struct("k", "at")).alias("found")), "bench-met")
    near = only(src, met, broadcast_rows).join(met, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "found").mapInArrow(_candidates, "id long, th long, k int, one long, two long, at int")
    near = written(near, "bench-near")
    hit = written(near.join(hint(windows.select("k", "one", "two").distinct()), ["k", "one", "two"], "left_semi"), "bench-hit")
    places = hit.select("id", "th", F.explode(F.sequence("at", F.col("at") + F.col("k") - 1)).alias("p"))
    places = places.groupBy("id", "th").agg(F.array_sort(F.collect_set("p")).alias("hits"))
    named = hit.select("id", "th", "k", "one", "two").distinct().join(hint(windows), ["k", "one", "two"]).groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = written(places.join(named, ["id", "th"]), "bench-found")
    forget(prints, met, near, hit, windows)
    n_words = F.regexp_count(ascii_words("text"), F.lit(r"[^ ]+")).cast("long")
    each = keyed_text(docs, id_col, text_col).select("id", "th", "doc_id", n_words.alias("n_words"))
    return each.join(found, ["id", "th"], "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "th")


def ascii_words(column: str):
    """The text with everything that is no word turned to spaces."""
    return F.regexp_replace(column, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a hit word, with all their columns.  Rows are told apart by id and text, so rows
    without an id stand or fall by their own text; rows that are alike fall together; nulls, empty
    texts and empty tables as in :func:`contamination`."""
    verdict = contamination(docs, benchmark).filter(F.size("hits") > 0).select("doc_id", "th", F.lit(False).alias("keep"))
    return keep_rows(docs, written(verdict, "contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents against the whole benchmark; nulls, empty texts, repeated rows and empty
    tables as in :func:`contamination`."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    n_hit = F.size("hits").cast("long")
    return contamination(read("documents"), read("benchmark")).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
