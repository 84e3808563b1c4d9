"""Language-model scoring with a log-frequency Bloom filter (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, give_back, mix, release, spread, written

END = b"\n"  # no word holds one
PROBES = 6  # hash functions of one membership
BITS = 8.66  # for each entry: PROBES / ln 2
LAMBDA = 0.4  # weight of the bigram estimate
BLOCK = 4 << 20  # bytes of text whose n-grams are looked up together
SEGMENT = 12 << 20  # bytes of text to one segment of the filter
KEY = 5  # bytes that name a pair within its segment
STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray, np.ndarray]:
    """Of all texts' tokens, one behind the other: hash (even), number of the distinct token; the
    distinct tokens, END being the last; each text's number of tokens.  Arrow splits, so that no token
    becomes an object."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().cast(pa.binary())
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    coded = flat.filter(pa.array(full)).dictionary_encode()
    length = np.bincount(doc[full], minlength=len(texts)) + 1
    ends = np.zeros(int(length.sum()), bool)
    ends[np.cumsum(length) - 1] = True
    token = np.full(len(ends), len(coded.dictionary), np.int64)
    token[~ends] = coded.indices.to_numpy(zero_copy_only=False)
    words = pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())])
    digest = xxhash.xxh64_intdigest
    of = np.array([digest(w) for w in words.to_pylist()], dtype=np.uint64) & ~np.uint64(1)
    return of[token], token, words, length


def _bigrams(h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token's history (the end token before the first) and of the pair.  Pairs are
    odd, single tokens even."""
    past = np.concatenate([h[-1:], h[:-1]])  # every text ends with END, so this is right at starts
    with np.errstate(over="ignore"):
        return past, mix(past * STEP + h) | np.uint64(1)


def level_of(counts: np.ndarray) -> np.ndarray:
    """A count's quantum: 1 for 1, 2 for 2-3, 3 for 4-7, ... (log base 2)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a quantum; 0 for level 0."""
    level = level.astype(np.float64)
    return np.where(level > 0, (2.0 ** (level - 1) + 2.0**level - 1) / 2, 0.0)


def _spots(h: np.ndarray, level: int | np.ndarray, m: np.ndarray):
    """The PROBES bit positions of (h, level) in a segment of m bits, one array after the other."""
    with np.errstate(over="ignore"):
        x = mix(h + STEP * np.asarray(level, dtype=np.uint64))
        a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        for i in range(PROBES):
            yield (((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * m) >> np.uint64(32)


def build_segment(h: np.ndarray, counts: np.ndarray, each: float = BITS) -> tuple[np.ndarray, int]:
    """Bits (packed) and their number: an n-gram of level q is entered as (n-gram, 1) ... (n-gram, q)."""
    level = level_of(counts)
    m = max(64, int(np.ceil(level.sum() * each / 64)) * 64)
    bits = np.zeros(m, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for spot in _spots(h[level >= q], q, np.uint64(m)):
            bits[spot.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little"), m


@dataclass
class Filter:
    """One segment of the filter: its bits, packed, and their number."""

    bits: np.ndarray
    m: int

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The quantum of each n-gram's count: membership of (n-gram, 1), (n-gram, 2), ... is probed
        until one fails."""
        part = 1 << 16  # keeps what is worked on within the processor's cache
        return np.concatenate([self._levels(h[at : at + part]) for at in range(0, len(h), part)] or [np.zeros(0, np.uint8)])

    def _levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        alive, level = np.arange(len(h)), 0
        while len(alive):
            level += 1
            ok = np.ones(len(alive), bool)
            rest = np.arange(len(alive))
            for spot in _spots(h[alive], level, np.uint64(self.m)):
                at = spot[rest].astype(np.int64)
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
                ok[rest[hit == 0]] = False
                rest = rest[hit == 1]
                if not len(rest):
                    break
            alive = alive[ok]
            out[alive] = level
        return out


def segment_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def prob(pair, past, word, n: float, v: float):
    """Interpolated probability of a token from the counts of the pair, its history, itself."""
    single = (word + 1) / (n + v + 1)
    both = np.minimum(1.0, pair / np.maximum(past, 1e-9))
    return np.where(past > 0, LAMBDA * both + (1 - LAMBDA) * single, single)


_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def _in_blocks(batches):
    """block, size (bytes of text), rows: a block's doc_id, held and text, packed, in one row."""
    part, nth = TaskContext.get().partitionId(), 0
    for b in batches:
        for c in chunks(b, 2, BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, c.schema, options=_ZSTD) as out:
                out.write_batch(c)
            size = pc.sum(pc.binary_length(c.column(2)).cast(pa.int64())).as_py()
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | nth]), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "size", "rows"])
            nth += 1


def _unpacked(rows: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks().to_batches()[0]


class Grams:
    """The distinct tokens and pairs of a piece of text, both ordered by the segment of the filter that
    they belong to."""

    def __init__(self, texts: pa.Array, n: int):
        h, token, self.words, self.length = _flat(texts)
        of = np.zeros(len(self.words), np.uint64)
        of[token] = h
        self.word_seg = segment_of(of, n)
        self.word_order = np.argsort(self.word_seg, kind="stable")
        self.pairs, self.pair = np.unique(_bigrams(h, self.length)[1], return_inverse=True)
        self.pair_seg = segment_of(self.pairs, n)
        self.pair_order = np.argsort(self.pair_seg, kind="stable")
        self.token = token


def _ask(n: int):
    """seg, block, pairs, pair_counts, words, sizes, word_counts: what a block asks each segment, and how
    often its training texts have it."""

    def run(batches):
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1)):
                c = _unpacked(packed)
                g = Grams(c.column(2), n)
                train = np.repeat(~c.column(1).to_numpy(zero_copy_only=False).astype(bool), g.length)
                word_counts = np.bincount(g.token, train, len(g.words)).astype(np.int32)
                pair_counts = np.bincount(g.pair, train, len(g.pairs)).astype(np.int32)
                ws, ps = g.word_seg[g.word_order], g.pair_seg[g.pair_order]
                segs = np.unique(np.concatenate([ws, ps]))
                edges = [np.append(np.searchsorted(x, segs), len(x)).tolist() for x in (ws, ps)]
                keys = _short(g.pairs[g.pair_order])
                pair_counts = pair_counts[g.pair_order]
                cols = [[] for _ in range(5)]
                for i in range(len(segs)):
                    own, lo, hi = g.word_order[edges[0][i] : edges[0][i + 1]], edges[1][i], edges[1][i + 1]
                    for col, x in zip(cols, (_planes(keys[lo:hi]), _planes(pair_counts[lo:hi]), *_packed(g.words, own), _planes(word_counts[own]))):
                        col.append(x)
                k = len(segs)
                yield pa.RecordBatch.from_arrays([pa.array(segs), pa.array(np.full(k, block)), *(pa.array(x, pa.binary()) for x in cols)], ["seg", "block", "pairs", "pair_counts", "words", "sizes", "word_counts"])
                give_back()

    return run


def _short(pairs: np.ndarray) -> np.ndarray:
    """The upper KEY bytes of each pair's hash, by column: within a segment, whose size is bounded, two
    pairs have the same with a chance of some 4 in a million, far below the filter's own error."""
    return (pairs >> np.uint64(64 - 8 * KEY)).view(np.uint8).reshape(-1, 8)[:, :KEY]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, first the lowest byte of all, then the next: what is alike stands together, which
    is what compression of shuffles needs."""
    return (x if x.ndim == 2 else np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize)).T.tobytes()


def _joined(column: pa.ChunkedArray, kind, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all values of a column of planes, one behind the other, and how many each has."""
    full = np.dtype(kind).itemsize
    width = width or full
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(width, -1) for x in column]
    size = np.array([p.shape[1] for p in parts], np.int64)
    out = np.zeros((int(size.sum()), full), np.uint8)
    for p, end in zip(parts, np.cumsum(size).tolist()):
        out[end - p.shape[1] : end, :width] = p.T
    return out.view(kind).ravel(), size


def _answer(each: float):
    """Builds a segment of the filter from the training counts of all blocks, probes it for what they ask,
    and counts the words exactly.  block, seg, pair_levels, word_levels, word_counts; one row of
    block -1 has the segment's distinct training words (v) and training tokens (n)."""

    def run(table: pa.Table) -> pa.Table:
        keys, many = _joined(table.column("pairs"), np.uint64, KEY)
        pairs, at = np.unique(keys, return_inverse=True)
        del keys
        counts = np.bincount(at, _joined(table.column("pair_counts"), np.int32)[0], len(pairs)).astype(np.int64)
        sizes, words_each = _joined(table.column("sizes"), np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        text = b"".join(x.as_py() for x in table.column("words"))
        coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
        token = coded.indices.to_numpy(zero_copy_only=False)
        exact = np.bincount(token, _joined(table.column("word_counts"), np.int32)[0], len(coded.dictionary)).astype(np.int64)
        digest = xxhash.xxh64_intdigest
        words = np.array([digest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64) & ~np.uint64(1)
        with np.errstate(over="ignore"):
            pairs = pairs * np.uint64(2) + np.uint64(1)  # odd; words are even
        used, known = counts > 0, exact > 0
        bits, m = build_segment(np.concatenate([pairs[used], words[known]]), np.concatenate([counts[used], exact[known]]), each)
        model = Filter(bits, m)
        pair_levels, word_levels = model.levels(pairs)[at], model.levels(words)[token]
        exact_each = exact[token]
        p, w = np.cumsum(many), np.cumsum(words_each)
        cut = lambda x, ends: [_planes(x[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        rows = table.num_rows
        none = pa.array([b""], pa.binary())
        made = pa.table({
            "block": pa.concat_arrays([table.column("block").combine_chunks(), pa.array([-1])]) if rows else pa.array([-1]),
            "seg": pa.concat_arrays([table.column("seg").combine_chunks(), table.column("seg")[:1].combine_chunks()]),
            "pair_levels": pa.concat_arrays([pa.array(cut(pair_levels, p), pa.binary()), none]),
            "word_levels": pa.concat_arrays([pa.array(cut(word_levels, w), pa.binary()), none]),
            "word_counts": pa.concat_arrays([pa.array(cut(exact_each, w), pa.binary()), none]),
            "v": pa.array([0] * rows + [int(known.sum())], pa.int64()),
            "n": pa.array([0] * rows + [int(exact.sum())], pa.int64()),
        })
        give_back()
        return made

    return run


def _finish(segments: int, n: int, v: int):
    """Scores a block's rows from the segments' answers."""
    size = float(n + v + 1)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = _unpacked(block.column("rows")[0]), answers.sort_by("seg")
        g = Grams(rows.column(2), segments)
        pair, word, exact = np.zeros(len(g.pairs), np.uint8), np.zeros(len(g.words), np.uint8), np.zeros(len(g.words), np.int64)
        pair[g.pair_order] = _joined(answers.column("pair_levels"), np.uint8)[0]
        word[g.word_order] = _joined(answers.column("word_levels"), np.uint8)[0]
        exact[g.word_order] = _joined(answers.column("word_counts"), np.int64)[0]
        single, at = count_of(word), np.cumsum(g.length) - g.length
        past = np.concatenate([g.token[-1:], g.token[:-1]])  # every text ends with END, so this is right at starts
        p = prob(count_of(pair)[g.pair], single[past], single[g.token], n, v)
        base = np.add.reduceat(np.log10(exact + 1.0)[g.token], at) - g.length * np.log10(size)
        known = np.add.reduceat((exact > 0)[g.token].astype(np.int64), at)
        give_back()
        return pa.table({
            "doc_id": rows.column(0), "held_out": rows.column(1), "n_tokens": pa.array(g.length, pa.int64()), "n_known": pa.array(known),
            "base_score": pa.array(base), "score": pa.array(np.add.reduceat(np.log10(p), at)),
        })

    return run


def lm_scores(docs: DataFrame, held: str, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS) -> DataFrame:
    """Scores every text under a bigram model of the texts for which the SQL condition ``held`` is
    not true.  Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z lower-cased, and one end.  Blocks of text send their distinct tokens and
    pairs, with how often the training texts among them have each, to the segment of the filter that the
    n-gram's hash names; the number of segments follows from the size of the texts.  A segment's task
    enters the quantised counts of all blocks in a log-frequency Bloom filter of ``bits`` bits for each
    entry, probes it for every n-gram asked for, and answers each block with levels, and with the exact
    counts of tokens that base_score needs.  The blocks' texts meet the answers and are scored.  So
    neither filter nor vocabulary is ever in one place, whatever their size, and an n-gram however
    frequent has one entry for each block.

    A null text is empty and has the end token alone; repeated rows and null ids are scored like others;
    where nothing is trained on, base_score is 0; an empty table gives no rows."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.expr(held), F.lit(False)).alias("held"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = written(spread(src).mapInArrow(_in_blocks, "block long, size long, rows binary"), "lm-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    segments = max(16, -(-total // SEGMENT))
    asked = rows.select("block", "rows").mapInArrow(_ask(segments), "seg long, block long, pairs binary, pair_counts binary, words binary, sizes binary, word_counts binary")
    answers = written(asked.groupBy("seg").applyInArrow(_answer(bits), "block long, seg long, pair_levels binary, word_levels binary, word_counts binary, v long, n long"), "lm-answers")
    del asked
    release(spark)  # what was asked takes more room than anything else here
    v, n = (x or 0 for x in answers.filter("block = -1").agg(F.sum("v"), F.sum("n")).first())
    own = answers.filter("block >= 0").drop("v", "n")
    out = rows.select("block", "rows").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(_finish(segments, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _packed(words: pa.BinaryArray, own: np.ndarray) -> tuple[bytes, bytes]:
    """These words one behind the other, and the size of each."""
    picked = words.take(pa.array(own))
    _, offsets, data = picked.buffers()
    at = np.frombuffer(offsets, np.int32, len(own) + 1, 4 * picked.offset) if len(own) else np.zeros(1, np.int32)
    return (data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if len(own) else b""), _planes(np.diff(at).astype(np.int32))


HELD = "crc32(cast(doc_id AS string)) % 7 = 2"


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, repeated rows and empty tables as in :func:`lm_scores`."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), HELD)
