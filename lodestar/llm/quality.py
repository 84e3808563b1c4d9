"""Quality classifier: random-indexing word vectors and a two-layer network (operator 8)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, dealt_texts, give_back, keep_rows, release, written

DIM = 32  # of index and word vectors
VOCABULARY = 1 << 16  # the most frequent words have vectors of their own
SLOTS = 1 << 15  # all other words share these, by hash, so the table's size is fixed
REACH = 2  # words to either side that count as context
SAMPLE = 20_000  # labelled documents fitted on, at most
THRESHOLD = 0.7
CHUNK = 1 << 20  # bytes of text worked on at a time
BLOCK = 1 << 13  # rows of a table, or words of a long text, worked on at a time
DECAY = 1e-3  # of the network's weights
FLUSH = 1 << 18  # counts of distinct words a task holds before it sends them on
#: What counts as a word: capitalised or small letters, capitals, digits, or one other character.
_TOKEN = re.compile(rb"[A-Z]?[a-z\x80-\xff]+|[A-Z]+|[0-9]+|[^\x00-\x20A-Za-z0-9\x80-\xff]")
_CAPITAL = re.compile(rb"[A-Z][a-z\x80-\xff]")


@lru_cache(maxsize=1)
def _index_places(n: int) -> np.ndarray:
    """n x 4: a fixed sparse ternary vector for each row of the table, +1 at the first two places, -1
    at the others.  Drawn in blocks, since a worker holds what is kept as long as it lives."""
    rng = np.random.default_rng(20240607)
    return np.concatenate([rng.random((min(BLOCK, n - at), DIM)).argsort(axis=1)[:, :4].astype(np.uint8) for at in range(0, n, BLOCK)])


def _index_vectors(n: int) -> np.ndarray:
    out = np.zeros((n, DIM), np.float32)
    np.put_along_axis(out, _index_places(n), np.array([1, 1, -1, -1], np.float32), axis=1)
    return out


@lru_cache(maxsize=1)
def _index_masks(n: int) -> np.ndarray:
    """2 x n: the places of each row's +1 and -1 as bits."""
    bits = np.uint64(1) << _index_places(n).astype(np.uint64)
    return np.stack([bits[:, 0] | bits[:, 1], bits[:, 2] | bits[:, 3]])


def _alike(slot: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For each word the dot product of its index vector and the one before; 0 for the first."""
    plus, minus = masks[:, slot]
    ones = lambda a, b: np.bitwise_count(a[1:] & b[:-1]).astype(np.int64)
    return np.concatenate([np.zeros(min(1, len(slot)), np.int64), ones(plus, plus) + ones(minus, minus) - ones(plus, minus) - ones(minus, plus)])


#: What a byte is: 0 between words, 1 a capital, 2 a small letter or part of a character beyond ASCII, 3
#: a digit, 4 anything else, which is a word by itself.
_KIND = np.array([0 if c <= 32 else 2 if c >= 128 or 97 <= c <= 122 else 1 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 for c in range(256)], np.uint8)


def _split(texts: list[str | None]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts, as _TOKEN finds them, and each text's number of words.  A word begins where
    the kind of byte changes, but small letters go on with a single capital before them; so no word
    becomes an object of its own."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
    kind = _KIND[data]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    begins = (kind != 0) & ((kind != before) | (kind == 4))
    single = np.flatnonzero((kind[:-1] == 1) & (before[:-1] != 1) & (kind[1:] == 2))
    begins[single + 1] = False
    at, kept = np.flatnonzero(begins), kind != 0
    offsets = np.append(np.cumsum(kept, dtype=np.int32)[at] - 1, np.count_nonzero(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return words, np.diff(np.searchsorted(at, np.concatenate([[0], ends])))


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct spellings in all texts, the number of the spelling of each word, and each
    text's number of words.  Words that are only capitalised have the hash of the small ones."""
    words, length = _split(texts)
    coded = words.dictionary_encode()
    own = (w.lower() if _CAPITAL.match(w) else w for w in coded.dictionary.to_pylist())
    h = np.array([xxhash.xxh64_intdigest(w) for w in own], dtype=np.uint64)
    return h, (coded.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)), length


def _slotted(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's row of each word of all texts, and each text's number of words.  Rows from SLOTS on
    belong to one word each of the sorted ``vocabulary``, the ones before to the others by hash."""
    h, spelling, length = _words(texts)
    row = (h & np.uint64(SLOTS - 1)).astype(np.int64)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        row = np.where(vocabulary[at] == h, SLOTS + at, row)
    return row[spelling], length


def frequent_words(docs: DataFrame, size: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the ``size`` most frequent words, ties by hash, by exact counts over all
    documents; only the chosen come to the driver."""

    def count(batches):
        held, n = [], 0

        def send():
            u, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.bincount(at, np.concatenate([x for _, x in held]), len(u)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "n"])

        for b in batches:
            for c in chunks(b, 1, CHUNK):
                h, spelling, _ = _words(c.column(1).to_pylist())
                held.append((h, np.bincount(spelling, minlength=len(h))))
                n += len(h)
                if n >= FLUSH:
                    yield send()
                    n = 0
        if held:
            yield send()
        give_back()

    counts = dealt_texts(docs, id_col, text_col).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "h").limit(size).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def word_vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Context vectors over all documents, of words or of the slots that words share: one row each, of
    length one.

    A word's context vector adds up its neighbours' index vectors.  Each task sums up what it reads
    and sends one row for each row of the table; they are added by row."""
    size = SLOTS + len(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        places, total = _index_places(size), np.zeros(size * DIM, np.int64)
        for b in batches:
            for c in chunks(b, 1, CHUNK):
                slot, length = _slotted(c.column(1).to_pylist(), shared.value)
                doc = np.repeat(np.arange(len(length)), length)
                word, near = [], []
                for k in range(1, REACH + 1):
                    same = doc[k:] == doc[:-k]
                    left, right = slot[:-k][same], slot[k:][same]
                    word += [left, right]
                    near += [right, left]
                word, near = np.concatenate(word) * DIM, np.concatenate(near)
                for add, ends in ((np.add, (0, 1)), (np.subtract, (2, 3))):
                    add(total, np.bincount(np.concatenate([word + places[near, j] for j in ends]), minlength=size * DIM), out=total)
        table = total.reshape(size, DIM)
        used = np.flatnonzero(table.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(table[used, d], pa.int64()) for d in range(DIM))], ["slot", *names])

    names = [f"c{d}" for d in range(DIM)]
    rows = dealt_texts(docs, id_col, text_col).mapInArrow(count, "slot int, " + ", ".join(f"{c} long" for c in names))
    summed = rows.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # as many rows as the table
    out = np.zeros((size, DIM), np.float64)
    out[summed.column("slot").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in names], axis=1).reshape(-1, DIM)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


N_FEATURES = 2 * DIM + 4


def pooling_table(vectors: np.ndarray) -> np.ndarray:
    """What a word adds to its text: its vector, the squares, how far it points to itself."""
    own = (vectors * _index_vectors(len(vectors))).sum(axis=1, keepdims=True)
    return np.hstack([vectors, vectors**2, own]).astype(np.float32)


def features(texts: list[str | None], table: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Pooled over a text's words: the mean word vector, the mean of its squares, how far words
    point to themselves, how alike neighbours are, the mean vector's length, the size."""
    slot, length = _slotted(texts, vocabulary)
    out = np.zeros((len(texts), N_FEATURES), np.float64)
    full = np.flatnonzero(length)
    if not len(full):
        return out
    at = (np.cumsum(length) - length)[full]
    n = length[full][:, None]
    pooled = lambda a, k: sum(table[slot[i : min(i + BLOCK, a + k)]].sum(axis=0, dtype=np.float64) for i in range(a, a + k, BLOCK))
    mean = np.stack([pooled(a, k) for a, k in zip(at.tolist(), length[full].tolist())]) / n
    alike = _alike(slot, _index_masks(len(table)))
    alike[at] = 0
    alike = np.add.reduceat(alike, at)[:, None] / n
    out[full] = np.hstack([mean, alike, np.linalg.norm(mean[:, :DIM], axis=1, keepdims=True), np.log1p(n)])
    return out


@dataclass
class Network:
    """Two layers; probabilities are the logits over the temperature, through a sigmoid."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).clip(-8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.logits(x) / self.temperature).clip(-60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5) -> Network:
    """Adam on four fifths of the rows; the temperature is fitted on the rest.  Without rows of
    both labels the network answers the share of label 1, or one half without any row."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(x.mean(axis=0) if len(y) else np.zeros(d), x.std(axis=0) + 1e-6 if len(y) else np.ones(d), rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    order = rng.permutation(len(y))
    cut = max(1, len(y) // 5)
    held, used = order[:cut], order[cut:]
    z = ((x - net.mean) / net.scale).clip(-8, 8)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    b2, step = np.array([net.b2]), 0
    for _ in range(max(epochs, 3000 * 64 // max(len(used), 1))):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            step += 1
            a = np.tanh(z[at] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-(a @ net.w2 + b2[0]).clip(-60, 60)))
            g = (p - y[at]) / len(at)
            da = np.outer(g, net.w2) * (1 - a * a)
            grads = (z[at].T @ da + DECAY * net.w1, da.sum(axis=0), a.T @ g + DECAY * net.w2, np.array([g.sum()]))
            for p_, g_, (m, v) in zip((net.w1, net.b1, net.w2, b2), grads, state):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(b2[0])
    raw = net.logits(x[held])
    loss = lambda t: np.logaddexp(0, np.where(y[held] == 1, -raw, raw) / t).mean()
    net.temperature = min(np.geomspace(0.5, 8, 49), key=loss)
    return net


def _scored(docs: DataFrame, labels: DataFrame, corpus: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """doc_id, th (hash of the text), score."""
    spark = docs.sparkSession
    vocabulary = frequent_words(corpus, VOCABULARY, id_col, text_col)
    vectors = word_vectors(corpus, vocabulary, id_col, text_col)
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample)
    shared = spark.sparkContext.broadcast((pooling_table(vectors), vocabulary))

    def pool(batches):
        for b in batches:
            for c in chunks(b, 1, CHUNK):
                x = features(c.column(1).to_pylist(), *shared.value)
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([r.astype(np.float64).tobytes() for r in x], pa.binary()), c.column(2)], ["doc_id", "x", "y"])

    known = dealt_texts(corpus, id_col, text_col).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
    pooled = known.mapInArrow(pool, "doc_id long, x binary, y int")
    rows = pooled.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).orderBy("doc_id").collect()  # ``sample`` rows at most
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, N_FEATURES)
    net = fit(x, np.array([r.y for r in rows], dtype=np.float64))
    model = spark.sparkContext.broadcast(net)
    del vectors, rows, x
    give_back()  # the driver's share
    release(spark)

    def score(batches):
        for b in batches:
            for c in chunks(b, 1, CHUNK):
                s = model.value.score(features(c.column(1).to_pylist(), *shared.value))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(2), pa.array(s, pa.float64())], ["doc_id", "th", "score"])

    return dealt_texts(docs, id_col, text_col).withColumn("th", F.xxhash64("text")).mapInArrow(score, "doc_id long, th long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for every row of ``docs``.

    The VOCABULARY most frequent words of ``corpus`` (``docs`` if not given) have vectors of their own,
    counted over all its documents; the rest share SLOTS vectors.  The network is fitted on at most
    ``sample`` labelled documents, the first by a hash of their id.  ``labels`` should hold only rows to
    learn from; of repeated labels of an id the lowest counts, of rows repeated with one id a single
    one; null labels and labels without a document are passed over.  A null text counts as empty; an
    empty text is scored like any other; repeated rows and null ids are scored as they come; without
    usable labels every score is one half; an empty table gives no rows.  Only the text enters a score."""
    return _scored(docs, labels, docs if corpus is None else corpus, id_col, text_col, label_col, sample).drop("th")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, with all their columns.  Rows are told apart by id and
    text, so rows without an id stand or fall by their own text; rows that are alike fall together;
    nulls, empty texts and empty tables as in :func:`quality_scores`."""
    scored = _scored(docs, labels.filter(~held_out()), docs, "doc_id", "text", "quality", SAMPLE)
    return keep_rows(docs, written(scored.filter(F.col("score") < threshold).select("doc_id", "th", F.lit(False).alias("keep")), "poor"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; nulls, empty texts, repeated rows and empty tables as in
    :func:`quality_scores`."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    scored = quality_scores(read("documents"), read("labels").filter(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
