"""The training-data operators against brute force and SQL, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrameStatFunctions
from pyspark.sql import functions as F

from lodestar.llm import bwt, bytespan, common, decontaminate, exact, graph, lm, mixing, near, pii, quality, registry, simhash, substring, tokens
from tests.oracle import connect, same

LONG = " ".join(f"word{i % 97}x{i}" for i in range(260))
SCHEMA = "doc_id long, text string, source string, lang string, n_chars string, id string, h long, row int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names clash."""
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "One two", None), (3, "One two", None), (None, "One TWO", "b"), (4, LONG, "b"), (5, LONG, "b"), (6, "head " + LONG + " tail", None), (7, "x" * 30000, "c"),
        (8, " \n\t ", "c"), (9, "é" * 150 + " 🙂 " + "ab " * 400, ""), (None, None, None), (10, LONG.upper(), "a"), (11, LONG[:700] + " other words " + LONG[900:], "a"),
    ]
    return spark.createDataFrame([(*r, "l", "n", "i", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def clash(edge):
    """The same with the names that operators give columns of their own."""
    return edge.withColumns({c: F.lit(c) for c in ("copies", "copy_no", "__id", "__digest", "row_id", "row_text", "row_count", "th", "keep", "kept", "node", "Block", "nr")})


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_equal_sql(spark, sf_dir, name):
    same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.SQL[name])


# ---------------------------------------------------------------- shared pieces


def test_rolling_hashes():
    values = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64)
    for which in (0, 1):
        r = common.Roller(values, which)
        for k in (1, 3, 20):
            h = r.windows(k)
            groups = {}
            for i in range(len(h)):
                groups.setdefault(tuple(values[i : i + k]), set()).add(int(h[i]))
            assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
            assert (r.at(np.arange(len(h)), k) == h).all()


def test_window_minima():
    rng = np.random.default_rng(1)
    for n, w in ((1, 3), (5, 5), (40, 7), (40, 1)):
        h = rng.integers(0, 4, n).astype(np.uint64) << np.uint64(40)
        k = min(w, n)
        want = [max(i for i in range(s, s + k) if h[i] == h[s : s + k].min()) for s in range(n - k + 1)]
        assert common.window_minima(h, w).tolist() == want


def brute_components(n, edges):
    at = list(range(n))
    for _ in range(n):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(70, 110)] + [(7, 7), (7, 8), (8, 7)]
    want = {i: m for i, m in enumerate(brute_components(111, edges)) if i != m}
    got = {r.u: r.m for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1


def test_lm_like_brute_force(spark, documents, edge):
    for df in (documents, edge):
        docs = pairs(df)
        held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
        count = Counter(w for i, t in docs if not held[i] for w in lm.tokens_of(t))
        n, v = sum(count.values()), len(count)
        want = sorted((str(i), held[i], len(lm.tokens_of(t)), sum(count[w] > 0 for w in lm.tokens_of(t)), round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in lm.tokens_of(t)), 5)) for i, t in docs)
        got = lm.lm_scores(df, lm.HELD).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
        assert {r.train_tokens for r in got} == {n}
        assert quantised_like_brute_force(docs, held, n, v, lm.lm_scores(df, lm.HELD, bits=64).collect()) == 0  # too many bits for a false hit
        assert quantised_like_brute_force(docs, held, n, v, got) < 0.02


def quantised_like_brute_force(docs, held, n, v, got):
    """How far scores are off those of exact counts, brought to their quantum, over all tokens."""
    counts = Counter()
    for i, t in docs:
        if not held[i]:
            w = lm.tokens_of(t)
            counts.update(w)
            counts.update(zip([lm.END, *w], w))
    middle = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0.0
    want, tokens_ = [], 0
    for i, t in docs:
        w, total = lm.tokens_of(t), 0.0
        for past, word in zip([lm.END, *w], w):
            single = (middle(counts[word]) + 1) / (n + v + 1)
            both = middle(counts[past, word]) / middle(counts[past]) if counts[past] else 0
            total += math.log10(0.4 * min(1.0, both) + 0.6 * single if counts[past] else single)
        tokens_ += len(w)
        want.append((str(i), len(w), round(total, 6)))
    off = [abs(a[2] - b[2]) for a, b in zip(sorted(want), sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got))]
    return sum(x for x in off if x > 1e-5) / tokens_


def test_lm_blocks_and_segments(documents, monkeypatch):
    """Many small segments give what few large ones do."""
    want = {r.doc_id: (round(r.base_score, 6), round(r.score, 6)) for r in lm.lm_scores(documents, lm.HELD, bits=64).collect()}
    monkeypatch.setattr(lm, "SEGMENT", 3000)
    got = lm.lm_scores(documents.repartition(7), lm.HELD, bits=64).collect()
    assert {r.doc_id: (round(r.base_score, 6), round(r.score, 6)) for r in got} == want


def test_lm_edges(empty):
    assert lm.lm_scores(empty, lm.HELD).count() == 0
    assert lm.lm_scores(empty, "true").count() == 0


def test_lm_nothing_trained(edge):
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in lm.lm_scores(edge, "true").collect())


def test_filter_counts():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    c = rng.integers(1, 3000, len(h))
    bits, m = lm.build_segment(h, c)
    f = lm.Filter(bits, m)
    q = f.levels(h)
    assert (q >= lm.level_of(c)).all() and (q == lm.level_of(c)).mean() > 0.95  # never too low
    assert (f.levels(rng.integers(2**63, 2**64 - 1, 4000, dtype=np.uint64)) == 0).mean() > 0.95
    assert lm.level_of(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]


# ---------------------------------------------------------------- 2


def brute_substring(docs, window):
    key = lambda i: common.NULL_ID if i is None else i
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            least[g] = min(least.get(g, key(i)), key(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < key(i):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_longest(docs, window):
    """The longest of window, 2 window, ... of which a window stands under another id too."""
    split = [(common.NULL_ID if i is None else i, (t or "").encode().split()) for i, t in docs]
    best, length = [0] * len(docs), window
    while any(len(w) >= length for _, w in split):
        of = {}
        for i, w in split:
            for s in range(len(w) - length + 1):
                of.setdefault(tuple(w[s : s + length]), set()).add(i)
        for n, (_, w) in enumerate(split):
            if any(len(of[tuple(w[s : s + length])]) > 1 for s in range(len(w) - length + 1)):
                best[n] = length
        length *= 2
    return Counter((str(i), len((t or "").split()), b) for (i, t), b in zip(docs, best))


def test_substring_like_brute_force(documents, edge):
    for df, window in ((documents, 50), (edge, 50), (edge, 8), (documents, 6)):
        got = substring.remove_repeats(df, window).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(pairs(df), window)
        if window >= 50 or df is edge:
            assert Counter((str(r.doc_id), r.n_words, r.longest) for r in got if r.longest) == Counter({k: n for k, n in brute_longest([(i, (t or "").strip()) for i, t in pairs(df)], window).items() if k[2]})


def test_rows_that_repeat(spark):
    """Many rows alike in id and text, with and without an id, are compared as one."""
    rows = [(5, LONG)] * 40 + [(None, LONG + " x")] * 40 + [(4, "head " + LONG), (6, "other " * 90)] + [(6, "other " * 90)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(rows, 50)
    got = bytespan.remove_strings(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_strings(rows, 200)


def test_substring_by_join(documents, monkeypatch):
    """The same without any broadcast."""
    monkeypatch.setattr(substring, "only", lambda docs, keys: docs)
    got = substring.remove_repeats(documents, 50).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substring(pairs(documents), 50)


def test_substring_edges(empty):
    assert substring.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- 3


def brute_targets(sizes):
    """sizes: by source.  Cap, then share out again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check_mix(df):
    got = mixing.mix_sources(df, partitions=5).collect()
    sizes = Counter()
    for r in df.select("source", "text").collect():
        sizes[r.source] += len((r.text or "").encode().split())
    want = brute_targets(sizes)
    assert len(got) == df.count()
    largest, taken = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size and r.copies >= 0
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    return got


def test_mix(spark, documents, edge, empty):
    a = check_mix(documents)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.copies)
    again = mixing.mix_sources(documents.repartition(7), partitions=5).collect()
    assert sorted(map(key, a)) == sorted(map(key, again))
    check_mix(edge)
    skew = spark.createDataFrame([(i, "w " * (i % 7), "big" if i % 3 else f"s{i % 60}", *"lni", 1, 2) for i in range(900)], SCHEMA)
    check_mix(skew)
    assert mixing.mix_sources(empty).count() == 0
    counted = [r.copies for r in mixing.mix_sources(documents, seed=3).collect()]
    assert all(x in (math.floor(q), math.ceil(q)) for x, q in zip(counted, [r.target / r.source_size for r in mixing.mix_sources(documents, seed=3).collect()]))
    rows = mixing.mix_rows(documents)
    assert set(rows.columns) == {*documents.columns, "copies"} and rows.count() == sum(r.copies > 0 for r in mixing.mix_sources(documents).collect())
    twice = mixing.mix_sources(edge).groupBy("doc_id", "th").agg(F.sum("copies").alias("c")).filter("c > 0")
    assert mixing.mix_rows(edge).agg(F.sum("copies")).first()[0] == twice.agg(F.sum("c")).first()[0]


def test_mix_is_unbiased(spark):
    """Over many offsets a document's copies come out at its expected number."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 4 == 0]) for i in range(60)], "doc_id long, text string, source string")
    runs = [sorted((r.doc_id, r.copies, r.target / r.source_size) for r in mixing.mix_sources(df, seed=s).collect()) for s in range(24)]
    for k in range(60):
        mean, expected = np.mean([r[k][1] for r in runs]), runs[0][k][2]
        assert abs(mean - expected) < 0.45
    assert abs(np.mean([[x[1] - x[2] for x in r] for r in runs])) < 0.05
    with pytest.raises(ValueError):
        mixing.mix_rows(df.withColumn("Copies", F.lit(1)))


# ---------------------------------------------------------------- 4


def test_tokens_like_brute_force(documents, edge, empty):
    encode = tokens.encoder(open(tokens.RANKS, "rb").read())
    assert encode.decode(encode.encode_ordinary("a <|endoftext|> é🙂")) == "a <|endoftext|> é🙂"
    for df in (documents, edge):
        n = sorted(len(encode.encode_ordinary(t or "")) for _, t in pairs(df))
        lengths = tokens.token_lengths(df)
        assert sorted(r.n_tokens for r in lengths.collect()) == n
        got = {r.length: r for r in tokens.context_limits(lengths).collect()}
        assert set(got) == set(n)
        for k, r in got.items():
            assert (r.n_docs, r.docs_from, r.tokens_from, r.docs_cut) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(x > k for x in n))
            assert (r.truncated_total, r.total_docs, r.total_tokens) == (sum(min(x, k) for x in n), len(n), sum(n))
            assert [r.p50, r.p90, r.p99] == [n[math.ceil(q * len(n)) - 1] for q in (0.5, 0.9, 0.99)]
        hist = tokens.histogram(lengths)
        sums, total = tokens.suffix_sums(hist), tokens.totals(hist)
        for limit in (0, 7, 1500, 10**6):
            assert tokens.truncated_total(sums, total, limit) == sum(min(x, limit) for x in n)
    assert tokens.context_limits(tokens.token_lengths(empty)).count() == 0


def test_tokens_long_white_space(spark):
    """Runs beyond the pattern's stack, and, at a lower limit, the tokens of the whole text."""
    encode = tokens.encoder(open(tokens.RANKS, "rb").read())
    rows = [(1, "a" + " " * 3_000_000 + "b"), (2, " " * 1_000_000), (3, "\n" * 5000 + "x" + "\t" * 5000), (4, None)]
    got = {r.doc_id: r.n_tokens for r in tokens.token_lengths(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 3_000_001, 2: 1_000_000, 3: len(encode.encode_ordinary(rows[2][1])), 4: 0}
    rng = np.random.default_rng(8)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b1", " ", "  ", "\n", "\t", "    ", "é", "'s", "!?", "\x1c", "\u2003", "\u200b"], rng.integers(0, 14)))
        assert tokens.encoded_length(encode, text, 3) == len(encode.encode_ordinary(text))


# ---------------------------------------------------------------- 5


def test_transform_like_sorting():
    rng = np.random.default_rng(1)
    for trial in range(120):
        texts = [rng.integers(1, rng.integers(2, 5) + 1, rng.integers(0, 14)).tolist() for _ in range(rng.integers(1, 8))]
        if trial % 3 == 0:
            texts.append(texts[0])
        c = bwt.Collection(np.array([x for t in texts for x in t], np.int64), np.cumsum([len(t) for t in texts]))
        want = sorted(((t[i:] + [0], d) for d, t in enumerate(texts) for i in range(len(t) + 1)))
        got = [None] * len(want)
        for k, who, place in c.walk():
            for w, p in zip(who, place):
                got[p] = texts[w][len(texts[w]) - k :]
        assert got == [s[:-1] for s, _ in want]
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert [int(x) for x in c.lcp[1:]] == [shared(a, b) for a, b in zip(got, got[1:])]
        times = Counter(tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2))
        who, start = c.repeated(3)
        assert sorted(zip(who.tolist(), start.tolist())) == sorted((d, i) for d, t in enumerate(texts) for i in range(len(t) - 2) if times[tuple(t[i : i + 3])] > 1)


def brute_strings(docs, window):
    raw = [(i, (t or "").encode()) for i, t in docs]
    times = Counter(b[s : s + window] for _, b in raw for s in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if times[b[s : s + window]] > 1:
                gone[s : s + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 1])
def test_strings_like_brute_force(documents, edge, monkeypatch, hot):
    monkeypatch.setattr(bytespan, "HOT", hot)
    for df, window in ((documents, 200), (edge, 200), (edge, 90)):
        got = bytespan.remove_strings(df, window).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_strings(pairs(df), window)


@pytest.mark.parametrize("window", [254, 255, 256, 301, 600, 2048])
def test_windows_of_any_length(window):
    """Common prefixes beyond 255 symbols count too."""
    rng = np.random.default_rng(window)
    shared = rng.integers(0, 256, window + 40, dtype=np.uint8).tobytes()
    parts = [rng.bytes(30) + shared + rng.bytes(50), shared + rng.bytes(20), rng.bytes(window + 100)]
    for got, begin in zip(bytespan.repeats_in(parts, window), (30, 0, None)):
        assert got.tolist() == ([] if begin is None else list(range(begin, begin + 41)))


def test_strings_edges(spark, empty):
    long = " ".join(f"n{i * i}" for i in range(500))
    rows = [(1, "a " + long), (2, long[:2400] + " z"), (3, long[5:1000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (301, 1024):
        got = bytespan.remove_strings(df, window).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_strings(rows, window)
    with pytest.raises(ValueError):
        bytespan.remove_strings(df, 20)
    assert bytespan.remove_strings(empty).count() == 0


# ---------------------------------------------------------------- 6


def brute_contamination(docs, items):
    words = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    split = {k: words(t) for k, t in enumerate(t for _, t in items)}
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for k, (name, _) in enumerate(items):
            own = split[k]
            n = min(10, len(own))
            grams = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in grams:
                    hit.update(range(s, s + n))
                    named.add("null" if name is None else str(name))
        out.append((str(i), len(w), sorted(hit), sorted(named)))
    return sorted(out)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_contamination_like_brute_force(spark, documents, edge, sf_dir, most):
    """By broadcasts, and without any."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text")
    extra = [("x1", "one two"), ("x2", None), ("x3", " !! "), (None, "Word0X0, word1x1"), ("x1", "one two"), ("x4", " ".join(LONG.split()[30:55])), ("x5", " ".join(LONG.split()[40:50]))]
    bench = bench.unionByName(spark.createDataFrame(extra, "item_id string, text string"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    for df in (edge, documents):
        got = decontaminate.contamination(df, bench, broadcast_rows=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.hits, r.items) for r in got) == brute_contamination(pairs(df), items)


def test_contamination_edges(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.hits == [] for r in decontaminate.contamination(edge, none).collect())
    assert decontaminate.contamination(empty, none).count() == 0
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(edge, bench).collect()
    ids = sorted(str(r.doc_id) for r in kept)
    assert ids.count("3") == 0 and ids.count("None") == 1 and [r.text for r in kept if r.doc_id is None] == [None]


# ---------------------------------------------------------------- 7


def model_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_like_brute_force(spark, documents, edge):
    assert simhash.fingerprint("a b c d") == model_fingerprint("a b c d")
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert simhash.fingerprint("a B c") == spark_hash % 2**64
    for df, bits in ((documents, 2), (edge, 2), (documents, 16)):
        docs = pairs(df)
        fp = [model_fingerprint(t) for _, t in docs]
        edges = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= bits]
        at = brute_components(len(fp), edges) if len(edges) < 3000 else None
        got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.simhash_groups(df, bits).collect())
        assert [(g[0], g[1]) for g in got] == sorted((str(i), f) for (i, _), f in zip(docs, fp))
        if at:
            least = {}
            for (i, _), c in zip(docs, at):
                if i is not None:
                    least[c] = min(least.get(c, i), i)
            assert got == sorted((str(i), f, str(least.get(c))) for (i, _), f, c in zip(docs, fp, at))


def test_trie_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 6)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (40, 6)).astype(np.uint64))
    a, b = np.unique(near.ravel()), np.unique(np.concatenate([base, near[:, 0]]))
    for chunk in (7, 10_000):
        got = {(int(i), int(j)) for x, y in simhash.trie_pairs(a, None, 3, chunk) for i, j in zip(x, y)}
        assert got == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 3}
        got = {(int(i), int(j)) for x, y in simhash.trie_pairs(a, b, 2, chunk) for i, j in zip(x, y)}
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 2}


@pytest.mark.parametrize("cap", [3, 40])
def test_leaves_lose_no_link(spark, cap):
    """Dense clusters under deep heavy nodes: components equal those of all pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 12).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (12, 14, 2)).astype(np.uint64)
    fp = np.unique(np.concatenate([base, (base[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel()]))
    df = common.written(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), "t")
    edges = [(r.a, r.b) for r in simhash.near_edges(df, 2, cap).collect()]
    at = {int(x): i for i, x in enumerate(fp.view(np.int64))}
    want = brute_components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 2])
    assert brute_components(len(fp), [(at[a], at[b]) for a, b in edges]) == want
    assert all(int(fp[at[a]] ^ fp[at[b]]).bit_count() >= 1 for a, b in edges)


def test_leaves_that_many_visit(spark):
    """Sixty thousand fingerprints under one prefix visit leaves that have few of their own."""
    rng = np.random.default_rng(6)
    crowded = (np.uint64(0b1010) << np.uint64(60)) | rng.integers(0, 2**60, 60_000).astype(np.uint64)
    others = rng.integers(0, 2**63, 6_000).astype(np.uint64)
    fp = np.unique(np.concatenate([crowded, others, others[:2]]))
    df = common.written(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), "t")
    blocks = simhash.leaf_blocks(simhash.trie_leaves(df, 2, 2_000), 2_000)
    sizes = blocks.groupBy("depth", "prefix", "block").agg(F.count("*").alias("n"), F.count_if("home").alias("own")).agg(F.max("n"), F.max("own"), F.max("block")).first()
    assert sizes[0] <= 3 * 2_000 and sizes[1] <= 2_000 and sizes[2] >= 2


def test_simhash_edges(empty, edge):
    assert simhash.simhash_groups(empty).count() == 0
    kept = [r.doc_id for r in simhash.drop_near(edge).collect()]
    assert 4 in kept and 5 not in kept and 10 not in kept and kept.count(1) == 1 and 2 not in kept and kept.count(3) == 1 and None not in kept


def test_near_without_ids(spark):
    rows = [(None, "unique words that stand for themselves here"), (None, LONG), (3, LONG), (None, "a b c d e f g"), (None, "a b c d e f g"), (9, "same id one text of some words"), (9, "same id another text of other words")]
    kept = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in {*rows} - {(None, LONG)})


def model_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("crowd", [1, 32])
def test_near_like_brute_force(spark, edge, monkeypatch, crowd):
    """Every pair from 0.8 on is linked, none below it, with chains and crowds."""
    monkeypatch.setattr(near, "CROWD", crowd)
    rng = np.random.default_rng(11)
    rows = [(i, t) for i, t in pairs(edge) if i]
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(6):  # each a few words off the one before
            rows.append((100 + len(rows), " ".join(words)))
            words = list(words)
            for at in rng.integers(0, 120, 1 + base % 5):
                words[at] = f"new{len(rows)}x{at}"
    sets = [model_shingles(t) for _, t in rows]
    like = {(a, b): len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) if sets[a] or sets[b] else 1 for a in range(len(rows)) for b in range(a)}
    links = [p for p, j in like.items() if j >= 0.8]
    assert len([p for p in links if like[p] < 0.9]) > 40 and len([j for j in like.values() if 0.5 < j < 0.8]) > 40
    at, least = brute_components(len(rows), links), {}
    for (i, _), c in zip(rows, at):
        least[c] = min(least.get(c, i), i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()}
    assert got == {(i, least[c]) for (i, _), c in zip(rows, at)}


def test_near_stage_links_fingerprints(spark, documents):
    """What operator 7 links is linked by the pipeline's stage, though the sets have less than 0.8 in common."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, "x " * 60 + " ".join(words)), (2, "x " * 60 + " ".join(words[:20] + ["v"] + words[21:])), (3, " ".join(f"u{i}" for i in range(90)))]
    a, b, _ = (model_shingles(t) for _, t in rows)
    fp = [model_fingerprint(t) for _, t in rows]
    assert 5 * len(a & b) < 4 * len(a | b) and (fp[0] ^ fp[1]).bit_count() <= 2 < (fp[0] ^ fp[2]).bit_count()
    kept = {r.doc_id for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 3}
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(documents).collect()}
    kept = {r.doc_id for r in simhash.drop_near(documents).collect()}
    assert all(groups[i] == i for i in kept)


# ---------------------------------------------------------------- 8


def test_quality_held_out(spark):
    """On rows that labels weren't learned from."""
    out = quality.op8_quality(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = out.merge(labels, on="doc_id")
    assert ((m.score >= 0.7) == (m.predicted == 1)).all() and m.score.between(0, 1).all()
    good, poor = m[m.quality == 1], m[m.quality == 0]
    assert good.predicted.mean() > 0.95 and poor.predicted.mean() < 0.25


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 0), (None, 1), (99, 1), (9, None), (11, 1)], "doc_id long, quality int")
    got = quality.quality_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(edge, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert quality.quality_scores(empty, labels).count() == 0


def test_quality_without_ids(spark):
    """Rows without an id stand or fall by their own text."""
    good = " ".join(f"The {w} house stands by the river, and people walk there." for w in "old new big small red".split())
    bad = "$$ buy now!!! 1111 CLICK xx " * 12
    rows = [(i, good.replace("house", f"house{i}")) for i in range(40)] + [(100 + i, bad + str(i)) for i in range(40)] + [(None, good), (None, bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i is not None], "doc_id long, quality int")
    kept = [r.text for r in quality.drop_poor(docs, labels).collect() if r.doc_id is None]
    assert kept == [good]


def test_quality_words_and_vectors(documents, monkeypatch):
    """The frequent words, and the context vectors of all words, against counting pair by pair."""
    texts = [t for _, t in pairs(documents)][:60]
    some = documents.filter(F.col("text").isin(texts))
    texts = [t for _, t in pairs(some)]
    split = [[w.lower() if quality._CAPITAL.match(w) else w for w in quality._TOKEN.findall((t or "").encode())] for t in texts]
    digest = quality.xxhash.xxh64_intdigest
    count = Counter(digest(w) for ws in split for w in ws)
    vocabulary = quality.frequent_words(some, 50)
    assert vocabulary.tolist() == sorted(sorted(count, key=lambda h: (-count[h], h - (1 << 64) * (h >> 63)))[:50])
    size = quality.SLOTS + 50
    row = lambda w: quality.SLOTS + int(np.searchsorted(vocabulary, digest(w))) if digest(w) in set(vocabulary.tolist()) else digest(w) % quality.SLOTS
    own, want = quality._index_vectors(size), np.zeros((size, quality.DIM))
    for ws in split:
        at = [row(w) for w in ws]
        for i in range(len(at)):
            for j in range(max(0, i - 2), min(len(at), i + 3)):
                if i != j:
                    want[at[i]] += own[at[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(some, vocabulary), want, atol=1e-5)


def test_quality_words(documents):
    """Words are what the pattern finds."""
    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(["A", "B", "c", "d", "é", "1", "2", " ", "\n", "\0", "!", "$", "\x7f", "Z"], rng.integers(0, 30))) for _ in range(3000)]
    for texts in (made, [t for _, t in pairs(documents)], [], [None, ""], [None, "x", ""]):
        words, length = quality._split(texts)
        want = [quality._TOKEN.findall((t or "").encode()) for t in texts]
        assert words.to_pylist() == [w for ws in want for w in ws] and length.tolist() == [len(w) for w in want]


def test_quality_features():
    """The mean of what is alike in neighbours' index vectors, word by word, not only of repeats."""
    texts = ["the quick brown fox, the THE quick quick", None, "", "one", "5 5 6 and more words of all kinds"]
    vocabulary = np.sort(np.array([quality.xxhash.xxh64_intdigest(w) for w in (b"the", b"quick")], np.uint64))
    own = quality._index_vectors(quality.SLOTS + 2)
    assert own.shape[1] == 32 and (abs(own).sum(axis=1) == 4).all()
    vectors = np.random.default_rng(1).normal(size=own.shape).astype(np.float32)
    got = quality.features(texts, quality.pooling_table(vectors), vocabulary)
    for text, x in zip(texts, got):
        slot = quality._slotted([text], vocabulary)[0]
        if not len(slot):
            assert not x.any()
            continue
        alike = sum(float(own[a] @ own[b]) for a, b in zip(slot, slot[1:])) / len(slot)
        mean, squares, self_like = vectors[slot].mean(axis=0), (vectors[slot] ** 2).mean(axis=0), (vectors[slot] * own[slot]).sum(axis=1).mean()
        assert np.allclose(x, [*mean, *squares, self_like, alike, np.linalg.norm(mean), np.log1p(len(slot))], atol=1e-4)


def test_calibration():
    """Probabilities mean what they say, on rows that neither weights nor temperature saw; without the
    temperature they are too sure."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, quality.N_FEATURES))
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1]))).astype(float)
    net = quality.fit(x[:800], y[:800])

    def error(score):
        bins = np.minimum((score * 10).astype(int), 9)
        return sum(abs(score[bins == b].mean() - y[800:][bins == b].mean()) * (bins == b).mean() for b in set(bins.tolist()))

    calibrated = error(net.score(x[800:]))
    net.temperature = 1.0
    assert calibrated < 0.12 and calibrated < error(net.score(x[800:]))


def test_temperature_and_training():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, quality.N_FEATURES))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # needs the hidden layer
    net = quality.fit(x, y)
    assert ((net.score(x) > 0.5) == y).mean() > 0.9 and 0.5 <= net.temperature <= 8


# ---------------------------------------------------------------- 9

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and luhn % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_pii_like_brute_force(spark, documents, edge):
    hard = [
        "a@b.c_d@e.f x@y..z@q.r 🙂 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111, +1 (555) 123-4567x+44 20 7946 0958", "5" * 20000, "a" * 20000 + "@", "+1 " * 2000 + "a@b.co " * 300 + "001.2.3.004 " * 200, "1 2" * 4000,
        "é@x.y a@é.b a@b.c", "4111111111111111\n5500 0000 0000 0004-", "+123456789 +1234567890123456 ++49 (0)30.901820",
    ]
    made = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for df in (documents, edge, made):
        got = Counter((r.doc_id, ",".join(f"{b.kind}:{b.start}:{b.end}" for b in r.base)) for r in pii.sanitise(df).collect())
        assert got == Counter((i, ",".join(brute_pii(t))) for i, t in pairs(df))


def brute_revealing(texts, generalise):
    """(text, term) -> disclosure, from the definition: everything counted in distinct texts."""
    texts = sorted(set(texts))
    found = [brute_entities(t) for t in texts]
    words = [{w.lower() for w in re.findall(r"[^\W\d_]+", t)} for t in texts]
    n, out = len(texts), {}
    c_e = Counter(e for f in found for e in f)
    c_t = Counter(w for ws in words for w in ws)
    c_et = Counter((e, w) for f, ws in zip(found, words) for e in f for w in ws)
    near = {(e, w) for f in found for e, ws in f.items() for w in ws}
    for t, f, ws in zip(texts, found, words):
        for e in f:
            for w in ws:
                seen = c_et[e, w] if (e, w) in near else c_et[e, w] - 1
                own = math.log2(n / c_e[e])
                d = math.log2((seen + 3 * c_e[e] / n) / (c_t[w] + 3) * n / c_e[e]) / own if seen > 0 and own > 0 else 0
                if d >= generalise:
                    out[t, w] = max(out.get((t, w), 0), d)
    return out


def brute_entities(text):
    """entity -> words near it."""
    out = {}
    for s in brute_pii(text):
        kind, a, b = s.split(":")
        a, b = int(a), int(b)
        value = text[a:b]
        name = kind + ":" + (value.lower() if kind == "email" else re.sub("[ ()-]", "", value))
        letters = r"[^\W\d_]+"
        left = re.sub(f"{letters}$", "", text[max(0, a - 60) : a])
        left = re.sub(f"^{letters}", "", left) if a > 60 else left
        right = re.sub(f"^{letters}", "", text[b : b + 60])
        right = re.sub(f"{letters}$", "", right) if len(text) > b + 60 else right
        out.setdefault(name, set()).update(w.lower() for w in re.findall(letters, left + " " + right))
    return out


def test_revealing_terms(spark):
    rows = [(i, f"filler word{i} quiet, Smithers writes to jo@x.org about it. More text {i} here" + " and so on" * 20 + " signed Doe") for i in range(6)]
    rows += [(100 + i, f"noise words {i} more of the text here, it writes to and about filler quiet and so on") for i in range(80)]
    rows += [(200 + i, "Smytherson asks al@y.org now") for i in range(9)]  # copies are one text
    rows += [(300, "UNO and jo@x.org and +1 555 123 4567 or 10.1.2.3, 10.1.2.3"), (301, "Smithers alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    want = brute_revealing([t for _, t in rows], pii.GENERALISE)
    for i, text in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in brute_pii(text)]
        spans = [(m.start(), m.end(), "remove" if want[text, m[0].lower()] >= pii.REMOVE else "generalise") for m in re.finditer(r"[^\W\d_]+", text) if (text, m[0].lower()) in want]
        assert [(t.start, t.end, t.action) for t in got[i].terms] == [s for s in spans if not any(a < s[1] and s[0] < b for a, b in base)], i
    text = rows[0][1]
    named = [text[t.start : t.end] for t in got[0].terms]
    assert {"Smithers", "Doe"} <= set(named) and "writes" not in named and "Smithers" not in got[0].text and "Doe" not in got[0].text and "[EMAIL]" in got[0].text  # Doe is far from it
    assert got[100].terms == [] and got[100].text is None and got[301].terms == []  # without the entity nothing goes
    assert "Smytherson" not in got[200].text and got[200].text.endswith(" [EMAIL] now".replace("now", got[200].text.split()[-1]))
    assert {got[200 + i].text for i in range(9)} == {got[200].text}


def test_generalised_classes(spark):
    classes = spark.createDataFrame([("Jo",), ("NASA",), ("word",), ("Ünal",), ("A",)], "w string").select(pii._class(F.col("w")).alias("c"))
    assert [r.c for r in classes.collect()] == ["[NAME]", "[ACRONYM]", "[WORD]", "[NAME]", "[NAME]"]


def test_pii_digests(spark, sf_dir, documents):
    """What the query makes of the spans."""
    got = {r.doc_id: r for r in pii.op9_pii(spark, sf_dir).collect()}
    for i, t in pairs(documents):
        spans = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == spans
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in BASE)


def test_pii_edges(empty, edge):
    assert pii.sanitise(empty).count() == 0
    assert all(r.base == [] for r in pii.sanitise(edge).collect())


# ---------------------------------------------------------------- 10


def test_exact_index(spark, edge, empty):
    index = exact.DigestIndex(spark, buckets=4)
    got = exact.exact_dedup(edge, index, "first").collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in pairs(edge):
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(i)
    assert len(got) == edge.count()
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    more = spark.createDataFrame([(50, "one two"), (51, "brand new"), (52, "Brand NEW")], "doc_id long, text string")
    again = {r.doc_id: r for r in exact.exact_dedup(more, index, "o'clock 12:30/b=%").collect()}
    assert not again[50].kept and again[50].keep_id == 3 and again[52].kept and not again[51].kept
    reopened = exact.DigestIndex(spark, index.location, 4)
    assert reopened.rows().count() == len(groups) + 1
    plan = index.new(reopened.rows())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # bucketed: read as it lies
    assert exact.exact_dedup(empty, index, "none").count() == 0
    index.compact()
    assert len(index.batches()) == 1 and index.rows().count() == len(groups) + 1
    plan = index.new(index.rows())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    third = {r.doc_id: r.kept for r in exact.exact_dedup(spark.createDataFrame([(60, "BRAND new"), (61, "yet another")], "doc_id long, text string"), index, "third").collect()}
    assert third == {60: False, 61: True}
    with exact.DigestIndex(spark, buckets=4) as other:
        kept = exact.drop_exact(edge, other, "one")
    assert kept.columns == edge.columns and kept.count() == len(groups)
    reopened.close()
    index.close(delete=True)


def test_exact_batches(spark, documents, edge, empty):
    """In several batches, the larger ids first, the rows are those of one."""
    for df in (documents, edge, empty):
        with exact.DigestIndex(spark, buckets=4) as one, exact.DigestIndex(spark, buckets=4) as many:
            want, got = exact.exact_dedup(df, one, "d"), exact.exact_dedup_batches(df, many, "d", 4)
            assert Counter(got.collect()) == Counter(want.collect())
            assert len(many.batches()) > 1 or df is empty
            assert many.rows().count() == one.rows().count()


def test_exact_batches_tried_again(spark, monkeypatch):
    """A delivery that died between its parts, tried again with other bounds, keeps what it would have; sent again
    under another name it keeps nothing."""
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    kept = lambda df: sorted(r.doc_id for r in df.collect() if r.kept)
    with exact.DigestIndex(spark, buckets=2) as index:
        quantiles = DataFrameStatFunctions.approxQuantile
        monkeypatch.setattr(DataFrameStatFunctions, "approxQuantile", lambda *_: [5.0, 20.0])
        assert kept(exact.exact_dedup_batches(rows, index, "d: 1/2")) == list(range(33, 40))
        for edges in ([30.0, 38.0], [2.0, 35.0]):
            monkeypatch.setattr(DataFrameStatFunctions, "approxQuantile", lambda *_, e=edges: e)
            assert kept(exact.exact_dedup_batches(rows, index, "d: 1/2")) == list(range(33, 40))
            assert index.rows().count() == 7
        monkeypatch.setattr(DataFrameStatFunctions, "approxQuantile", quantiles)
        assert kept(exact.exact_dedup_batches(rows, index, "second")) == []


def test_exact_retry(spark, monkeypatch):
    """A batch whose caller died, before the commit or after it, keeps its texts when it is tried again."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "B"), (None, "c")], "doc_id long, text string")
    want = [(1, True), (2, False), (3, True), (None, True)]
    order = lambda got: sorted(((r.doc_id, r.kept) for r in got), key=lambda x: (x[0] is None, x[0] or 0))
    index = exact.DigestIndex(spark, buckets=2)
    exact.exact_dedup(rows, index, "one")  # the result is never used
    assert order(exact.exact_dedup(rows, index, "one").collect()) == want
    assert not any(kept for _, kept in order(exact.exact_dedup(rows, index, "one again").collect()))
    commit = exact.DigestIndex.commit
    fresh = spark.createDataFrame([(7, "d"), (8, "a")], "doc_id long, text string")

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(exact.DigestIndex, "commit", die)
    with pytest.raises(KeyboardInterrupt):
        exact.exact_dedup(fresh, index, batch="two")
    monkeypatch.setattr(exact.DigestIndex, "commit", commit)
    for _ in range(2):
        assert order(exact.exact_dedup(fresh, index, batch="two").collect()) == [(7, True), (8, False)]
    assert order(exact.exact_dedup(fresh, index, batch="three").collect()) == [(7, False), (8, False)]
    index.close(delete=True)


def test_nothing_is_left_behind(spark, sf_dir):
    """The query's index is gone from catalog and folder; a block deletes its operators' tables."""
    before = {t.name for t in spark.catalog.listTables()}
    exact.op10_exact_dedup(spark, sf_dir).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    known = set(common._TABLES)
    with common.tidy(spark) as keep:
        inner = common.written(spark.range(3), "gone")
        stays = common.written(spark.range(3), "stays")
        keep(stays)
    assert set(common._TABLES) - known == {stays.table_path} and stays.count() == 3
    with pytest.raises(Exception, match="(?i)exist|find"):
        inner.count()
    common.forget(stays)
    assert set(common._TABLES) == known


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, sf_dir, documents):
    import corpus_pipeline as cp

    docs, kept = documents, []
    for name, stage in cp.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, sf_dir), "test-stage")
        kept.append(docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == documents.columns and docs.join(before, docs.columns, "left_anti").count() == 0
    poor, exact_, near, clean, mixed = kept
    scores = quality.quality_scores(documents, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out()))
    assert {r.doc_id for r in poor.collect()} == {r.doc_id for r in scores.filter("score >= 0.7").collect()}
    last = {}
    for i, t in sorted(pairs(poor)):
        last[t.lower()] = i
    assert {r.doc_id for r in exact_.collect()} == set(last.values())
    docs = pairs(exact_)
    sets = [model_shingles(t) for _, t in docs]
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    at = brute_components(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if alike(sets[a], sets[b])])
    least = {}
    for (i, _), c in zip(docs, at):
        least[c] = min(least.get(c, i), i)
    assert {r.doc_id for r in near.collect()} == set(least.values())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {str(r.doc_id) for r in clean.collect()} == {r[0] for r in brute_contamination(pairs(near), bench) if not r[2]}
    want = {r.doc_id: r.copies for r in mixing.mix_sources(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(want)


@pytest.fixture
def side_tables(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_edges(spark, edge, clash, empty, side_tables):
    import corpus_pipeline as cp

    for df in (edge, clash, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, df, side_tables)
            assert out.count() <= 3 * df.count()
            if name != cp.STAGES[-1][0]:
                assert out.columns == df.columns and out.exceptAll(df).count() == 0
    mixed = cp.STAGES[-1][1](spark, clash, side_tables)
    assert mixed.columns == [*clash.columns, "copy_no_"] and {r.copies for r in mixed.collect()} == {"copies"} and mixed.filter("copy_no <> 'copy_no'").count() == 0


def test_pipeline_keeps_rows_without_ids(spark, side_tables):
    """A row without an id isn't lost with another one that goes."""
    import corpus_pipeline as cp

    clean, hit = " ".join(f"clean{i}" for i in range(30)), "one two"
    df = spark.createDataFrame([(None, clean, "a"), (None, hit, "a"), (1, hit, "a"), (2, LONG, "b"), (None, LONG, "b")], "doc_id long, text string, source string")
    stage = dict(cp.STAGES)
    left = lambda name: Counter((r.doc_id, r.text) for r in stage[name](spark, df, side_tables).collect())
    assert left("exact dedup") == Counter([(None, clean), (1, hit), (2, LONG)]) == left("near dedup")
    assert left("decontamination") == Counter([(None, clean), (2, LONG), (None, LONG)])


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class C:
                        @staticmethod
                        def getCheckpointDir():
                            class N:
                                @staticmethod
                                def isDefined():
                                    return False

                            return N

                    return C

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
