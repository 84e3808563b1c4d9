"""The inverted join of signature coordinates against all pairs by brute force, and its edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, minhash, near
from tests.llm.test_llm import SCHEMA, brute_components, clash, edge, empty  # noqa: F401


def model_set(text, k=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def model(rows):
    """doc_id, set size, least id reached, kept of each row; all pairs."""
    sets = [model_set(t) for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links.append((a, b))
    at, least = brute_components(len(rows), links), {}
    for (i, _), c in zip(rows, at):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, len(s), least.get(c), i == least.get(c)) for (i, _), s, c in zip(rows, sets, at)), key=str), links


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_groups(df).collect()), key=str)


def planted(seed=5):
    """Chains of texts a few words apart, crowds around one text at 0.6 to 1, texts that share most of a
    passage, pairs at 0.8 exactly and just below."""
    rng = np.random.default_rng(seed)
    rows = []
    for base in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for _ in range(5):
            rows.append(" ".join(words))
            words = list(words)
            for at in rng.integers(0, 60, 1 + base % 4):
                words[at] = f"new{len(rows)}x{at}"
    shared = [f"s{i}" for i in range(100)]
    for i in range(60):
        words = list(shared)
        for at in rng.integers(0, 100, i % 16):
            words[at] = f"m{i}x{at}"
        rows.append(" ".join(words).upper() if i % 2 else "\t".join(words))
    for i in range(30):
        rows.append(" ".join(shared[:30] + [f"own{i}x{j}" for j in range(i)]))
    rows += ["a b c d e f g h i j", "a b c d e f g h i z", "one two three four five six", "one two three four five", "x", "X", "x y", "x  y "]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("crowd", [1, 32])
def test_like_brute_force(spark, edge, monkeypatch, crowd):  # noqa: F811
    monkeypatch.setattr(near, "CROWD", crowd)
    rows = planted() + [(r.doc_id if r.doc_id is None else 1000 + r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    want, links = model(rows)
    assert len(links) > 300
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, links = model([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert links and sorted(map(tuple, minhash.op11_minhash(spark, sf_dir).collect()), key=str) == want


def test_edges(clash, empty):  # noqa: F811
    assert got(empty) == []
    want, _ = model([(r.doc_id, r.text) for r in clash.select("doc_id", "text").collect()])
    rows = got(clash)
    assert rows == [(i, n, c, k) if i is not None or c is not None else (i, n, c, True) for i, n, c, k in want]


def test_prefixes_meet(spark):
    """Nodes that have enough coordinates in common share a posting; no node is under more than it may."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, (64, 6))
    rows = [(i, [int(pool[c][rng.integers(0, 6) if i % 3 else i % 6 if rng.random() < 0.7 else rng.integers(0, 6)]) for c in range(64)]) for i in range(60)]
    nodes = common.written(spark.createDataFrame(rows, "node long, keys array<long>").withColumn("size", F.lit(1)), "t")
    lists = {}
    for r in minhash.prefix_postings(nodes, 32).collect():
        lists.setdefault(r.node, set()).add(r.k)
    assert all(len(v) <= 33 for v in lists.values())
    for i, a in rows:
        for j, b in rows[:i]:
            if sum(x == y for x, y in zip(a, b)) >= 32:
                assert lists[i] & lists[j]


def test_a_list_of_one_component_makes_no_pairs(spark):
    """A list's largest component meets the others alone: n members of which one is apart make n - 1 pairs."""
    members = spark.createDataFrame([(7, i, 10, 0 if i < 500 else 500, 0, False) for i in range(501)], "k long, node long, size long, root long, main long, crowd boolean")
    assert near.open_pairs(members).count() == 500
