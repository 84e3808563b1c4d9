"""Manifests and proofs against a model that builds the trees node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, merkle
from tests.llm.test_llm import LONG, SCHEMA, clash, edge, empty  # noqa: F401
from tests.oracle import connect

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def build(nodes):
    """The root, and for each node the siblings to the left and right, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a // 3 * 3
            run = nodes[lo : lo + 3]
            paths[i].append((run[: a - lo], run[a - lo + 1 :]))
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [a // 3 for a in at]
    return (nodes or [None])[0], paths


def model(rows):
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    leaves = {}
    for r in rows:
        leaf = H(*map(value, r))
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        leaves.setdefault(r[1], []).append((key(r[0]), leaf, r[0], H(*map(value, (*r[:4], r[4].replace("\n", "")))) if bad else leaf))
    names = sorted(leaves, key=key)
    trees = {s: build([x[1] for x in sorted(leaves[s])]) for s in names}
    root, above = build([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (_, leaf, doc_id, again), path in zip(sorted(leaves[s]), trees[s][1]):
            fold = again
            for left, right in path + up:
                fold = H(*left, fold, *right)
            out.append((doc_id, leaf, trees[s][0], root, H(*(x for side in path + up for part in side for x in part)), fold, fold == root))
    return sorted(out, key=str)


def got(df, **how):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows, sources = merkle.manifest(df, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), **how)
    p = F.col("path")
    rows = rows.withColumns({"proof": F.sha2(merkle.siblings(p), 256), "fold": merkle.folded(F.col("again"), p)})
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.fold, r.fold == r.root) for r in rows.collect()), key=str), sources


def test_rows_equal_sql_and_model(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    out = sorted(map(tuple, merkle.op13_merkle(spark, sf_dir).collect()), key=str)
    assert out == model([tuple(r) for r in rows])
    assert out == sorted(connect(sf_dir).sql(merkle.SQL).fetchall(), key=str)
    assert {r[-1] for r in out} == {True, False}


@pytest.mark.parametrize("levels,call_rows", [(1, 10), (2, 50), (8, 1 << 15)])
def test_blocks_of_any_height(spark, levels, call_rows):
    """Sources of 1 to 100 rows, one of them with most rows: blocks in several tiers, the last ones short."""
    rows = []
    for s, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 100)):
        rows += [(1000 * s + 7 * i % 997, f"s{s}" if s else None, "xx", i, f"line {i}\nof {s}" if i % 3 else f"row {i}") for i in range(n)]
    out, sources = got(spark.createDataFrame(rows, DOCS).repartition(4), levels=levels, call_rows=call_rows)
    assert out == model(rows)
    assert {r.source: r.rows for r in sources.collect()} == {(f"s{s}" if s else None): n for s, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 100))}


def test_nulls_ties_and_sources_by_bytes(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (1, "a", "l", 3, "x\ny"), (1, "a", "l", 3, "x\ny"), (1, "a", None, 3, "other"), (2, "a", "l", None, ""), (2, "a", "l", None, None), (-5, "Z", "-", 0, "-"),
        (3, "é", "l", 1, "🙂\n"), (4, "", "l", 1, LONG * 50), (5, "\U0001f642", "l", 1, "a\r\nb"), (6, "￮", "l", 1, "n\n\nn"),
    ]
    out, sources = got(spark.createDataFrame(rows, DOCS).repartition(3), levels=1)
    assert out == model(rows)
    assert sources.count() == 7


def test_edges(spark, clash, empty):  # noqa: F811
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in clash.collect()]
    extra = clash.withColumns({c: F.lit(c) for c in ("tree", "pos", "size", "part", "path", "root", "leaf", "block", "levels", "call", "row_nr", "again")})
    assert got(extra)[0] == model(rows)
    out, sources = got(empty)
    assert out == [] and sources.count() == 0


def test_a_large_source_spreads(spark):
    """Places within one source are right over many ranges of equal ids."""
    df = spark.range(5000).select(F.lit("one").alias("g"), (F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    rows = common.positions(df, "g", ["k", "v"])
    assert [r.v for r in rows.orderBy("pos").collect()] == sorted(range(5000), key=lambda i: (i % 7, i))
    assert rows.agg(F.min("size"), F.max("size"), F.count_distinct("pos")).first() == (5000, 5000, 5000)
    same = common.positions(spark.range(2000).select(F.lit("one").alias("g"), F.lit(1).alias("k")), "g", ["k"])
    assert sorted(r.pos for r in same.collect()) == list(range(2000))


def test_depth():
    size = [1, 2, 3, 4, 9, 10, 27, 28, 3**20, 3**20 + 1]
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(s,) for s in size], "s long").select(merkle.levels_of(F.col("s")).alias("d")).collect()
    assert [r.d for r in rows] == [0, 1, 1, 2, 2, 3, 3, 4, 20, 21]


def test_crc32_in_sql():
    import duckdb

    for text in ("7", "123:45", "abc"):
        assert duckdb.sql(f"SELECT {common.crc32_sql(repr(text))}").fetchall() == [(zlib.crc32(text.encode()),)]
