"""Passages found by keys: items of any length against a plain search, plans without pairs of all with all."""

import random

from pyspark.sql import functions as F

from lodestar.operators import passages as PA
from lodestar.operators import shards as S


def every(text, quote):
    return [i for i in range(len(text)) if text.startswith(quote, i)]


def test_items_of_any_length(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "cab", "b", "xaby", "aa", "a", "zz\nz", "qu.ot[e", "\\E", "ab"]
    docs = [(f"d{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for i in range(25)]
    items = ["a", "aa", "b c", "ab ab", "c a", "abc cab b", "xaby aa a", "ab abc cab b xaby", "\\E a", "qu.ot[e", "zz\nz ab", "z", "not there", "ab aa b aa a"] + [docs[3][1][40:180], docs[4][1][3:19], docs[5][1][7:16], docs[6][1][:900]]
    want = {(d, i, at) for d, t in docs for i, q in enumerate(items) if q for at in every(t, q)}
    d = spark.createDataFrame(docs, "document_id string, text string")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(items) if x], "item_id int, q string")
    for broadcast in (PA.BROADCAST_BYTES, 0):
        got = PA.find_passages(d, q, "0" * 64, 300, 50, broadcast)
        assert {(r.document_id, r.item_id, r.char_start) for r in got.collect()} == want
    assert len(want) > 1000 and PA.find_passages(d, q.limit(0), "0" * 64).count() == 0
    kinds = {r.item_id: r.kind for r in PA.item_keys(q).collect()}
    assert {kinds[0], kinds[1], kinds[7], kinds[9]} == {1, 2, 0, 4}


def test_one_equi_join(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    items = spark.createDataFrame([(1, "the"), (2, "a b"), (3, "one two three four five")], "item_id int, q string")
    plan = PA.candidates(d, items)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    plan = PA.candidates(d, items, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Cross" not in plan


def test_grams(spark):
    r = spark.range(1).select(PA.grams(F.lit("ab🙂\ncd"), 2).alias("g"), PA.grams(F.lit("a"), 2).alias("none"), S.occurrences(F.lit("aaaa"), F.lit("aa")).alias("o"), S.occurrences(F.lit("xaba🙂aba"), F.lit("aba")).alias("p"), S.occurrences(F.lit("x"), F.lit("y")).alias("n")).first()
    assert r.g == ["ab", "b🙂", "🙂\n", "\nc", "cd"] and r.none == [] and r.o == [0, 1, 2] and r.p == [1, 6] and r.n == []
