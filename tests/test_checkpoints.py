"""The checkpoint store: latest values, versions that never came to their end, prefixes that prune files."""

import os
import shutil

from pyspark.sql import functions as F

from lodestar.plans import run as R
from lodestar.plans.queries import PROGRAM, _first_word
from lodestar.sources import providers as PR
from lodestar.sources.checkpoints import CheckpointStore


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    store = CheckpointStore(spark, at, "v int", buckets=4)
    put = lambda *kv: spark.createDataFrame(list(kv), "key string, v int")
    assert rows(store.read()) == [] and store.versions() == []
    assert store.commit(put(("a/1", 1), ("a/2", 2), ("b/1", 3), ("a\U0010ffff", 9), ("ab", 7))) == 1
    assert store.commit(put(("a/2", 20), ("c", 5), ("c", 5))) == 2
    store.delete(put(("b/1", 0)))
    assert rows(store.read()) == [("a/1", 1), ("a/2", 20), ("ab", 7), ("a\U0010ffff", 9), ("c", 5)]
    assert rows(store.list("a/")) == [("a/1", 1), ("a/2", 20)] and rows(store.list("b")) == [] and len(rows(store.list("a"))) == 4
    assert rows(store.list("a\U0010ffff")) == [("a\U0010ffff", 9)] and rows(store.get("c")) == [("c", 5)] and len(rows(store.list(""))) == 5
    # a writer that died: files without the mark
    put(("a/1", -1)).write.parquet(f"{at}/version=000000004")
    os.remove(f"{tmp_path}/store/version=000000004/_SUCCESS")
    assert rows(store.get("a/1")) == [("a/1", 1)] and store.versions() == [1, 2, 3]
    assert store.commit(put(("d", 1))) == 4 and rows(store.get("a/1")) == [("a/1", 1)]
    before = rows(store.read())
    store.compact()
    assert rows(store.read()) == before and store.versions() == [4] and len([n for n in os.listdir(f"{tmp_path}/store") if n.startswith("version")]) == 1
    assert store.commit(put(("a/1", 100))) == 5
    # a compaction that died behind its mark: the old versions lie there still
    shutil.copytree(f"{tmp_path}/store/version=000000005", f"{tmp_path}/kept")
    store.compact()
    shutil.copytree(f"{tmp_path}/kept", f"{tmp_path}/store/version=000000005")
    assert store.versions() == [5] and len(rows(store.read())) == len(before)
    store.compact()
    assert len([n for n in os.listdir(f"{tmp_path}/store") if n.startswith("version")]) == 1
    assert rows(CheckpointStore(spark, at, "v int").read()) == sorted([r for r in before if r[0] != "a/1"] + [("a/1", 100)])


def test_a_prefix_reads_few_files(spark, tmp_path):
    """Keys lie by range: what a prefix lists is in one file or two, and its bounds reach the scan."""
    store = CheckpointStore(spark, f"file://{tmp_path}/s", "v long", buckets=8)
    store.commit(spark.range(8000).select(F.format_string("run%d:%05d", (F.col("id") / 1000).cast("int"), F.col("id")).alias("key"), F.col("id").alias("v")))
    listed = store.list("run3:")
    assert listed.count() == 1000
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,run3:)" in plan and "LessThan(key,run3;)" in plan and "StringStartsWith(key,run3:)" in plan
    files = spark.read.parquet(f"file://{tmp_path}/s/version=000000001").filter("key >= 'run3:' AND key < 'run3;'").select(F.input_file_name()).distinct().count()
    assert files <= 3


def test_a_run_that_dies_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"word{i} " + "x " * 300) for i in range(20)], "document_id string, text string")

    def die(version):
        if version == 2:
            raise KeyboardInterrupt

    options = lambda **more: R.Options("r", PROGRAM, chunk_size=100, checkpoints=f"file://{tmp_path}/store", work_dir=f"file://{tmp_path}/work", commits=4, created_at="t", **more)
    try:
        R.run_with_evidence(docs, options(after_commit=die), PR.RuleProvider(_first_word))
        raise AssertionError("it should have died")
    except KeyboardInterrupt:
        pass
    out, made = R.run_with_evidence(docs, options(), PR.RuleProvider(_first_word))
    whole, want = R.run_with_evidence(docs, R.Options("r", PROGRAM, chunk_size=100, work_dir=f"file://{tmp_path}/other", created_at="t"), PR.RuleProvider(_first_word))
    n = out.count()
    assert n == whole.count() and 0.3 * n < out.filter("from_checkpoint").count() < 0.7 * n
    pick = lambda df: rows(df.select("shard_id", "status", F.to_json("extractions")))
    assert pick(out) == pick(whole)
    third, _ = R.run_with_evidence(docs, options(), PR.RuleProvider(_first_word))
    assert third.filter("NOT from_checkpoint").count() == 0


def test_shards_are_made_once(spark, tmp_path):
    """A wave committed in parts reads its shards from a table: what makes them is not worked through for each part."""
    from pyspark.sql import functions as F

    from lodestar.plans import run as R
    from lodestar.program import normalize_program
    from lodestar.sources import providers as PR

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    program = normalize_program({"instructions": "x", "schema": {"type": "object"}, "classes": [{"name": "w"}]})
    o = R.Options("r", program, chunk_size=64, overlap=0, checkpoints=f"file://{tmp_path}/store", commits=4, work_dir=f"file://{tmp_path}/work", created_at="t")
    docs = spark.createDataFrame([(str(i), f"word{i} " * 20) for i in range(20)], "document_id string, text string").withColumn("text", seen("text"))
    out, _ = R.run_with_evidence(docs, o, PR.RuleProvider(lambda request: '{"extractions":[]}'))
    assert out.select("document_id").distinct().count() == 20 and made.value <= 3 * 20
