"""Evaluation: repeated runs over cases, and what their agreement says."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.shards import shard_documents
from ..program import Program, prompt_column, request_hash_column
from ..sources.providers import Provider, ReplayProvider
from . import run as R


def recorded(cases: DataFrame, program: Program, model: str, size: int, overlap: int, structured: bool = True) -> DataFrame:
    """request_hash, channel, text: for every shard of every case (document_id, text, reply) the
    reply that its draft request gets."""
    shards = shard_documents(cases.select("document_id", "text"), program.program_hash, size, overlap).join(cases.select("document_id", "reply"), "document_id")
    prompt = prompt_column(program, F.col("shard_id"), F.col("start"), F.col("end"), F.col("text"))
    return shards.select(request_hash_column(program, model, prompt).alias("request_hash"), F.lit("structured" if structured else "text").alias("channel"), F.col("reply").alias("text"))


def scripted(reply: str) -> dict:
    """A case's recorded reply: a plain text, or a script with a reply for each pass (kind
    multi_pass_v1: draft, repair, failureKind) or each channel (structured_split_v1: generate,
    generateStructured)."""
    try:
        script = json.loads(reply)
    except ValueError:
        script = None
    if isinstance(script, dict) and script.get("kind") == "multi_pass_v1":
        return {"draft": script.get("draft", ""), "repair": script.get("repair", ""), "failure_kind": script.get("failureKind")}
    if isinstance(script, dict) and script.get("kind") == "structured_split_v1":
        return {"draft": script.get("generateStructured", ""), "plain": script.get("generate", ""), "repair": script.get("generateStructured", "")}
    return {"draft": reply, "repair": reply}


def run_suite(cases: DataFrame, options: R.Options, provider: Provider | list[Provider], runs: int, labels: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """``runs`` runs over cases (document_id, text).  Returns keys (run, case_id, key), cases (run,
    case_id, failed), runs with their labels, and report (one row).

    ``provider``: one for all runs, or a list of which each run takes one in turn.  A run of a suite is the legacy run: texts as given, extractions as they come.  Labels name runs
    in turn; they don't reach the provider."""
    spark = cases.sparkSession
    keys = failed = None
    for i in range(runs):
        o = replace(options, run_id=f"{options.run_id}-{i}", legacy=True)
        out, _ = R.run_with_evidence(cases, o, provider[i % len(provider)] if isinstance(provider, list) else provider)
        n = F.lit(i).alias("run")
        e = R.extractions_of(out, legacy=True).select(n, F.col("document_id").alias("case_id"), F.concat_ws("|", "extraction_class", F.col("char_start").cast("string"), F.col("char_end").cast("string"), "quote").alias("key"))
        f = out.groupBy(F.col("document_id").alias("case_id")).agg(F.max(F.col("status") == "failure").alias("failed")).select(n, "case_id", "failed")
        keys, failed = (e, f) if keys is None else (keys.unionByName(e), failed.unionByName(f))
    labels = labels or {}
    table = spark.range(runs).select(F.col("id").cast("int").alias("run"), *(M.label(labels.get(k, []), F.col("id"), p).alias(k) for k, p in (("provider", "provider"), ("prompt_variant", "default"), ("seed", "seed"))))
    good = keys.join(failed.filter("NOT failed").select("run", "case_id"), ["run", "case_id"])
    runs_df = table.select("run")
    sizes = M.run_keys(good, runs_df)
    report = (
        M.stability(M.pairwise_jaccard(good, runs_df))
        .crossJoin(M.drift(M.case_fingerprints(good, failed), runs_df))
        .crossJoin(sizes.agg(F.min("n").alias("min_extractions"), F.max("n").alias("max_extractions"), F.avg("n").alias("mean_extractions"), F.var_pop("n").alias("extraction_count_variance"), F.stddev_pop("n").alias("extraction_count_std_dev")))
        .crossJoin(failed.agg(M.rate(F.count_if(~F.col("failed")), F.count("*")).alias("success_rate")))
        .crossJoin(M.breadth(table, ["provider", "prompt_variant", "seed"]))
    )
    return {"keys": keys, "cases": failed, "runs": table, "report": report}


def replay_provider(records: DataFrame) -> ReplayProvider:
    """A provider from few recordings (a test's or a benchmark's); many are joined instead."""
    rows = records.select("request_hash", "channel", "text").collect()
    pick = lambda c: {r.request_hash: r.text for r in rows if r.channel == c}
    return ReplayProvider(pick("text"), pick("structured"))


