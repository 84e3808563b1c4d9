"""Benchmark trials: both datasets through recorded replies, scored by case, trial and suite."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import shards as S
from ..operators.outcomes import valid_shape
from ..program import normalize_program
from ..sources.providers import EMPTY_REPLY, Provider, Reply
from . import run as R
from .suite import scripted

CHUNK = 8192


@dataclass
class ScriptedProvider(Provider):
    """A case's script: its first reply to drafts, its second to repair passes."""

    script: dict
    name = "scripted"

    def plain(self, request):
        repairing = request["prompt"].startswith("### REPAIR PASS CONTEXT")
        return Reply(self.script.get("repair" if repairing else "draft") or EMPTY_REPLY, "structured")


def programs(cases: DataFrame) -> DataFrame:
    """caseId, program (as JSON), program_hash of each case (caseId, instructions, targetSchema); a case whose
    program breaks a rule fails the job, with the rule as its message."""

    def made(batches):
        for b in batches:
            rows = []
            for case, instructions, schema in zip(*(c.to_pylist() for c in b.columns)):
                key = {"instructions": instructions, "schema": json.loads(schema) if schema else {}}
                p = replace(normalize_program(key), program_id=case)
                rows.append({"caseId": case, "program": json.dumps(asdict(p)), "program_hash": p.program_hash})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("caseId", "program", "program_hash")]))

    return cases.select("caseId", "instructions", "targetSchema").dropDuplicates(["caseId"]).mapInArrow(made, "caseId string, program string, program_hash string")


class _Cases:
    """Runs a shard with the program and the recorded reply that its row carries; a task makes each program
    once."""

    def __init__(self, options: R.Options):
        self.options, self.made = options, {}

    def __call__(self, shard: R.Shard, trial: int, program: str, program_hash: str, reply: str):
        key = (program_hash, shard.document_id)
        if key not in self.made:
            self.made[key] = replace(self.options, program=R.P.Program(**json.loads(program)))
        o = self.made[key]
        prompt = R.P.prompt_text(o.program, shard.shard_id, shard.start, shard.end, shard.text)
        shard = shard._replace(prompt_hash=hashlib.sha256(prompt.encode("utf-8", "replace")).hexdigest())
        return f"bench-{shard.document_id}-{trial}", R.ShardRun(o, ScriptedProvider(scripted(reply))), shard


def run_cases(cases: DataFrame, options: R.Options, trials: int) -> DataFrame:
    """Outcomes of all trials of a dataset's cases (caseId, documentText, instructions, targetSchema,
    providerResponseText, and trial where the recorded replies differ from trial to trial), with their trial.

    A case is a program of its own and so a run of its own.  Programs are a table: they are joined to
    the shards of their case, so all cases and trials are one wave of one job, however many they are.
    Recorded replies don't fail for a passing reason, so the wave is the only one."""
    base = options.work_dir or R.work_dir(cases.sparkSession)
    own = programs(cases)
    texts = cases.select(F.col("caseId").alias("document_id"), F.col("documentText").alias("text")).dropDuplicates(["document_id"])
    ready = R.prepare(texts, options).select("document_id", "text").join(own.withColumnRenamed("caseId", "document_id"), "document_id")
    shards = S.shard_documents(ready, F.col("program_hash"), CHUNK, 0, carry=("program", "program_hash"))
    trial = F.col("trial").cast("int") if "trial" in cases.columns else F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))
    replies = cases.select(F.col("caseId").alias("document_id"), F.col("providerResponseText").alias("reply"), trial.alias("trial")).filter(F.col("trial") < trials)
    todo = shards.join(replies, "document_id").withColumn("prompt_hash", F.lit(None).cast("string"))
    one = replace(options, retry=R.Retry(), checkpoints=None, time_budget_ms=None, all_or_nothing=False)
    out = R.waves(todo, one, _Cases(one), base, carry=("trial", "program", "program_hash", "reply"))
    return out.withColumn("trial", F.regexp_extract("run_id", r"-(\d+)\z", 1).cast("int"))


def score_cases(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each case and trial: counts, rates, coverage and success.

    cases: caseId, documentText, and either goldSpans (success: no shard failed; coverage: gold
    spans found) or expected (success: count within bounds, the kind as expected, and what that kind
    entails; coverage is success).  Quotes are checked against the text as given."""
    once = cases.drop("trial").withColumnRenamed("caseId", "document_id").dropDuplicates(["document_id"])
    keys = ["run_id", "document_id"]
    e = R.extractions_of(outcomes).join(once.select("document_id", "documentText"), "document_id")
    start, end, mode = F.col("char_start"), F.col("char_end"), F.col("offset_mode")
    shape = valid_shape(F.col("extraction_class"), F.col("quote"), mode, start, end, mode, start, end)
    quoted = F.coalesce(R.text.slice_equals(F.col("documentText"), F.col("char_start"), F.col("char_end"), F.col("quote")), F.lit(False))
    key = F.struct("extraction_class", "quote", "char_start", "char_end")
    found = e.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(shape).alias("well"), F.count_if(quoted).alias("exact"), F.collect_set(key).alias("keys"))
    trial = outcomes.groupBy(*keys).agg(F.min("trial").alias("trial"))
    d = R.diagnostics_of(outcomes).select(*keys, "failed_shards", "empty_kind").join(trial, keys)
    c = once.join(d, "document_id").join(found, keys, "left").fillna(0, ["n", "well", "exact"])
    n, failed, kind = F.col("n"), F.col("failed_shards"), F.col("empty_kind")
    if "goldSpans" in cases.columns:
        gold = F.array_distinct(F.transform("goldSpans", lambda g: F.struct(g["extractionClass"].alias("extraction_class"), g["quote"].alias("quote"), g["charStart"].alias("char_start"), g["charEnd"].alias("char_end"))))
        matched = F.size(F.array_intersect(gold, F.coalesce("keys", F.slice(gold, 1, 0))))
        success, coverage, dataset = failed == 0, M.rate(matched, F.size("goldSpans")), "smoke"
    else:
        want = F.col("expected.emptyResultKind")
        entailed = F.when(want == "empty_by_failure", (failed > 0) & (n == 0)).when(want == "empty_by_evidence", (failed == 0) & (n == 0)).otherwise(n > 0)
        success = n.between(F.col("expected.minExtractions"), F.col("expected.maxExtractions")) & (kind == want) & entailed
        coverage, dataset = success.cast("double"), "regression"
    return c.select(
        "trial", F.lit(dataset).alias("dataset"), F.col("document_id").alias("case_id"), n.alias("extraction_count"), success.alias("success"), M.rate(F.col("well"), n).alias("schema_validity_rate"),
        M.rate(F.col("exact"), n).alias("quote_invariant_pass_rate"), coverage.alias("coverage_rate"), failed.alias("failures"), kind.alias("empty_kind"),
    )


def run_trials(datasets: list[DataFrame], options: R.Options, trials: int) -> DataFrame:
    """Scores of all cases of all datasets over ``trials`` trials; the number of jobs is that of datasets, whatever
    they hold."""
    parts = [score_cases(cases, run_cases(cases, options, trials)) for cases in datasets]
    return reduce(DataFrame.unionByName, parts)


def summary(scores: DataFrame) -> DataFrame:
    """The suite's one row: unweighted means over trials of means over cases, spreads and drift."""
    rates = ["success_rate", "schema_validity_rate", "quote_invariant_pass_rate", "coverage_rate"]
    s = scores.withColumn("success_rate", F.col("success").cast("double"))
    by_trial = s.groupBy("trial").agg(*(F.avg(r).alias(r) for r in rates), F.sum("extraction_count").alias("extraction_count"))
    total = by_trial.agg(*(F.avg(r).alias(r) for r in rates), F.var_pop("extraction_count").alias("extraction_count_variance"), F.stddev_pop("success_rate").alias("success_rate_std_dev"))
    signature = F.concat_ws("|", F.col("success").cast("string"), F.col("extraction_count").cast("string"), "empty_kind", F.col("failures").cast("string"))
    drift = M.drift(s.select(F.col("trial").alias("run"), F.concat_ws("/", "dataset", "case_id").alias("case_id"), signature.alias("signature")), s.select(F.col("trial").alias("run"))).withColumnRenamed("drift_rate", "case_outcome_drift_rate")
    cases = s.agg(F.count_distinct("dataset", "case_id").alias("total_case_count"))
    return total.crossJoin(drift).crossJoin(cases)


def write_result(result: DataFrame, path: str) -> None:
    """A suite's summary as JSON, for the gates of another process."""
    result.coalesce(1).write.mode("overwrite").json(path)
