"""The evidence run: shards through a provider, with checkpoints, retries, budgets and bundles."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import program as P
from .. import schemas
from ..functions import envelope, text
from ..functions.envelope import Failure
from ..functions.salvage import Budget
from ..operators import outcomes as O
from ..operators import shards as S
from ..sources.checkpoints import CheckpointStore
from ..sources.providers import Provider, is_transient
from ..sources.storage import work_dir


@dataclass(frozen=True)
class Retry:
    attempts: int = 1
    base_ms: int = 0
    most_ms: int = 0
    jitter: float = 0.0

    def __post_init__(self):
        if self.attempts < 1 or self.base_ms < 0 or self.most_ms < self.base_ms or not 0 <= self.jitter <= 1:
            raise ValueError("a retry policy needs attempts >= 1, 0 <= base <= most, 0 <= jitter <= 1")

    def delay_ms(self, attempt: int, random: float) -> float:
        wait = min(self.most_ms, self.base_ms * 2 ** max(0, attempt - 1))
        return wait + int(wait * self.jitter * min(1.0, max(0.0, random)) + 0.5)


@dataclass
class Options:
    """chunk_size and overlap in UTF-16 units.  time_budget_ms is checked before each wave of
    attempts; a shard that no wave reached fails as budget_exhausted.  all_or_nothing raises after
    the wave in which a shard failed.  legacy: neither normalise nor order and dedupe.

    checkpoints: folder of a store of outcomes (:class:`CheckpointStore`); a wave is run and committed in
    ``commits`` parts, and a run that dies resumes behind the last of them.  after_commit gets the number of each
    version."""

    run_id: str
    program: P.Program
    model: str = "model"
    chunk_size: int = 8192
    overlap: int = 0
    max_passes: int = 2
    retry: Retry = Retry()
    budget: Budget = Budget()
    time_budget_ms: int | None = None
    all_or_nothing: bool = False
    trim: bool = False
    legacy: bool = False
    checkpoints: str | None = None
    commits: int = 1
    after_commit: Callable[[int], None] | None = None
    work_dir: str | None = None
    random: Callable[[], float] = lambda: 0.0
    sleep: Callable[[float], None] = time.sleep
    clock_ms: Callable[[], float] = lambda: time.time() * 1000
    created_at: str | None = None
    partitions: int | None = None

    def __post_init__(self):
        S.check_options(self.chunk_size, self.overlap)
        if self.commits < 1:
            raise ValueError("commits must be a positive integer")
        if self.max_passes < 1:
            raise ValueError("max_passes must be a positive integer")
        if self.time_budget_ms is not None and self.time_budget_ms < 0:
            raise ValueError("time_budget_ms must not be negative")


def checkpoint_key(run_id, shard_id):
    return F.concat(F.lit("ckpt:v1:"), run_id, F.lit(":"), shard_id)


def prepare(docs: DataFrame, o: Options) -> DataFrame:
    """document_id, text (normalised unless legacy), text_hash of the text as given, ledger."""
    given = F.coalesce(F.col("text"), F.lit(""))
    made = docs.select(text.document_id(F.col("document_id").cast("string"), given).alias("document_id"), given.alias("raw"))
    made = made.withColumn("n", text.normalize_text("raw", o.trim))
    ledger = F.slice("n.ledger", 1, 0) if o.legacy else F.col("n.ledger")
    return made.select("document_id", (F.col("raw") if o.legacy else F.col("n.text")).alias("text"), F.sha2("raw", 256).alias("text_hash"), ledger.alias("ledger"))


class Shard(NamedTuple):
    document_id: str
    shard_id: str
    shard_index: int
    start: int
    end: int
    text: str
    prompt_hash: str


@dataclass
class ShardRun:
    """One attempt at one shard: draft, then repair passes while a failure can be mended."""

    options: Options
    provider: Provider
    stages: list = field(default_factory=list)

    def stage(self, number: int, stage: str, status: str, kind: str | None, message: str) -> None:
        self.stages.append({"pass": number, "stage": stage, "status": status, "failure_kind": kind, "message": message})

    def __call__(self, shard) -> dict:
        o = self.options
        prompt = first_prompt = P.prompt_text(o.program, shard.shard_id, shard.start, shard.end, shard.text)
        log, failure, number, record = None, None, 0, None
        for number in range(1, o.max_passes + 1):
            try:
                reply = self.provider.answer(P.request(o.program, o.model, prompt))
            except Exception as e:  # whatever a provider raises is an outcome
                return self.failed("provider_error", str(e), type(e).__name__, is_transient(e), 0, None, [])
            record = reply.record
            self.stage(number, "draft", "ok", None, "A reply was received.")
            try:
                raws, log = envelope.read_reply(reply.text, budget=o.budget)
                found = envelope.ground(raws, shard.text, shard.start, shard.end, shard.start)
                self.stage(number, "validate", "ok", None, "The reply is valid.")
                self.stage(number, "finalize", "ok", None, "Extractions were emitted.")
                return {"status": "success", "retryable": False, "final_pass": number, "extractions": [e.row() for e in found], "stages": self.stages, "repair": envelope.flat_log(log), "record": record}
            except Failure as e:
                failure = e
                log = e.log or log
                self.stage(number, "validate", "error", e.kind, f"The reply is not valid: {e.message}")
                if number == o.max_passes or e.kind not in envelope.REPAIRABLE:
                    break
                self.stage(number, "repair", "ok", e.kind, "A repair pass follows.")
                prompt = P.repair_text(first_prompt, reply.text, e.kind, e.message, number)
        return self.failed(failure.kind, failure.message, "Failure", False, o.max_passes, log, self.stages)

    def failed(self, kind, message, name, retryable, final, log, stages) -> dict:
        return {"status": "failure", "failure_kind": kind, "failure_message": message, "error_name": name, "retryable": retryable, "final_pass": final, "extractions": [], "stages": stages, "repair": envelope.flat_log(log)}


#: Makes of a shard, and of what ``carry`` names beside it, the run's id, the attempt and the shard's own row.
Runner = Callable[..., tuple[str, ShardRun, Shard]]


def _attempt(attempt: int, layout: pa.Schema, runner: Runner, carry: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(f).to_pylist() for f in (*Shard._fields, *carry))):
                run_id, one, shard = runner(Shard._make(values[: len(Shard._fields)]), *values[len(Shard._fields) :])
                base = {"run_id": run_id, "from_checkpoint": False, "attempts": attempt, "max_passes": one.options.max_passes}
                rows.append(base | {k: v for k, v in shard._asdict().items() if k != "text"} | one(shard))
            yield pa.RecordBatch.from_pylist(rows, layout)

    return run


def _out_of_time(o: Options, shards: DataFrame, tried: int) -> DataFrame:
    message = "Run time budget exhausted before " + ("shard execution." if tried == 0 else "provider attempt.")
    values = {"run_id": F.lit(o.run_id), "status": F.lit("failure"), "from_checkpoint": F.lit(False), "attempts": F.lit(tried), "failure_kind": F.lit("budget_exhausted"), "failure_message": F.lit(message), "error_name": F.lit("BudgetExhausted"), "retryable": F.lit(False), "final_pass": F.lit(tried), "max_passes": F.lit(o.max_passes)}
    stage = F.array(F.struct(F.lit(tried).alias("pass"), F.lit("draft").alias("stage"), F.lit("error").alias("status"), F.lit("budget_exhausted").alias("failure_kind"), F.lit(message).alias("message")))
    return fill(shards.withColumns(values | {"stages": stage}))


def fill(df: DataFrame) -> DataFrame:
    """``df`` in the layout of outcomes, members it lacks being null."""
    layout = df.sparkSession.createDataFrame([], schemas.OUTCOME).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in layout))


def _store(df: DataFrame, path: str) -> DataFrame:
    """Written once and read back: a provider is never asked twice for one result, whatever Spark
    computes anew."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def execute(docs: DataFrame, o: Options, provider: Provider) -> DataFrame:
    """Outcomes of all shards of ``docs`` (as :func:`prepare` makes them).

    Checkpointed shards are taken as they are.  The others go through waves of attempts: a wave runs
    all pending shards in parallel and is written once; shards that failed for a passing reason go
    to the next wave, after the policy's delay.  Successes are committed to the checkpoints, under keys
    that begin with the run's id, so that a later run of the same id resumes."""
    spark = docs.sparkSession
    base = o.work_dir or work_dir(spark)
    shards = S.shard_documents(docs.select("document_id", "text"), o.program.program_hash, o.chunk_size, o.overlap)
    shards = shards.withColumn("prompt_hash", F.sha2(P.prompt_column(o.program, F.col("shard_id"), F.col("start"), F.col("end"), F.col("text")), 256))
    done = checkpoints(spark, o)
    todo = O.pending(shards, done, ["shard_id"]) if done is not None else shards
    parts = []
    if done is not None:
        known = shards.select("document_id", "shard_id", "shard_index", "start", "end", "prompt_hash").join(done.drop("document_id", "shard_index", "start", "end", "prompt_hash"), "shard_id")
        parts.append(fill(known.withColumns({"from_checkpoint": F.lit(True), "attempts": F.lit(0)})))
    todo = todo.repartition(o.partitions) if o.partitions else todo
    return waves(todo, o, lambda shard: (o.run_id, ShardRun(o, provider), shard), base, parts)


def waves(todo: DataFrame, o: Options, runner: Runner, base: str, parts: list[DataFrame] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Outcomes of ``todo`` (the fields of Shard, and ``carry``: shard_id tells rows apart), behind ``parts``, in as
    many waves as there are attempts to be made."""
    spark, parts = todo.sparkSession, parts or []
    layout = to_arrow_schema(spark.createDataFrame([], schemas.OUTCOME).schema)
    began, attempt = o.clock_ms(), 0
    while True:
        if o.time_budget_ms is not None and o.clock_ms() - began >= o.time_budget_ms:
            parts.append(_out_of_time(o, todo, attempt))
            break
        attempt += 1
        path, parts_of_wave = f"{base}/wave-{uuid.uuid4().hex}", o.commits if o.checkpoints else 1
        if parts_of_wave > 1:  # shards are made once, not once for each part
            todo.withColumn("part", F.pmod(F.xxhash64("shard_id"), F.lit(parts_of_wave)).cast("int")).write.partitionBy("part").parquet(f"{path}-todo")
            dealt = spark.read.schema(StructType([*todo.schema, StructField("part", IntegerType())])).parquet(f"{path}-todo")
            todo = dealt.drop("part")
        for part in range(parts_of_wave):
            some = todo if parts_of_wave == 1 else dealt.filter(F.col("part") == part).drop("part")
            wave = _store(some.mapInArrow(_attempt(attempt, layout, runner, carry), schemas.OUTCOME), f"{path}/part={part}")
            if o.checkpoints:
                version = store(spark, o).commit(wave.filter("status = 'success'").withColumn("key", checkpoint_key(F.col("run_id"), F.col("shard_id"))))
                if o.after_commit:
                    o.after_commit(version)
        wave = spark.read.schema(schemas.OUTCOME).parquet(path).drop("part")
        last = attempt >= o.retry.attempts
        parts.append(wave if last else wave.filter("NOT retryable OR status = 'success'"))
        again = wave.filter("status = 'failure' AND retryable")
        if o.all_or_nothing and (bad := wave.filter("status = 'failure'" + ("" if last else " AND NOT retryable")).orderBy("document_id", "shard_index").first()):
            raise RuntimeError(f"shard {bad.shard_id} failed: {bad.failure_message}")
        if last or again.isEmpty():
            break
        if (wait := o.retry.delay_ms(attempt, o.random())) > 0:
            o.sleep(wait / 1000)
        todo = todo.join(again.select("shard_id"), "shard_id", "left_semi")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def store(spark, o: Options) -> CheckpointStore:
    return CheckpointStore(spark, o.checkpoints, schemas.OUTCOME)


def checkpoints(spark, o: Options) -> DataFrame | None:
    """Checkpointed outcomes of this run, one for each shard; None without a store."""
    return store(spark, o).list(f"ckpt:v1:{o.run_id}:").drop("key") if o.checkpoints else None


# ---------------------------------------------------------------- roll-ups


def extractions_of(outcomes: DataFrame, legacy: bool = False) -> DataFrame:
    """run_id, document_id and the fields of each extraction; one for each identity unless legacy."""
    flat = outcomes.select("run_id", "document_id", F.explode("extractions").alias("e")).select("run_id", "document_id", "e.*")
    return flat if legacy else S.dedupe(flat, ["run_id", "document_id"])


def diagnostics_of(outcomes: DataFrame) -> DataFrame:
    counted = outcomes.withColumn("n_extractions", F.coalesce(F.size("extractions"), F.lit(0)))
    return O.diagnostics(counted, ["run_id", "document_id"])


def budget_hits(outcomes: DataFrame) -> DataFrame:
    hit = lambda c: F.count_if(F.coalesce(F.col(f"repair.{c}"), F.lit(False)))
    return outcomes.groupBy("run_id", "document_id").agg(hit("candidate_truncated").alias("candidate_chars_truncated"), hit("repair_truncated").alias("repair_chars_truncated"))


def repair_log(outcomes: DataFrame) -> DataFrame:
    """One row for each shard with a reading log; the reply itself isn't in it."""
    r = outcomes.filter("repair IS NOT NULL")
    ok = F.col("status") == "success"
    return r.select("run_id", "document_id", "shard_id", F.col("final_pass").alias("pass"), ok.alias("parse_ok"), "repair.changed", F.col("repair.applied").alias("applied_steps"), "repair.candidate_truncated", "repair.repair_truncated")


def stage_log(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("run_id", "document_id", "shard_id", F.posexplode("stages").alias("nth", "s")).select("run_id", "document_id", "shard_id", "nth", "s.*")


def failures_of(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("status = 'failure'").select("run_id", "document_id", "shard_id", F.col("failure_kind").alias("kind"), F.col("failure_message").alias("message"), "retryable", "error_name")


def bundles(docs: DataFrame, outcomes: DataFrame, o: Options) -> DataFrame:
    """run_id, document_id, bundle (JSON): one auditable document for each document of the run."""
    keys = ["run_id", "document_id"]
    e = F.struct("char_start", "char_end", F.collate("extraction_class", "UNICODE").alias("c"), F.collate("quote", "UNICODE").alias("q"), "grounding", F.coalesce("attributes_json", F.lit("null")).alias("attributes_json"), "extraction_class", "quote", "offset_mode")
    found = extractions_of(outcomes, o.legacy).groupBy(*keys).agg(F.array_sort(F.collect_list(e)).alias("found"))
    doc = lambda x: F.struct(
        x["extraction_class"].alias("extractionClass"), x["quote"].alias("quote"), x["offset_mode"].alias("offsetMode"), x["char_start"].alias("charStart"), x["char_end"].alias("charEnd"),
        F.struct(x["offset_mode"].alias("offsetMode"), x["char_start"].alias("charStart"), x["char_end"].alias("charEnd")).alias("span"), F.nullif(x["attributes_json"], F.lit("null")).alias("attributes"), x["grounding"].alias("grounding"),
    )
    shard = F.struct("shard_index", "shard_id", "start", "end", "status", "from_checkpoint", "attempts", "prompt_hash", "failure_kind", "failure_message", "stages")
    logs = outcomes.groupBy(*keys).agg(F.array_sort(F.collect_list(shard)).alias("outcomes"))
    d = diagnostics_of(outcomes).join(logs, keys).join(found, keys, "left").join(budget_hits(outcomes), keys).join(docs.select("document_id", "text_hash", "ledger"), "document_id")
    deviation = F.struct(F.lit("spark").alias("name"), F.lit(docs.sparkSession.version).alias("version"))
    whole = F.struct(
        F.lit("1").alias("bundleVersion"), F.col("run_id").alias("runId"), F.lit(o.program.program_id).alias("programId"),
        F.transform(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), doc).alias("extractions"),
        F.struct("document_id", "text_hash", deviation.alias("runtime"), F.lit(o.created_at).alias("createdAt"), F.lit(o.program.program_hash).alias("programHash")).alias("provenance"),
        F.col("ledger").alias("normalizationLedger"),
        F.struct(F.lit(o.chunk_size).alias("chunkSize"), F.lit(o.overlap).alias("overlap"), F.col("total_shards").alias("shardCount")).alias("shardPlan"),
        F.struct("empty_kind", "completeness", "total_shards", "ok_shards", "failed_shards", "checkpoint_hits", "candidate_chars_truncated", "repair_chars_truncated", "outcomes").alias("diagnostics"),
    )
    return d.select("run_id", "document_id", F.to_json(whole).alias("bundle"))


def run_with_evidence(docs: DataFrame, o: Options, provider: Provider) -> tuple[DataFrame, DataFrame]:
    """Outcomes and bundles of documents (document_id, text)."""
    ready = prepare(docs, o)
    out = _store(execute(ready, o, provider), f"{o.work_dir or work_dir(docs.sparkSession)}/outcomes-{uuid.uuid4().hex}")
    return out, bundles(ready, out, o)


