"""Naming what happened: failures, empty results, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.envelope import REPAIRABLE
from ..functions.text import OFFSET_MODE


def empty_kind(extractions, failures) -> Column:
    return F.when(extractions > 0, "non_empty").when(failures > 0, "empty_by_failure").otherwise("empty_by_evidence")


def completeness(total, failed) -> Column:
    return F.when(failed == 0, "complete_success").when(failed < total, "partial_success").otherwise("complete_failure")


def repairable(kind) -> Column:
    return F.coalesce(kind.isin(*REPAIRABLE), F.lit(False))


def valid_shape(cls, quote, mode, start, end, span_mode, span_start, span_end) -> Column:
    """Whether an extraction has all its members, its offsets are of the one mode, and its span mirrors them."""
    given = cls.isNotNull() & quote.isNotNull() & start.isNotNull() & end.isNotNull()
    return given & mode.eqNullSafe(F.lit(OFFSET_MODE)) & span_mode.eqNullSafe(mode) & span_start.eqNullSafe(start) & span_end.eqNullSafe(end)


def failure_kind(provider_error, budget, parse_ok, shape_ok, quote_ok) -> Column:
    """The kind of the first thing that went wrong, null if nothing did."""
    return F.when(budget, "budget_exhausted").when(provider_error, "provider_error").when(~parse_ok, "json_pipeline_failure").when(~shape_ok, "payload_shape_failure").when(~quote_ok, "quote_invariant_failure")


def retryable(kind, transient) -> Column:
    return (kind == "provider_error") & F.coalesce(transient, F.lit(False))


def diagnostics(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and verdicts by ``keys`` from outcomes (status, n_extractions, from_checkpoint)."""
    failed = F.count_if(F.col("status") == "failure")
    g = outcomes.groupBy(*keys).agg(F.count("*").alias("total_shards"), failed.alias("failed_shards"), F.count_if("from_checkpoint").alias("checkpoint_hits"), F.sum("n_extractions").alias("n_extractions"))
    return g.select(*keys, "total_shards", (F.col("total_shards") - F.col("failed_shards")).alias("ok_shards"), "failed_shards", "checkpoint_hits", empty_kind(F.col("n_extractions"), F.col("failed_shards")).alias("empty_kind"), completeness(F.col("total_shards"), F.col("failed_shards")).alias("completeness"))


def pending(shards: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Shards without a checkpoint."""
    return shards.join(checkpoints.select(*keys).distinct(), keys, "left_anti")


def cached(shards: DataFrame, checkpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Shards with one, and what it holds; they took no attempt."""
    return shards.join(checkpoints, keys).withColumns({"from_checkpoint": F.lit(True), "attempts": F.lit(0)})


def last_attempt(attempts: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of repeated attempts at one thing the last counts: one comparison a row, no window."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return attempts.groupBy(*keys).agg(last.alias("last")).select(*keys, *(f"last.{v}" for v in values))


def first_success(candidates: DataFrame, keys: list[str], position: str, ok) -> DataFrame:
    """keys, first_ok: the place of the first candidate that succeeds, where one does."""
    return candidates.groupBy(*keys).agg(F.min(F.when(ok, F.col(position))).alias("first_ok")).filter("first_ok IS NOT NULL")


def first_candidates(candidates: DataFrame, keys: list[str], position: str, most: int) -> DataFrame:
    """The first ``most`` candidates of each thing."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return candidates.withColumn("nth", nth).filter(F.col("nth") <= most)


def joined_fragments(fragments: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """keys, joined, n: the fragments of each stream in order, one behind the other."""
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return fragments.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x[text]), "").alias("joined"), F.count("*").alias("n"))
