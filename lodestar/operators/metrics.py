"""Quality of repeated runs: agreement, drift, coverage, spread, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part, whole) -> Column:
    """part / whole, 1 where there is nothing to miss."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def jaccard(a, b) -> Column:
    """Shared over all distinct members; two empty sets agree."""
    return rate(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def run_keys(extractions: DataFrame, runs: DataFrame) -> DataFrame:
    """run, n: distinct keys of each of ``runs``, also of those without any."""
    n = extractions.select("run", "key").distinct().groupBy("run").agg(F.count("*").alias("n"))
    return runs.join(n, "run", "left").select("run", F.coalesce("n", F.lit(0)).alias("n"))


def pairwise_jaccard(extractions: DataFrame, runs: DataFrame) -> DataFrame:
    """run_a, run_b, jaccard for each pair of runs (run_a < run_b).

    What two runs share comes from an equi-join on the key, so keys are never compared in pairs;
    only runs are, whose number is the number of trials."""
    keys = extractions.select("run", "key").distinct()
    a, b = keys.select(F.col("run").alias("run_a"), "key"), keys.select(F.col("run").alias("run_b"), "key")
    shared = a.join(b, "key").filter("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("shared"))
    n = run_keys(extractions, runs)
    x, y = n.select(F.col("run").alias("run_a"), F.col("n").alias("n_a")), n.select(F.col("run").alias("run_b"), F.col("n").alias("n_b"))
    pairs = x.join(y, F.col("run_a") < F.col("run_b")).join(shared, ["run_a", "run_b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    return pairs.select("run_a", "run_b", rate(shared, F.col("n_a") + F.col("n_b") - shared).alias("jaccard"))


def stability(pairs: DataFrame) -> DataFrame:
    """Mean agreement over pairs; a single run agrees with itself."""
    return pairs.agg(F.coalesce(F.avg("jaccard"), F.lit(1.0)).alias("stability"))


def case_signatures(extractions: DataFrame, cases: DataFrame) -> DataFrame:
    """run, case_id, signature: ``ok|n|sorted keys`` or ``error`` (cases: run, case_id, failed)."""
    keys = extractions.groupBy("run", "case_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("key")), ";").alias("keys"))
    ok = F.concat_ws("|", F.lit("ok"), F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("keys", F.lit("")))
    return cases.join(keys, ["run", "case_id"], "left").select("run", "case_id", F.when(F.col("failed"), "error").otherwise(ok).alias("signature"))


def case_fingerprints(extractions: DataFrame, cases: DataFrame) -> DataFrame:
    """run, case_id, signature: as :func:`case_signatures`, equal where those are equal, but of one size whatever a case
    has: the number of its keys and the sums of two hashes of each, which don't depend on their order."""
    total = lambda *more: F.sum(F.xxhash64("key", *more).cast("decimal(38,0)")).cast("string")
    keys = extractions.groupBy("run", "case_id").agg(F.concat_ws("|", F.count("*").cast("string"), total(), total(F.lit("second"))).alias("sums"))
    ok = F.concat_ws("|", F.lit("ok"), F.coalesce("sums", F.lit("0")))
    return cases.join(keys, ["run", "case_id"], "left").select("run", "case_id", F.when(F.col("failed"), "error").otherwise(ok).alias("signature"))


def drift(signatures: DataFrame, runs: DataFrame) -> DataFrame:
    """Share of cases whose signature isn't the same in all runs; a run without the case has the
    signature ``missing``.  0 for one run or no case."""
    n_runs = runs.select("run").distinct().agg(F.count("*").alias("n_runs"))
    by_case = signatures.groupBy("case_id").agg(F.count_distinct("signature").alias("kinds"), F.count_distinct("run").alias("present"))
    by_case = by_case.crossJoin(F.broadcast(n_runs)).select((F.col("kinds") + (F.col("present") < F.col("n_runs")).cast("int") > 1).alias("drifts"), "n_runs")
    return by_case.agg(F.coalesce(F.avg(F.when(F.col("n_runs") > 1, F.col("drifts").cast("double")).otherwise(0.0)), F.lit(0.0)).alias("drift_rate"))


def coverage(gold: DataFrame, actual: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Matched over all gold spans by ``by``."""
    hit = actual.select(*by, *keys).distinct().withColumn("hit", F.lit(1))
    return gold.join(hit, [*by, *keys], "left").groupBy(*by).agg(F.count("hit").alias("matched"), F.count("*").alias("gold")).withColumn("coverage", rate(F.col("matched"), F.col("gold")))


def spread(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Least, greatest, mean, and population variance and deviation."""
    c = F.col(column)
    zero = lambda x, name: F.coalesce(x, F.lit(0.0)).alias(name)
    return df.groupBy(*by).agg(zero(F.min(c).cast("double"), "min"), zero(F.max(c).cast("double"), "max"), zero(F.avg(c), "mean"), zero(F.var_pop(c), "variance"), zero(F.stddev_pop(c), "std_dev"))


def mean_of_means(df: DataFrame, value: str, inner: str) -> DataFrame:
    """Unweighted mean over ``inner`` of means within it."""
    return df.groupBy(inner).agg(F.avg(value).alias("m")).agg(F.coalesce(F.avg("m"), F.lit(0.0)).alias("mean_of_means"))


def breadth(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct values of each column, one at least."""
    return runs.agg(*(F.greatest(F.count_distinct(c), F.lit(1)).alias(f"{c}_breadth") for c in columns))


#: Fixed limits: the least or the most that a rate may be.
MINIMA = {"success_rate": 1.0, "schema_validity_rate": 1.0, "quote_invariant_pass_rate": 1.0, "coverage_rate": 1.0, "regression_category_count": 1.0, "total_case_count": 1.0}
MAXIMA = {"extraction_count_variance": 0.25, "success_rate_std_dev": 0.05, "case_outcome_drift_rate": 0.05}


def gates(scores: DataFrame, minima: dict = MINIMA, maxima: dict = MAXIMA) -> DataFrame:
    """gate, value, limit, passed for each limit whose column ``scores`` (one row) has."""
    rows = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit"), (F.col(k) >= v).alias("passed")) for k, v in minima.items() if k in scores.columns]
    rows += [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit"), (F.col(k) <= v).alias("passed")) for k, v in maxima.items() if k in scores.columns]
    return scores.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def check_gates(scores: DataFrame, **limits) -> None:
    """Raises with the gates that don't hold."""
    failed = [r for r in gates(scores, **limits).collect() if not r.passed]
    if failed:
        raise AssertionError("; ".join(f"{r.gate} is {r.value:g}, the limit {r.limit:g}" for r in failed))


def label(labels: list[str], run, prefix: str) -> Column:
    """The run's label, taken in turn; without labels prefix and number."""
    if not labels:
        return F.concat(F.lit(f"{prefix}-"), run.cast("string"))
    return F.element_at(F.array(*map(F.lit, labels)), (run % len(labels) + 1).cast("int"))
