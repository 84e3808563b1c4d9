"""How rows are dealt before costly work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out first if it is small and read from fewer files than the cluster has cores: one
    small file must not hold work on one core.  Tables of many files stay as they are.  Looks at the
    plan alone and runs nothing."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (64 << 20) and len(df.inputFiles()) < cores else df
