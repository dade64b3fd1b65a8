"""Parallelism for inputs that are small beside the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than there are cores, else as it is.

    For work that costs much more than moving its rows. The moved input is at most a split a
    core, whatever the table's size; a plan that shuffles already is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
