"""States of experiments and runs, and their listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def experiment_status(runs: DataFrame) -> DataFrame:
    """experiment_id, next_status; NULL while any run still generates."""
    agg = runs.groupBy("experiment_id").agg(F.bool_or(F.col("status").isin("pending", "running")).alias("busy"), F.count_if(F.col("status") == "done").alias("done"), F.bool_and((F.col("status") != "done") | F.col("diagnosed_at").isNotNull()).alias("diagnosed"), F.bool_and((F.col("status") != "done") | F.col("evaluated_at").isNotNull()).alias("evaluated"))
    status = F.when(F.col("busy"), F.lit(None).cast("string")).when(F.col("done") == 0, "failed").when(F.col("diagnosed"), "done").when(F.col("evaluated"), "diagnosing").otherwise("evaluating")
    return agg.select("experiment_id", status.alias("next_status"))


def moved(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """experiments with the status they move to; only running, evaluating and diagnosing ones move."""
    found = experiments.join(experiment_status(runs), "experiment_id", "left")
    on = F.col("status").isin("running", "evaluating", "diagnosing") & F.col("next_status").isNotNull()
    return found.withColumn("status", F.when(on, F.col("next_status")).otherwise(F.col("status"))).drop("next_status")


def experiment_list(experiments: DataFrame, runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Experiments, newest first, each with its runs and their metrics."""
    own = runs.join(metrics, "run_id", "left").groupBy("experiment_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "status", "faithfulness", "answer_correctness"))).alias("runs"))
    return experiments.join(own, "experiment_id", "left").orderBy(F.col("created_at").desc(), "experiment_id")


def run_trace(results: DataFrame, runs: DataFrame, experiment_id: str, run_id: str) -> DataFrame:
    """A run's results by query_id, if the run is the experiment's."""
    own = runs.where((F.col("experiment_id") == experiment_id) & (F.col("run_id") == run_id))
    return results.join(own, "run_id", "left_semi").orderBy("query_id")


def experiment_progress(runs: DataFrame) -> DataFrame:
    return runs.groupBy("experiment_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("runs"))


def run_outcome(results: DataFrame) -> DataFrame:
    """failed if the budget stopped a query, or more than half errored; else done."""
    bad = F.coalesce(F.col("status"), F.lit("ok")) == "error"
    skip = F.coalesce(F.col("error_message"), F.lit("")) == "budget exceeded"
    agg = results.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(bad).alias("errored"), F.count_if(skip).alias("skipped"))
    return agg.withColumn("status", F.when((F.col("skipped") > 0) | (2 * F.col("errored") > F.col("total")), "failed").otherwise("done"))
