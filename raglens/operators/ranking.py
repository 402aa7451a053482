"""Leaderboard, baseline comparison, recommendations and dashboard numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import is_ok, rounded, sanitize_score

#: Sortable metrics; True: larger is better.
SORTABLE = {"faithfulness": True, "context_precision": True, "context_recall": True, "answer_relevance": True, "answer_correctness": True, "freshness_validity": True, "multimodal_grounding_rate": True, "latency_p50_ms": False, "avg_cost_usd": False}
BASELINE = {"retrieval_strategy": "vector_only", "chunking_strategy": "recursive", "parsing_strategy": "text_only", "freshness_policy": "none"}
RADAR = ["faithfulness", "context_precision", "context_recall", "answer_relevance", "answer_correctness", "freshness_validity", "multimodal_grounding_rate"]


def query_counts(runs: DataFrame, results: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """total, errored, unscored and undiagnosed answers of each run; the latter two NULL until the run got that far."""
    undone = diagnoses.where("failure_category is null").groupBy("run_id").agg(F.count("*").alias("u"))
    found = results.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(~is_ok()).alias("errored"), F.count_if(is_ok() & sanitize_score("answer_correctness").isNull()).alias("s"))
    out = runs.join(found, "run_id", "left").join(undone, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("run_id", zero(F.col("total")).alias("total"), zero(F.col("errored")).alias("errored"), F.when(F.col("evaluated_at").isNotNull(), zero(F.col("s"))).alias("unscored"), F.when(F.col("diagnosed_at").isNotNull(), zero(F.col("u"))).alias("undiagnosed"))


def leaderboard(metrics: DataFrame, sort_by: str, runs: DataFrame | None = None) -> DataFrame:
    """Runs (given their states: those that are done) with a rank by one metric; runs without it come last, ties by run_id."""
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by}")
    if runs is not None:
        metrics = metrics.join(runs.where("status = 'done'").select("run_id"), "run_id", "left_semi")
    order = F.col(sort_by).desc_nulls_last() if SORTABLE[sort_by] else F.col(sort_by).asc_nulls_last()
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(order, "run_id")))  # a row a run: at most some hundreds


def is_baseline() -> Column:
    on = F.lit(True)
    for name, value in BASELINE.items():
        on = on & (F.col(name) == value)
    return on


def long_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.unpivot(["run_id"], names, "metric", "value").where("value is not null")


def baseline_deltas(metrics: DataFrame, baseline_id: str) -> DataFrame:
    """run_id, metric, value, base, delta, relative_pct, improved, for every run but the baseline."""
    long = long_metrics(metrics, list(SORTABLE))
    base = long.where(F.col("run_id") == baseline_id).select("metric", F.col("value").alias("base"))
    return _deltas(long.where(F.col("run_id") != baseline_id).join(F.broadcast(base), "metric"))


def _deltas(joined: DataFrame) -> DataFrame:
    delta = F.round(F.col("value") - F.col("base"), 9)
    up = F.col("metric").isin(*[m for m, better in SORTABLE.items() if better])
    relative = F.when(F.col("base") == 0, F.when(delta == 0, 0.0).otherwise(100.0)).otherwise(F.round(delta / F.abs("base") * 100, 2))
    return joined.select("run_id", "metric", "value", "base", delta.alias("delta"), relative.alias("relative_pct"), F.when(up, delta > 0).otherwise(delta < 0).alias("improved"))


def comparison_summary(deltas: DataFrame) -> DataFrame:
    """Improvements, regressions, what wasn't compared, and the metric of the largest relative change of each run."""
    top = F.max(F.struct("relative_pct", (-F.array_position(F.array(*map(F.lit, SORTABLE)), F.col("metric"))).alias("place"), "metric"))
    return deltas.groupBy("run_id").agg(F.count_if("improved").alias("improvements"), F.count_if(~F.col("improved") & (F.col("delta") != 0)).alias("regressions"), (F.lit(len(SORTABLE)) - F.count("*")).alias("not_compared"), top["metric"].alias("top_improvement"), top["relative_pct"].alias("top_change"))


def overall(metrics: DataFrame) -> DataFrame:
    """run_id, value: 0.4 faithfulness + 0.3 correctness + 0.2 recall of the runs with all three."""
    value = rounded(0.4 * F.col("faithfulness") + 0.3 * F.col("answer_correctness") + 0.2 * F.col("context_recall"))
    return metrics.select("run_id", value.alias("value")).where("value is not null")


def baseline_comparison(runs: DataFrame, metrics: DataFrame, target: str | None = None) -> DataFrame:
    """One row: baseline_id, run_id (the target, or the best overall of the other runs), the summary of their deltas,
    and error (then all else is NULL): no_baseline, no_other_runs, unknown_target or no_scored_run.

    The baseline is the first run of the baseline's settings; all inputs have a row a run.
    """
    own = runs.join(metrics, "run_id").localCheckpoint()  # a row a run, read five times below
    base = own.where(is_baseline()).agg(F.min("run_id").alias("baseline_id"))
    other = own.join(base, F.lit(True)).where("baseline_id is null or run_id <> baseline_id")
    chosen = other.where(F.col("run_id") == target).select("run_id", F.lit(0.0).alias("value")) if target else overall(other)
    best = chosen.agg(F.min(F.struct((-F.col("value")).alias("v"), "run_id"))["run_id"].alias("run_id"))
    state = base.crossJoin(other.agg(F.count("*").alias("others"))).crossJoin(best)
    lost = F.lit("unknown_target" if target else "no_scored_run")
    error = F.when(F.col("baseline_id").isNull(), "no_baseline").when(F.col("others") == 0, "no_other_runs").when(F.col("run_id").isNull(), lost)
    state = state.select(F.when(error.isNull(), F.col("baseline_id")).alias("baseline_id"), F.when(error.isNull(), F.col("run_id")).alias("run_id"), error.alias("error"))
    long = long_metrics(own, list(SORTABLE))
    pair = long.join(state.select("run_id"), "run_id").join(long.join(state.select(F.col("baseline_id").alias("run_id")), "run_id").select("metric", F.col("value").alias("base")), "metric")
    return state.join(comparison_summary(_deltas(pair)), "run_id", "left")


OBJECTIVES = {
    "best_overall": ["faithfulness", "answer_correctness", "context_recall", "avg_cost_usd"],
    "lowest_cost": ["avg_cost_usd"],
    "best_latency": ["latency_p50_ms"],
    "best_faithfulness": ["faithfulness"],
    "best_for_tables": ["multimodal_grounding_rate"],
    "best_for_drift": ["freshness_validity"],
    "best_for_long_pdfs": ["context_recall"],
}


def recommend(runs: DataFrame, metrics: DataFrame, objectives: list[str] | None = None) -> DataFrame:
    """objective, status, run_id, value: one row an objective; none at all without metrics.

    A run is eligible with all metrics of the objective; preferred runs go before others. An objective that
    isn't known takes the first run, with value 0.
    """
    rows = runs.join(metrics, "run_id")
    names = list(objectives or OBJECTIVES)
    preferred = {"best_for_tables": F.col("parsing_strategy").isin("text_table", "spreadsheet_aware"), "best_for_drift": F.col("freshness_policy") != "none", "best_for_long_pdfs": F.col("parsing_strategy") == "text_table"}
    has = lambda name: F.reduce(F.array(*[sanitize_score(m).isNotNull() for m in OBJECTIVES[name]]), F.lit(True), lambda a, x: a & x)
    cost = F.max(F.when(has("best_overall"), F.col("avg_cost_usd"))).over(Window.partitionBy())  # a row a run
    share = F.col("avg_cost_usd") / F.when(F.col("_cost") == 0, 0.001).otherwise(F.col("_cost"))
    whole = 0.4 * F.col("faithfulness") + 0.3 * F.col("answer_correctness") + 0.2 * F.col("context_recall") + 0.1 * (1 - share)

    def entry(name: str) -> Column:
        if name not in OBJECTIVES:
            return F.struct(F.lit(name).alias("objective"), F.lit(True).alias("fits"), F.lit(True).alias("liked"), F.lit(0.0).alias("value"), F.lit(0.0).alias("order"))
        value = F.round(whole if name == "best_overall" else F.col(OBJECTIVES[name][0]), 9)
        sign = 1 if name in ("lowest_cost", "best_latency") else -1
        return F.struct(F.lit(name).alias("objective"), has(name).alias("fits"), F.coalesce(preferred.get(name, F.lit(True)), F.lit(False)).alias("liked"), value.alias("value"), (sign * value).alias("order"))

    each = rows.withColumn("_cost", cost).select("run_id", F.inline(F.array(*map(entry, names))))
    best = each.groupBy("objective").agg(F.min(F.when(F.col("fits"), F.struct((~F.col("liked")).alias("other"), "order", "run_id", "value"))).alias("best"))
    return best.select("objective", F.when(F.col("best").isNull(), "no_eligible_runs").otherwise("ok").alias("status"), "best.run_id", rounded(F.col("best.value")).alias("value"))


def explain_recommendations(recommended: DataFrame, runs: DataFrame) -> DataFrame:
    """recommended (from recommend) with a sentence on why the run was chosen."""
    v, own = F.col("value"), runs.select("run_id", "parsing_strategy", "freshness_policy")
    text = F.format_string("chosen by default for %s", "objective")
    for name, pattern, extra in (("best_overall", "best overall: composite of faithfulness, correctness, recall and cost %.2f", []), ("lowest_cost", "lowest mean cost of a query: $%.4f", []), ("best_latency", "fastest median answer: %.0f ms", []), ("best_faithfulness", "highest faithfulness: %.3f", []), ("best_for_tables", "best for tables and sheets: grounding rate %.3f with parsing %s", ["parsing_strategy"]), ("best_for_drift", "best under temporal drift: freshness validity %.3f with policy %s", ["freshness_policy"]), ("best_for_long_pdfs", "best for long documents: context recall %.3f with parsing %s", ["parsing_strategy"])):
        text = F.when(F.col("objective") == name, F.format_string(pattern, v, *extra)).otherwise(text)
    text = F.when(F.col("status") == "ok", text).otherwise(F.format_string("no run has all metrics of %s", "objective"))
    return recommended.join(own, "run_id", "left").select("objective", "status", "run_id", "value", text.alias("rationale"))


def explain_run(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """A sentence on each run; n/a for what is NULL."""
    near = lambda c, f: F.floor(F.col(c) * 10 ** int(f[2]) + 0.5) / 10 ** int(f[2])  # noqa: E731 - halves go up
    shown = lambda c, f: F.when(F.col(c).isNull(), "n/a").otherwise(F.format_string(f, near(c, f)))
    text = F.concat(F.col("retrieval_strategy"), F.lit(" + "), F.col("chunking_strategy"), F.lit(": faithfulness "), shown("faithfulness", "%.3f"), F.lit(", correctness "), shown("answer_correctness", "%.3f"), F.lit(", p50 "), shown("latency_p50_ms", "%.0f"), F.lit(" ms"))
    return runs.join(metrics, "run_id").select("run_id", text.alias("rationale"))


def top_k_chart(metrics: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """The first k scored runs of the leaderboard."""
    return leaderboard(metrics.where(F.col(metric).isNotNull()), metric).where(f"rank <= {k}").select("run_id", "rank", F.col(metric).alias("value"))


def radar(metrics: DataFrame) -> DataFrame:
    return long_metrics(metrics, RADAR)


def score_band(long: DataFrame) -> DataFrame:
    """good, fair or poor; latency and cost are shares of 5000 ms and 0.05 USD, turned around."""
    v = F.when(F.col("metric").startswith("latency"), 1 - F.col("value") / 5000).when(F.col("metric") == "avg_cost_usd", 1 - F.col("value") / 0.05).otherwise(F.col("value"))
    return long.withColumn("band", F.when(v.isNull(), "none").when(v >= 0.7, "good").when(v >= 0.4, "fair").otherwise("poor"))


def overview_kpis(documents: DataFrame, runs: DataFrame, metrics: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row: documents, indexed (parse_status done), dated, experiments, completed, runs, evaluated_runs, and the
    most faithful run."""
    one = documents.agg(F.count("*").alias("documents"), F.count_if(F.col("parse_status") == "done").alias("indexed"), F.count("effective_from").alias("dated"))
    two = experiments.agg(F.count("*").alias("experiments"), F.count_if(F.col("status") == "done").alias("completed")).crossJoin(runs.agg(F.count("*").alias("runs")))
    three = metrics.agg(F.count("faithfulness").alias("evaluated_runs"), F.min(F.when(F.col("faithfulness").isNotNull(), F.struct((-F.col("faithfulness")).alias("f"), "run_id")))["run_id"].alias("best_run"))
    return one.crossJoin(two).crossJoin(three)
