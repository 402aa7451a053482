"""Scores and metrics of runs. What isn't scored is NULL, never 0; an errored query is no answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import SCORES, is_blank, is_ok, rounded, sanitize_score, to_epoch

NON_TEXT = ("table", "spreadsheet_cell", "image")
#: Written by the diagnosis, not by an evaluation.
ACCURACIES = ("diagnostic_accuracy", "temporal_family_accuracy")
#: Percentiles of the latency, and the share of answers to each side of one that is ranked.
SHARES, MARGIN = (0.5, 0.95), 0.002
GROUNDED_MODALITIES = ("table", "chart", "spreadsheet", "mixed")


def mean_valid(df: DataFrame, by: list[str], columns: list[str] = SCORES) -> DataFrame:
    """Mean and number of valid scores of each column."""
    aggs = [a for c in columns for a in (rounded(F.avg(sanitize_score(c))).alias(c), F.count(sanitize_score(c)).alias(f"n_{c}"))]
    return df.groupBy(*by).agg(*aggs)


def exact_mean(c: str) -> Column:
    """The mean by a sum in decimals, to 15 places: the same in any order of the rows, so that ties round one way."""
    return F.sum(F.col(c).try_cast("decimal(38,15)")).cast("double") / F.nullif(F.count(F.col(c).try_cast("decimal(38,15)")), F.lit(0))


def scored_counts(results: DataFrame) -> DataFrame:
    """run_id, metric, n_scored, n_unscored over the answers."""
    long = results.where(is_ok()).unpivot(["run_id"], SCORES, "metric", "value")
    valid = F.count(sanitize_score("value"))
    return long.groupBy("run_id", "metric").agg(valid.alias("n_scored"), (F.count("*") - valid).alias("n_unscored"))


def score_inputs(results: DataFrame, items: DataFrame) -> DataFrame:
    """What a scorer gets: question, non-empty contexts, ground truth ('' where the item is unknown)."""
    own = items.select(F.col("id").alias("query_id"), "question", "ground_truth")
    joined = results.where(is_ok()).join(own, "query_id", "left")
    return joined.select("run_id", "query_id", F.coalesce("question", F.lit("")).alias("question"), F.filter("contexts", lambda c: ~is_blank(c)).alias("contexts"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))


def align_scores(results: DataFrame, scores: DataFrame, columns: list[str] = SCORES) -> DataFrame:
    """Scores by (run_id, query_id). A run whose scores aren't one for each of its answers counts as unscored as a whole."""
    key = ["run_id", "query_id"]
    once = scores.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(sanitize_score(c)).alias(c) for c in columns])
    asked = results.groupBy(*key).agg(F.count("*").alias("_m"))
    whole = asked.join(once, key, "full_outer").groupBy("run_id").agg(F.bool_and(F.coalesce(F.col("_n") == F.col("_m"), F.lit(False))).alias("_whole"))
    joined = results.join(once, key, "left").join(whole, "run_id", "left")
    return joined.select(*key, *[c for c in results.columns if c not in key], *[F.when(F.col("_whole"), F.col(c)).alias(c) for c in columns])


def latency_percentiles(results: DataFrame, few: int = 2000) -> DataFrame:
    """run_id, latency_p50_ms, latency_p95_ms of the answers, interpolated; NULL where none has a latency.

    Two mergeable passes, so that a run of any size needs little memory. Summaries with a proven rank error of
    n/10000 cut each run's values around both percentiles, MARGIN of its answers to each side; then values between
    the cuts are only counted, and those within them ranked. A run of at most `few` values is ranked whole.
    """
    value, cuts = F.col("_value"), F.col("_cuts")
    own = results.where(is_ok()).select("run_id", F.col("latency_ms").cast("double").alias("_value"))
    summary = F.percentile_approx("_value", [x for s in SHARES for x in (s - MARGIN, s + MARGIN)], 10000)
    bounds = own.groupBy("run_id").agg(F.count("_value").alias("_n"), summary.alias("_cuts"))
    bounds = bounds.select(F.col("run_id").alias("_run"), "_n", F.when(F.col("_n") > few, cuts).alias("_cuts"))
    zone = F.when(cuts.isNull(), 1).when(value < cuts[0], 0).when(value <= cuts[1], 1).when(value < cuts[2], 2).when(value <= cuts[3], 3).otherwise(4)
    placed = own.join(bounds, own["run_id"].eqNullSafe(bounds["_run"])).where(value.isNotNull() | (F.col("_n") == 0))
    placed = placed.select("run_id", "_n", zone.alias("_zone"), F.when(zone.isin(1, 3), value).alias("_value"))
    order = Window.partitionBy("run_id").orderBy("_zone", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.groupBy("run_id", "_n", "_zone", "_value").count().withColumn("_upto", F.sum("count").over(order))

    def at(rank):
        return F.min(F.when(F.col("_upto") > rank, F.struct("_upto", "_value")))["_value"]

    def interpolated(share):
        place = (F.col("_n") - 1) * F.lit(share)
        return F.struct(at(F.floor(place)).alias("lo"), at(F.ceil(place)).alias("hi"), F.max(place - F.floor(place)).alias("part"))

    out = ranked.groupBy("run_id").agg(*[interpolated(s).alias(f"_{k}") for k, s in enumerate(SHARES)])
    mean = lambda c: F.when(c["part"] == 0, c["lo"]).otherwise((1 - c["part"]) * c["lo"] + c["part"] * c["hi"])
    return out.select("run_id", rounded(mean(F.col("_0"))).alias("latency_p50_ms"), rounded(mean(F.col("_1"))).alias("latency_p95_ms"))


def dated(chunk: Column) -> Column:
    return chunk["effective_from"].isNotNull()


def in_period(chunk: Column, at: Column) -> Column:
    """A closed interval; an open end is NULL."""
    return dated(chunk) & (chunk["effective_from"] <= at) & (chunk["effective_to"].isNull() | (chunk["effective_to"] >= at))


def with_items(results: DataFrame, items: DataFrame) -> DataFrame:
    """Answers with their item's date (epoch seconds), modality and source documents."""
    own = items.select(F.col("id").alias("query_id"), to_epoch("valid_from").alias("at"), "modality", "source_docs")
    return results.where(is_ok()).join(own, "query_id", "left")


def freshness_validity() -> Column:
    """Over results with a date: the share with a chunk that is valid then."""
    hit = F.exists("retrieved_chunks", lambda c: F.coalesce(in_period(c, F.col("at")), F.lit(False)))
    return rounded(F.avg(F.when(F.col("at").isNotNull(), hit.cast("double"))))


def temporal_citation_accuracy() -> Column:
    """Over the dated chunks of results with a date: the share that is valid then."""
    known = F.size(F.filter("retrieved_chunks", dated))
    valid = F.size(F.filter("retrieved_chunks", lambda c: F.coalesce(in_period(c, F.col("at")), F.lit(False))))
    on = F.col("at").isNotNull()
    return rounded(F.try_divide(F.sum(F.when(on, valid)), F.sum(F.when(on, known))))


def multimodal_grounding_rate() -> Column:
    """Over results of other than text questions: the share with a chunk that isn't text, from one of the item's
    source documents (from any if it names none); an unnamed type is text."""
    named = F.coalesce(F.size("source_docs"), F.lit(0)) > 0
    hit = F.exists("retrieved_chunks", lambda c: F.coalesce(c["chunk_type"], F.lit("text")).isin(*NON_TEXT) & (~named | F.coalesce(F.array_contains("source_docs", F.coalesce(c["filename"], F.lit(""))), F.lit(False))))
    return rounded(F.avg(F.when(F.col("modality").isin(*GROUNDED_MODALITIES), hit.cast("double"))))


def compute_run_metrics(runs: DataFrame, results: DataFrame, items: DataFrame) -> DataFrame:
    """One row a run; a run without answers has NULLs and a count of 0."""
    found = with_items(results, items).groupBy("run_id").agg(
        F.count("*").alias("n_ok"),
        rounded(F.avg("latency_ms")).alias("avg_latency_ms"),
        *[rounded(F.avg(sanitize_score(c))).alias(c) for c in SCORES],
        rounded(F.avg(F.col("input_tokens") + F.col("output_tokens"))).alias("avg_tokens"),
        rounded(exact_mean("cost_usd")).alias("avg_cost_usd"),
        freshness_validity().alias("freshness_validity"),
        temporal_citation_accuracy().alias("temporal_citation_accuracy"),
        multimodal_grounding_rate().alias("multimodal_grounding_rate"),
    )
    ranks = latency_percentiles(results)
    return runs.select("run_id").join(found, "run_id", "left").join(ranks, "run_id", "left").withColumn("n_ok", F.coalesce("n_ok", F.lit(0)))


def reranker_overhead(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mean latency of the reranked run less that of the hybrid run of the same experiment and other settings."""
    axes = [c for c in ("experiment_id", "chunking_strategy", "parsing_strategy", "freshness_policy") if c in runs.columns]
    own = runs.join(metrics.select("run_id", "avg_latency_ms"), "run_id")
    slow = own.where("retrieval_strategy = 'hybrid_reranker'").select(*axes, F.col("avg_latency_ms").alias("x"))
    base = own.where("retrieval_strategy = 'hybrid'").select(*axes, F.col("avg_latency_ms").alias("y"))
    return slow.join(base, axes).select(*axes, rounded(F.col("x") - F.col("y")).alias("overhead_ms"))


def upsert_run_metrics(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row a run: a run's new row takes the place of the old one, NULLs too; only its old accuracies stay
    until there are new ones."""
    kept = [c for c in existing.columns if c != "run_id"]
    pair = existing.alias("o").join(new.alias("n").withColumn("_new", F.lit(True)), "run_id", "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in ACCURACIES else F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return pair.select("run_id", *[pick(c).alias(c) if c in new.columns else F.col(f"o.{c}") for c in kept])
