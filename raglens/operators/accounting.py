"""Prompts, tokens, cost and budget of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: USD per million tokens, input and output.
RATES = {"gpt-4o": (5.0, 15.0), "gpt-4o-mini": (0.15, 0.60), "gpt-4-turbo": (10.0, 30.0), "gpt-3.5-turbo": (0.50, 1.50)}
OTHER_RATE = (5.0, 15.0)


def render_prompt(context: str | Column, question: str | Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def token_cost(df: DataFrame, model: str = "llm_model") -> DataFrame:
    """df with cost_usd; an unknown model has the dearer rate."""
    rates = df.sparkSession.createDataFrame([(k, *v) for k, v in RATES.items()], "_model string, _in double, _out double")
    priced = df.join(F.broadcast(rates), F.col(model) == F.col("_model"), "left")
    cost = F.col("input_tokens") * F.coalesce("_in", F.lit(OTHER_RATE[0])) / 1e6 + F.col("output_tokens") * F.coalesce("_out", F.lit(OTHER_RATE[1])) / 1e6
    return priced.withColumn("cost_usd", F.round(cost, 9)).drop("_model", "_in", "_out")


def token_usage(df: DataFrame, response: str = "response") -> DataFrame:
    """input_tokens and output_tokens of a response as JSON: usage_metadata, else response_metadata."""
    get = lambda p: F.nullif(F.get_json_object(response, p).cast("int"), F.lit(0))
    of = lambda *names: F.coalesce(*[get(p) for p in names], F.lit(0))
    meta = "$.response_metadata"
    return df.withColumns({"input_tokens": of("$.usage_metadata.input_tokens", f"{meta}.token_usage.prompt_tokens", f"{meta}.usage.input_tokens"), "output_tokens": of("$.usage_metadata.output_tokens", f"{meta}.token_usage.completion_tokens", f"{meta}.usage.output_tokens")})


def flatten_answer(parts: str | Column) -> Column:
    """The texts of an answer's parts, end to end."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def apply_budget(results: DataFrame, limit: float | None, order: str = "n") -> DataFrame:
    """Stops a run's queries once those before cost more than the limit; exactly the limit is still within it."""
    if not limit or limit <= 0:
        return results
    before = Window.partitionBy("run_id").orderBy(order, "query_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,9)")).over(before), F.lit(0))
    over = spent > F.lit(str(limit)).cast("decimal(18,9)")
    out = results.withColumn("_over", over)
    empty = {"status": F.lit("error"), "error_message": F.lit("budget exceeded"), "cost_usd": F.lit(0.0), "latency_ms": F.lit(0.0), "input_tokens": F.lit(0), "output_tokens": F.lit(0), "generated_answer": F.lit("")}
    have = results.columns
    return out.withColumns({k: F.when(F.col("_over"), v.cast(results.schema[k].dataType)).otherwise(F.col(k)) for k, v in empty.items() if k in have}).drop("_over")


def normalise_error(results: DataFrame) -> DataFrame:
    """An errored row has no answer, no chunks and no tokens."""
    bad = F.coalesce(F.col("status"), F.lit("ok")) == "error"
    if "retrieved_chunks" in results.columns:
        none = F.array().cast(results.schema["retrieved_chunks"].dataType)
        results = results.withColumn("retrieved_chunks", F.when(bad, none).otherwise(F.col("retrieved_chunks")))
    return results.withColumns({c: F.when(bad, F.lit(0)).otherwise(F.col(c)) for c in ("input_tokens", "output_tokens")} | {"generated_answer": F.when(bad, F.lit("")).otherwise(F.col("generated_answer"))})
