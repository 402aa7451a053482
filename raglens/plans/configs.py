"""Configurations: matrices, validation and the plan of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The four axes.
AXES = {
    "retrieval_strategy": ["vector_only", "bm25", "hybrid", "hybrid_reranker"],
    "chunking_strategy": ["fixed", "recursive", "semantic", "structure_aware"],
    "parsing_strategy": ["text_only", "text_table", "text_table_vision", "spreadsheet_aware"],
    "freshness_policy": ["none", "effective_date_filter", "version_aware", "recency_biased"],
}
MVP = {"retrieval_strategy": ["vector_only", "hybrid", "hybrid_reranker"], "chunking_strategy": ["recursive", "structure_aware"], "parsing_strategy": ["text_only", "text_table"], "freshness_policy": ["none", "effective_date_filter"]}
DEFAULT_MODEL, DEFAULT_TOP_K, MOST_CONFIGS = "gpt-4o-mini", 5, 32


def config_matrix(spark: SparkSession, axes: dict[str, list[str]] | None = None) -> DataFrame:
    """All combinations; an axis that is missing or empty takes all its values."""
    out = spark.range(1)
    for name, values in AXES.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, (axes or {}).get(name) or values))))
    out = out.drop("id")
    return out.withColumns({"reranker_enabled": F.col("retrieval_strategy") == "hybrid_reranker", "llm_model": F.lit(DEFAULT_MODEL), "top_k": F.lit(DEFAULT_TOP_K)})


def validate_configs(specs: DataFrame) -> DataFrame:
    """(position, error) of bad specs; defaults are filled before duplicates are looked for. No spec at all is one
    error without position; `unknown_fields` (an array), if there, names what a spec has beyond the known ones."""
    filled = specs.na.fill({"top_k": DEFAULT_TOP_K, "llm_model": DEFAULT_MODEL})
    bad = [F.when(~F.coalesce(F.col(a).isin(*values), F.lit(False)), F.concat(F.lit(f"{a}: "), F.coalesce(a, F.lit("missing")))) for a, values in AXES.items()]
    bad.append(F.when(F.col("top_k") < 1, "top_k below 1"))
    same = Window.partitionBy(*AXES, "top_k", "llm_model").orderBy("position")
    first = F.first("position").over(same)
    bad.append(F.when(F.col("_first") < F.col("position"), F.concat(F.lit("same as "), F.col("_first").cast("string"))))
    bad.append(F.when(F.col("position") >= MOST_CONFIGS, "too many"))
    if "unknown_fields" in specs.columns:
        bad.append(F.when(F.size("unknown_fields") > 0, F.concat(F.lit("unknown: "), F.array_join("unknown_fields", ", "))))
    none = specs.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(specs.schema["position"].dataType).alias("position"), F.lit("no configuration").alias("error"))
    found = filled.withColumn("_first", first).select("position", F.explode(F.array_compact(F.array(*bad))).alias("error"))
    return found.unionByName(none)


def plan_runs(configs: DataFrame, items: DataFrame) -> DataFrame:
    """One task for every run and question."""
    return items.crossJoin(F.broadcast(configs))
