"""Report tables, feedback, integrity and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import SCORES, is_ok, rounded, sanitize_score
from raglens.operators.diagnosis import CATEGORIES


def feedback_summary(results: DataFrame, feedback: DataFrame) -> DataFrame:
    """positive, negative, total and coverage of each run's queries."""
    given = results.join(feedback, ["run_id", "query_id"], "left").groupBy("run_id").agg(F.count_if(F.col("rating") == "positive").alias("positive"), F.count_if(F.col("rating") == "negative").alias("negative"), F.count("rating").alias("total"), F.count("*").alias("queries"))
    return given.select("run_id", "positive", "negative", "total", F.coalesce(F.round(F.try_divide("total", "queries"), 3), F.lit(0.0)).alias("coverage"))


def upsert_feedback(existing: DataFrame, new: DataFrame, results: DataFrame) -> DataFrame:
    """The last valid feedback of each answer; errored or unknown results and unknown labels are rejected."""
    known = results.where(is_ok()).select("run_id", "query_id")
    valid = new.where(F.col("rating").isin("positive", "negative") & (F.col("correct_label").isNull() | F.col("correct_label").isin(*CATEGORIES)))
    valid = valid.join(known, ["run_id", "query_id"], "left_semi")
    last = Window.partitionBy("run_id", "query_id").orderBy(F.col("created_at").desc(), F.col("rating"), F.col("correct_label"))
    latest = valid.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return existing.join(latest, ["run_id", "query_id"], "left_anti").unionByName(latest)


def report_runs(runs: DataFrame, metrics: DataFrame, results: DataFrame, diagnoses: DataFrame) -> DataFrame:
    counts = results.groupBy("run_id").agg(F.count_if(is_ok()).alias("n_answers"), F.count_if(~is_ok()).alias("n_error"), F.count_if(is_ok() & sanitize_score("answer_correctness").isNull()).alias("n_unscored"))
    undone = diagnoses.groupBy("run_id").agg(F.count_if(F.col("failure_category").isNull()).alias("n_undiagnosed"))
    return runs.join(metrics.drop("n_ok"), "run_id", "left").join(counts, "run_id", "left").join(undone, "run_id", "left").na.fill(0, ["n_answers", "n_error", "n_unscored", "n_undiagnosed"])


def report_by_group(results: DataFrame, items: DataFrame) -> DataFrame:
    """run_id, grouping, value: counts, and each score's mean and number, by modality and by answerable, in one pass."""
    own = items.select(F.col("id").alias("query_id"), F.coalesce("modality", F.lit("None")).alias("modality"), F.coalesce(F.col("answerable").cast("string"), F.lit("false")).alias("answerable"))
    joined = results.join(own, "query_id", "left").na.fill({"modality": "None", "answerable": "false"})
    scores = {c: F.when(is_ok(), sanitize_score(c)) for c in SCORES}
    means = [a for c, x in scores.items() for a in (rounded(F.avg(x)).alias(c), F.count(x).alias(f"n_{c}"))]
    out = joined.groupingSets([["run_id", "modality"], ["run_id", "answerable"]], "run_id", "modality", "answerable").agg(F.grouping("modality").alias("g"), F.count("*").alias("n"), F.count_if(~is_ok()).alias("n_error"), *means)
    return out.select("run_id", F.when(F.col("g") == 0, "modality").otherwise("answerable").alias("grouping"), F.coalesce("modality", "answerable").alias("value"), "n", "n_error", *[x for c in SCORES for x in (c, f"n_{c}")])


def report_failures(runs: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Every known category of every run, zero-filled, and unknown ones that occur."""
    names = runs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    found = diagnoses.where("failure_category is not null").groupBy("run_id", F.col("failure_category").alias("category")).agg(F.count("*").alias("n"))
    every = runs.select("run_id").crossJoin(F.broadcast(names)).union(found.select("run_id", "category")).distinct()
    total = found.groupBy("run_id").agg(F.sum("n").alias("n_diagnosed"))
    return every.join(found, ["run_id", "category"], "left").join(total, "run_id", "left").na.fill(0, ["n", "n_diagnosed"])


def report_temporal(results: DataFrame, items: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Each run's answers to items of temporal pairs."""
    pairs = items.where("temporal_pair_id is not null").select(F.col("id").alias("query_id"))
    own = results.join(pairs, "query_id", "left_semi").join(diagnoses.select("run_id", "query_id", "failure_category"), ["run_id", "query_id"], "left")
    score, c = F.when(is_ok(), sanitize_score("answer_correctness")), F.col("failure_category")
    return own.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(~is_ok()).alias("n_error"), F.count(score).alias("n_scored"), rounded(F.avg(score)).alias("answer_correctness"), F.count(c).alias("n_diagnosed"), F.count_if(c == "STALE_ANSWER").alias("n_stale"), F.count_if(c == "WRONG_VERSION").alias("n_wrong_version"))


def join_integrity(results: DataFrame, items: DataFrame) -> DataFrame:
    """Query ids without an item, and ids that a run has twice: issue, run_id, query_id."""
    lost = results.join(items.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(F.lit("unmatched").alias("issue"), "run_id", "query_id").distinct()
    twice = results.groupBy("run_id", "query_id").count().where("count > 1").select(F.lit("duplicate").alias("issue"), "run_id", "query_id")
    return lost.union(twice)


def missing_results(runs: DataFrame, results: DataFrame, items: DataFrame) -> DataFrame:
    """run_id, query_id that a run has no result of. items: id, ord (its number in the set, from 0, each once).

    Each run's questions are bits of its bitmaps, one for 32,768 numbers; only runs with fewer bits than there are
    items are taken apart again.
    """
    place = F.col("ord").cast("long") + 1
    numbered = items.select(F.col("id").alias("query_id"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    held = results.select("run_id", "query_id").join(numbered, "query_id").groupBy("run_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = numbered.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("all"), F.count("*").alias("n"))  # a row for 32,768 items
    counted = held.join(F.broadcast(whole.select("bucket", "n")), "bucket").withColumn("short", F.bitmap_count("bits") < F.col("n"))
    # buckets that a run lacks whole count as zeros
    total = whole.agg(F.sum("n").alias("total"))
    full = counted.groupBy("run_id").agg(F.sum(F.bitmap_count("bits")).alias("got"))
    short = runs.select("run_id").distinct().join(full, "run_id", "left").join(F.broadcast(total), F.coalesce("got", F.lit(0)) < F.col("total")).select("run_id")
    numbers = F.sequence(F.lit(0), F.lit(4095))

    def left(bits: Column) -> Column:
        byte = lambda c, i: F.conv(F.hex(F.substring(c, i + 1, F.lit(1))), 16, 10).cast("int")
        open_ = lambda i: byte(F.col("all"), i).bitwiseAND(F.bitwise_not(F.coalesce(byte(bits, i), F.lit(0))))
        bit = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(open_(i), k) == 1), lambda k: i * 8 + k)
        return F.flatten(F.transform(F.filter(numbers, lambda i: open_(i) != 0), bit))

    every = short.join(F.broadcast(whole.select("bucket", "all")), F.lit(True))  # a row for 32,768 items beside each short run
    gaps = every.join(held, ["run_id", "bucket"], "left").select("run_id", "bucket", F.explode(left(F.col("bits")).cast("array<long>")).alias("bit"))
    return gaps.join(numbered, ["bucket", "bit"]).select("run_id", "query_id")


def completeness(runs: DataFrame, results: DataFrame, items: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """issue, run_id, query_id: missing, errored, unscored, undiagnosed results, and runs without any."""
    key = ["run_id", "query_id"]
    issue = lambda df, name: df.select(F.lit(name).alias("issue"), *key)
    empty = runs.join(results, "run_id", "left_anti").select(F.lit("empty_run").alias("issue"), "run_id", F.lit(None).cast("string").alias("query_id"))
    return issue(missing_results(runs, results, items), "missing").union(issue(results.where(~is_ok()), "errored")).union(issue(results.where(is_ok() & sanitize_score("answer_correctness").isNull()), "unscored")).union(issue(diagnoses.where("failure_category is null"), "undiagnosed")).union(empty)


def csv_cells(df: DataFrame) -> DataFrame:
    """Cells as a report writes them: NULL empty, booleans lower-case, floats rounded to 6."""
    cells: list[Column] = []
    for name, kind in df.dtypes:
        c = F.round(name, 6) if kind in ("double", "float") else F.col(name)
        cells.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return df.select(cells)


def write_report_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")

