"""Root causes of failed answers: evidence, ordered rules, accuracy against labels, training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raglens.functions.scalars import KEY_METRICS, is_blank, is_ok, rounded, sanitize_score, stripped, to_epoch
from raglens.operators.metrics import NON_TEXT
from raglens.session import settled

CATEGORIES = ["STALE_ANSWER", "WRONG_VERSION", "CHART_LAYOUT_BLINDNESS", "TABLE_RETRIEVAL_MISS", "LOW_RECALL_RETRIEVAL", "UNSUPPORTED_SYNTHESIS", "IRRELEVANT_CONTEXT_POLLUTION", "CHUNKING_BOUNDARY_ERROR", "NO_FAILURE"]
RULE_CONFIDENCE = 0.7
VISION_SOURCE = "gpt4o_vision"
#: What a prompt says about each category.
DESCRIPTIONS = {
    "STALE_ANSWER": "The answer rests on a document that had expired by the question's date.",
    "WRONG_VERSION": "Chunks of another version of the document were used than the question needs.",
    "CHART_LAYOUT_BLINDNESS": "The answer is in a chart or layout, and no reading of the page image was retrieved.",
    "TABLE_RETRIEVAL_MISS": "The answer is in a table or sheet, and only plain text was retrieved.",
    "LOW_RECALL_RETRIEVAL": "The retrieved chunks lack most of what the answer needs.",
    "UNSUPPORTED_SYNTHESIS": "The answer says what the retrieved chunks don't support.",
    "IRRELEVANT_CONTEXT_POLLUTION": "Most of the retrieved chunks have nothing to do with the question.",
    "CHUNKING_BOUNDARY_ERROR": "The facts were retrieved, but cut apart by chunk boundaries.",
    "NO_FAILURE": "No failure was found.",
}
#: Chunks of a prompt, and characters of each.
PROMPT_CHUNKS, PROMPT_CHARS = 5, 400


def chunk_period(chunk: Column, at: Column) -> Column:
    """NULL without dates, else not_yet_valid, expired or in_period."""
    return F.when(chunk["effective_from"].isNotNull(), F.when(chunk["effective_from"] > at, "not_yet_valid").when(chunk["effective_to"] < at, "expired").otherwise("in_period"))


def temporal_evidence(results: DataFrame) -> DataFrame:
    """results with evidence on periods; NULL where the question has no date. Needs `at` and retrieved_chunks by rank."""
    periods = F.transform("retrieved_chunks", lambda c: chunk_period(c, F.col("at")))
    count = lambda *names: F.size(F.filter("periods", lambda p: p.isin(*names)))
    on = F.col("at").isNotNull()
    out = results.withColumn("periods", F.when(on, periods))
    out = out.withColumns({"dated": F.when(on, F.size(F.filter("periods", lambda p: p.isNotNull()))), "expired": F.when(on, count("expired")), "not_yet_valid": F.when(on, count("not_yet_valid"))})
    out = out.withColumn("out_of_period", F.col("expired") + F.col("not_yet_valid"))
    out = out.withColumn("top_out", F.when(on, F.coalesce(F.get("periods", F.lit(0)).isin("expired", "not_yet_valid"), F.lit(False))))
    out = out.withColumn("direction", F.get(F.filter("periods", lambda p: p.isin("expired", "not_yet_valid")), F.lit(0)))
    return out.withColumn("dominant", F.col("top_out") | (2 * F.col("out_of_period") > F.col("dated"))).drop("periods")


def has_nontext_chunk() -> Column:
    return F.exists("retrieved_chunks", lambda c: F.coalesce(c["chunk_type"], F.lit("text")).isin(*NON_TEXT))


def has_vision_chunk() -> Column:
    """A chunk of a page that was looked at: of type image, or from the vision reader."""
    return F.exists("retrieved_chunks", lambda c: F.coalesce(c["chunk_type"] == "image", F.lit(False)) | F.coalesce(c["source"] == VISION_SOURCE, F.lit(False)))


def version_mismatch() -> Column:
    other = F.exists("retrieved_chunks", lambda c: F.coalesce(c["doc_version"] != F.col("expected_version"), F.lit(False)))
    return F.col("expected_version").isNotNull() & other


def missing_key_metrics() -> Column:
    return F.array_compact(F.array(*[F.when(sanitize_score(c).isNull(), F.lit(c)) for c in KEY_METRICS]))


def evidence(results: DataFrame, items: DataFrame) -> DataFrame:
    """Answers with everything the rules read."""
    own = items.select(F.col("id").alias("query_id"), to_epoch("valid_from").alias("at"), "modality", "expected_version", "failure_type")
    joined = results.where(is_ok()).join(own, "query_id", "left").withColumns({c: sanitize_score(c) for c in KEY_METRICS})
    joined = temporal_evidence(joined)
    return joined.withColumns({"version_mismatch": version_mismatch(), "nontext": has_nontext_chunk(), "vision": has_vision_chunk(), "missing": missing_key_metrics()})


def rule_category() -> Column:
    """The ordered rules; the first that holds names the category, a missing score stops there."""
    recall, faith, precision, right = (F.col(c) for c in ("context_recall", "faithfulness", "context_precision", "answer_correctness"))
    none = F.lit(None).cast("string")
    temporal = F.when(F.col("direction") == "expired", "STALE_ANSWER").otherwise("WRONG_VERSION")
    return (
        F.when(F.col("dominant") & (right.isNull() | (right < 0.5)), temporal)
        .when(F.col("version_mismatch"), "WRONG_VERSION")
        .when((F.col("modality") == "chart") & ~F.col("vision"), "CHART_LAYOUT_BLINDNESS")
        .when(F.col("modality").isin("table", "chart", "spreadsheet", "mixed") & ~F.col("nontext"), "TABLE_RETRIEVAL_MISS")
        .when(recall.isNull(), none)
        .when(recall < 0.3, "LOW_RECALL_RETRIEVAL")
        .when(faith.isNull(), none)
        .when(faith < 0.4, "UNSUPPORTED_SYNTHESIS")
        .when(precision.isNull(), none)
        .when((precision < 0.3) & (faith > 0.5), "IRRELEVANT_CONTEXT_POLLUTION")
        .when(right.isNull(), none)
        .when((right < 0.4) & (recall > 0.5), "CHUNKING_BOUNDARY_ERROR")
        .otherwise("NO_FAILURE")
    )


def secondary_failures() -> Column:
    c = F.col("failure_category")
    low = F.when((c == "LOW_RECALL_RETRIEVAL") & (F.col("faithfulness") < 0.4), "UNSUPPORTED_SYNTHESIS")
    bad = F.when((c == "UNSUPPORTED_SYNTHESIS") & (F.col("context_precision") < 0.3), "IRRELEVANT_CONTEXT_POLLUTION")
    return F.array_compact(F.array(low, bad))


def diagnose(results: DataFrame, items: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """One row an answer. predicted (run_id, query_id, label, probability) decides where all key metrics are scored."""
    out = evidence(results, items).withColumn("failure_category", rule_category())
    out = out.withColumns({"secondary_failures": secondary_failures(), "confidence": F.lit(RULE_CONFIDENCE), "classifier": F.lit("rules")})
    if predicted is None:
        return out
    joined = out.join(predicted, ["run_id", "query_id"], "left")
    use = (F.size("missing") == 0) & F.col("label").isNotNull()
    pick = {"failure_category": F.when(use, F.col("label")).otherwise(F.col("failure_category")), "confidence": F.when(use, F.col("probability")).otherwise(F.col("confidence")), "classifier": F.when(use, "model").otherwise("rules"), "secondary_failures": F.when(use, F.array().cast("array<string>")).otherwise(F.col("secondary_failures"))}
    return joined.withColumns(pick).drop("label", "probability")


def diagnostic_accuracy(diagnoses: DataFrame) -> DataFrame:
    """run_id, exact and temporal-family accuracy over diagnosed answers whose item has a label."""
    temporal = lambda c: F.when(F.col(c).isin("STALE_ANSWER", "WRONG_VERSION"), "TEMPORAL").otherwise(F.col(c))
    on = diagnoses.where("failure_category is not null and failure_type is not null")
    same = (F.col("failure_category") == F.col("failure_type")).cast("double")
    family = (temporal("failure_category") == temporal("failure_type")).cast("double")
    return on.groupBy("run_id").agg(F.count("*").alias("n"), rounded(F.avg(same)).alias("diagnostic_accuracy"), rounded(F.avg(family)).alias("temporal_family_accuracy"))


def failure_summary(diagnoses: DataFrame, results: DataFrame) -> DataFrame:
    """category (NULL: undiagnosed), n, and the experiment's totals on each row."""
    totals = results.agg(F.count("*").alias("total"), F.count_if(~is_ok()).alias("errored"), F.count_distinct("run_id").alias("run_count"))
    return diagnoses.groupBy(F.col("failure_category").alias("category")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(totals))


def failure_rate(diagnoses: DataFrame) -> DataFrame:
    known, failed = F.count("failure_category"), F.count_if(F.col("failure_category") != "NO_FAILURE")
    return diagnoses.groupBy("run_id").agg(known.alias("n_diagnosed"), rounded(F.try_divide(failed, known)).alias("failure_rate"))


def query_diagnosis(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.select("run_id", "query_id", "failure_category", F.coalesce("confidence", F.lit(RULE_CONFIDENCE)).alias("confidence"), "direction", "dated", "out_of_period")


def scores_to_compute(results: DataFrame) -> DataFrame:
    """Answers of runs in which any answer lacks a key score: such a run is scored anew as a whole."""
    answers = results.where(is_ok())
    whole = F.bool_and(F.lit(True) & F.reduce(F.array(*[sanitize_score(c).isNotNull() for c in KEY_METRICS]), F.lit(True), lambda a, x: a & x))
    todo = answers.groupBy("run_id").agg(whole.alias("whole")).where("not whole")
    return answers.join(todo, "run_id", "left_semi").select("run_id", "query_id")


def rediagnosis_plan(runs: DataFrame, results: DataFrame) -> DataFrame:
    """run_id, ok, missing, will_rescore (all answers of a run that lacks any score), and why a run can't be diagnosed
    anew: it isn't done, wasn't evaluated, or has no results."""
    lack = F.reduce(F.array(*[sanitize_score(c).isNull() for c in KEY_METRICS]), F.lit(False), lambda a, x: a | x)
    found = results.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(is_ok()).alias("ok"), F.count_if(is_ok() & lack).alias("missing"))
    out = runs.select("run_id", "status", "evaluated_at").join(found, "run_id", "left").na.fill(0, ["total", "ok", "missing"])
    reason = F.when(~F.coalesce(F.col("status") == "done", F.lit(False)), F.concat(F.lit("status is "), F.coalesce("status", F.lit("unknown")))).when(F.col("evaluated_at").isNull(), "not evaluated").when(F.col("total") == 0, "no results")
    return out.select("run_id", "ok", "missing", F.when(F.col("missing") > 0, F.col("ok")).otherwise(0).alias("will_rescore"), reason.alias("reason"))


def reasoning_todo(diagnoses: DataFrame, cached: DataFrame) -> DataFrame:
    """Answers without a cached reasoning that parsed."""
    good = cached.where("not parse_error").select("run_id", "query_id")
    return diagnoses.join(good, ["run_id", "query_id"], "left_anti").select("run_id", "query_id", F.coalesce("failure_category", F.lit("UNDIAGNOSED")).alias("category"))


def pick_result_for_reasoning(results: DataFrame, order: str = "n") -> DataFrame:
    """The first answer of each (run_id, query_id); an errored row only where there is no other."""
    first = Window.partitionBy("run_id", "query_id").orderBy(~is_ok(), order)
    return results.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def prompt_rows(diagnoses: DataFrame) -> DataFrame:
    """What reasoning_prompt() reads of diagnoses, and of their first chunks which they are."""
    chunks = F.transform(F.slice("retrieved_chunks", 1, PROMPT_CHUNKS), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text_key"].alias("text_key")))
    return diagnoses.select("run_id", "query_id", "generated_answer", *KEY_METRICS, "failure_category", chunks.alias("retrieved_chunks"))


#: Answers of a bucket from which on it is split, and texts for other buckets up to which their keys are sent along.
MOST_ANSWERS, MOST_FAR = 1 << 17, 1 << 21


def with_texts(answers: DataFrame, texts: DataFrame, bucket: Callable[[Column], Column]) -> DataFrame:
    """answers, with what texts (chunk_id, text_key, content and more) has of each of their retrieved_chunks, content as
    far as prompts show it. answers should be computed already: they are read three times.

    bucket says where a chunk_id belongs. A text goes there once, an answer to where its first chunk belongs, and a text
    that answers of another bucket name goes there too, once: no text is shuffled for each answer that names it. Large
    buckets are split by answers; a task holds the texts of one bucket and reads its answers batch by batch.
    """
    key = lambda c: F.concat(c["chunk_id"], F.lit(":"), c["text_key"].cast("string"))
    own = answers.select(F.struct("*").alias("_row"), F.transform("retrieved_chunks", lambda c: F.struct(key(c).alias("key"), bucket(c["chunk_id"]).alias("at"))).alias("_named"), F.xxhash64("run_id", "query_id").alias("_hash"))
    own = own.withColumn("_bucket", F.coalesce(F.get("_named", F.lit(0))["at"], F.col("_hash")))  # without chunks, any
    large = own.groupBy("_bucket").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ANSWERS)
    large = large.select("_bucket", F.ceil(F.col("n") / MOST_ANSWERS).alias("_parts"))  # few: each has many answers
    own = own.join(F.broadcast(large), "_bucket", "left").withColumn("_part", F.coalesce(F.pmod("_hash", "_parts"), F.lit(0)))
    elsewhere = F.filter("_named", lambda x: (x["at"] != F.col("_bucket")) | (F.col("_part") > 0))
    far = settled(own.select("_bucket", "_part", F.explode(elsewhere).alias("x")).select("_bucket", "_part", F.col("x.key").alias("_key")).distinct())
    texts = texts.withColumn("content", F.substring("content", 1, PROMPT_CHARS))
    shown = texts.select(F.concat("chunk_id", F.lit(":"), F.col("text_key").cast("string")).alias("_key"), F.struct(*[c for c in texts.columns if c not in ("chunk_id", "text_key")]).alias("_text"), bucket(F.col("chunk_id")).alias("_bucket"), F.lit(0).cast("long").alias("_part"))
    sent = F.broadcast(far) if far.count() <= MOST_FAR else far
    both = shown.unionByName(shown.drop("_bucket", "_part").join(sent, "_key")).unionByName(own.select("_bucket", "_part", "_row"), allowMissingColumns=True)
    placed = both.withColumn("_last", F.col("_row").isNotNull()).repartition("_bucket", "_part").sortWithinPartitions("_bucket", "_part", "_last")
    chunk = answers.schema["retrieved_chunks"].dataType.elementType
    kind = T.StructType([*chunk, *shown.schema["_text"].dataType])
    return placed.mapInArrow(_filled, T.StructType([T.StructField(f.name, T.ArrayType(kind) if f.name == "retrieved_chunks" else f.dataType) for f in answers.schema]))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each _row with the texts of its chunks; in a bucket the texts come before the answers."""
    bucket, held, found = None, [], None
    for batch in batches:
        for piece in _pieces(batch):
            at = [piece.column(c)[0] for c in ("_bucket", "_part")]
            if at != bucket:
                bucket, held, found = at, [], None
            if not piece.column("_last")[0].as_py():
                held.append(pa.table({"_key": piece.column("_key")} | _fields(piece.column("_text"))))
                continue
            if found is None:
                held = held or [pa.table({"_key": piece.column("_key")} | _fields(piece.column("_text"))).slice(0, 0)]
                found = pa.concat_tables(held).combine_chunks()
            row = dict(zip([f.name for f in piece.column("_row").type], piece.column("_row").flatten(), strict=True))
            lists = row["retrieved_chunks"]
            chunks = dict(zip([f.name for f in lists.type.value_type], lists.flatten().flatten(), strict=True))
            key = pc.binary_join_element_wise(chunks["chunk_id"], chunks["text_key"].cast(pa.string()), ":")
            taken = found.drop_columns("_key").take(pc.index_in(key, found.column("_key"))).combine_chunks()
            chunks |= {f.name: taken.column(f.name).combine_chunks().cast(f.type) for f in piece.column("_text").type}
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            row["retrieved_chunks"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(list(chunks.values()), list(chunks)))
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))


def _fields(texts: pa.StructArray) -> dict[str, pa.Array]:
    """Its fields; strings of any number of bytes, as a bucket may have them."""
    return {f.name: x.cast(pa.large_string()) if pa.types.is_string(f.type) else x for f, x in zip(texts.type, texts.flatten(), strict=True)}


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Its runs of rows of one bucket and kind."""
    changed = np.zeros(max(len(batch) - 1, 0), bool)
    for c in ("_bucket", "_part", "_last"):
        own = batch.column(c).to_numpy(zero_copy_only=False)
        changed |= own[1:] != own[:-1]
    steps = [0, *(changed.nonzero()[0] + 1).tolist(), len(batch)]
    return (batch.slice(a, b - a) for a, b in zip(steps, steps[1:]) if b > a)


def reasoning_prompt(diagnoses: DataFrame, items: DataFrame) -> DataFrame:
    """A prompt of the question, the answer, the first chunks with what is known of them, the scored metrics and the category."""
    known = lambda name, c: F.when(~is_blank(c.cast("string")), F.concat(F.lit(f"{name}="), c.cast("string")))

    def shown(c, n):
        tags = F.array_compact(F.array(F.concat(F.lit("type="), F.coalesce(c["chunk_type"], F.lit("text"))), known("file", c["filename"]), known("version", c["doc_version"]), known("page", F.nullif(c["page"], F.lit(0)))))
        return F.concat(F.lit("Chunk "), (n + 1).cast("string"), F.lit(" ("), F.array_join(tags, ", "), F.lit("):\n"), F.substring(F.coalesce(c["content"], F.lit("")), 1, PROMPT_CHARS))

    chunks = F.array_join(F.transform(F.slice("retrieved_chunks", 1, PROMPT_CHUNKS), shown), "\n")
    scores = F.concat_ws("\n", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.format_string("%.3f", F.col(c)))) for c in KEY_METRICS])
    category = F.coalesce("failure_category", F.lit("UNDIAGNOSED"))
    about = F.coalesce(F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])[category], category)
    joined = diagnoses.join(items.select(F.col("id").alias("query_id"), "question"), "query_id", "left")
    parts = {"Question": F.coalesce("question", F.lit("")), "Answer": F.coalesce("generated_answer", F.lit("")), "Chunks": chunks, "Metrics": scores, "Category": F.concat(category, F.lit("\n"), about)}
    return joined.select("run_id", "query_id", F.concat_ws("\n\n", *[F.concat(F.lit(f"# {k}\n"), v) for k, v in parts.items()]).alias("prompt"))


def parse_reasoning(raw: DataFrame) -> DataFrame:
    """The fields of raw model texts; a confidence that the model didn't give stays NULL. What is no JSON object has
    parse_error, and its first 500 characters as root_cause."""
    parsed = F.from_json("raw", "reasoning_steps array<string>, root_cause string, fix_suggestion string, stakeholder_summary string, confidence double")
    good = F.coalesce(stripped("raw").startswith("{") & F.get_json_object("raw", "$").isNotNull(), F.lit(False))
    text = lambda name, other: F.when(good, F.coalesce(parsed[name], F.lit(""))).otherwise(other)
    steps = F.when(good, F.coalesce(parsed["reasoning_steps"], F.array().cast("array<string>"))).otherwise(F.array(F.lit("no structured response")))
    return raw.withColumns({"parse_error": ~good, "reasoning_steps": steps, "root_cause": text("root_cause", F.substring(F.coalesce("raw", F.lit("")), 1, 500)), "fix_suggestion": text("fix_suggestion", F.lit("read the raw response")), "stakeholder_summary": text("stakeholder_summary", F.lit("the analysis gave no structured result")), "confidence": F.when(good, parsed["confidence"])})


def extract_features(rows: DataFrame) -> DataFrame:
    """The classifier's inputs; missing values are 0, latency and cost are capped at 1."""
    m = F.lower(F.coalesce("modality", F.lit("text")))
    kind = F.when(m.isin("mixed", "spreadsheet"), "table").otherwise(m)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols = {f"f_{c}": zero(sanitize_score(c)) for c in [*KEY_METRICS, "answer_relevance"]}
    cols |= {"f_latency": F.least(zero(F.col("latency_ms") / 10_000), F.lit(1.0)), "f_cost": F.least(zero(F.col("cost_usd") / 0.10), F.lit(1.0))}
    cols |= {f"f_is_{k}": (kind == k).cast("double") for k in ("text", "table", "chart")}
    cols |= {"f_dated": zero(F.col("dated").cast("double")), "f_out": zero(F.col("out_of_period").cast("double")), "f_nontext": F.col("nontext").cast("double"), "f_version": F.col("version_mismatch").cast("double")}
    return rows.withColumns(cols)


def resolve_training_label(rows: DataFrame) -> DataFrame:
    """label and its source: feedback, then the item's label where a failure was seen, then the classifier."""
    failed = F.col("failure_category").isNotNull() & (F.col("failure_category") != "NO_FAILURE")
    pick = F.when(F.col("rating") == "positive", F.struct(F.lit("NO_FAILURE").alias("label"), F.lit("feedback").alias("source")))
    pick = pick.when(F.col("correct_label").isin(*CATEGORIES), F.struct(F.col("correct_label").alias("label"), F.lit("feedback").alias("source")))
    pick = pick.when(failed & F.col("failure_type").isin(*CATEGORIES), F.struct(F.col("failure_type").alias("label"), F.lit("eval_set").alias("source")))
    pick = pick.when(F.col("failure_category").isNotNull(), F.struct(F.col("failure_category").alias("label"), F.lit("classifier").alias("source")))
    return rows.withColumn("pick", pick).where("pick is not null and coalesce(failure_type, '') <> 'UNANSWERABLE'").select("*", "pick.label", "pick.source").drop("pick")


def training_set(diagnoses: DataFrame, feedback: DataFrame) -> DataFrame:
    """Diagnosed answers with all key metrics, with feedback, features, label and source."""
    on = diagnoses.where("failure_category is not null and size(missing) = 0")
    return extract_features(resolve_training_label(on.join(feedback, ["run_id", "query_id"], "left")))


def training_counts(diagnoses: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: diagnosed answers skipped for missing scores and as unanswerable, labels that feedback or the item
    changed, and positive ratings among the rows trained on."""
    on = diagnoses.where("failure_category is not null").join(feedback, ["run_id", "query_id"], "left")
    short, odd = F.size("missing") > 0, F.coalesce(F.col("failure_type") == "UNANSWERABLE", F.lit(False))
    skipped = on.agg(F.count_if(short).alias("missing_scores"), F.count_if(~short & odd).alias("unanswerable"))
    kept = training_set(diagnoses, feedback).agg(F.count("*").alias("rows"), F.count_if(F.col("label") != F.col("failure_category")).alias("overrides"), F.count_if(F.col("rating") == "positive").alias("positive_ratings"))
    return skipped.crossJoin(kept)


def label_source_summary(training: DataFrame) -> DataFrame:
    """source, n, share, dominant (ties: feedback, eval_set, classifier), and a warning where the classifier's own labels dominate."""
    total = training.groupBy("source").agg(F.count("*").alias("n"))
    sums = total.agg(F.sum("n").alias("total"), F.max(F.struct("n", _priority("source").alias("p"), "source")).alias("best"))
    share = F.col("n") / F.col("total")
    warning = F.when((F.col("source") == "classifier") & (F.col("best.source") == "classifier"), F.format_string("%.0f%% of the labels are the classifier's own", share * 100))
    return total.crossJoin(F.broadcast(sums)).select("source", "n", rounded(share).alias("share"), (F.col("source") == F.col("best.source")).alias("dominant"), warning.alias("warning"))


def _priority(source: str) -> Column:
    return F.when(F.col(source) == "feedback", 2).when(F.col(source) == "eval_set", 1).otherwise(0)
