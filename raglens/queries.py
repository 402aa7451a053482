"""The registered queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raglens.fixtures import run_sql, view, with_views
from raglens.functions import scalars, scorers
from raglens.operators import accounting, chunking, diagnosis, evalsets, lifecycle, metrics, ml, ranking, reporting, retrieval, vector_lists
from raglens.plans import configs
from raglens.session import settled, table
from raglens.sources import ingest
from raglens.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL."""

    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(re.sub(r'(?<!["\w])at(?!["\w])', '"at"', sql))  # a reserved word there
        return f

    return add


# --- inputs -----------------------------------------------------------------


def items(spark, d):
    return view(spark, d, "fx_eval_items")


def runs(spark, d):
    return view(spark, d, "fx_runs").withColumns({"status": F.lit("done"), "evaluated_at": F.lit(1), "diagnosed_at": F.lit(1)})


def results(spark, d, content=False, keyed=False):
    """Results with cost and chunks by rank; the chunks' texts come along only where they are read, as far as prompts show
    them; where keyed, text_key does, which tells texts of one chunk_id apart, and what only prompts read stays behind."""
    found = view(spark, d, "fx_retrieved_keyed")
    if keyed:
        found = found.withColumns({"filename": F.lit(None).cast("string"), "page": F.lit(None).cast("int")})
    text = F.substring("content", 1, diagnosis.PROMPT_CHARS) if content else F.lit(None).cast("string")
    found = found.withColumn("content", text).groupBy("run_id", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "filename", "doc_version", "chunk_type", "effective_from", "effective_to", "content", "page", "source", *["text_key"] * keyed))).alias("retrieved_chunks"))
    kind = "array<struct<rank:int,chunk_id:string,filename:string,doc_version:string,chunk_type:string,effective_from:bigint,effective_to:bigint,content:string,page:int,source:string" + ",text_key:int" * keyed + ">>"
    own = view(spark, d, "fx_query_results").withColumn("llm_model", F.lit("gpt-4o-mini"))
    joined = accounting.token_cost(own).join(found, ["run_id", "query_id"], "left")
    return joined.withColumn("retrieved_chunks", F.coalesce(F.col("retrieved_chunks").cast(kind), F.array().cast(kind)))


def diagnoses(spark, d, keyed=False):
    return diagnosis.diagnose(results(spark, d, keyed=keyed), items(spark, d))


def run_metrics(spark, d):
    return metrics.compute_run_metrics(runs(spark, d), results(spark, d), items(spark, d))


def feedback(spark, d):
    own = view(spark, d, "fx_query_results").where("n % 6 = 0")
    return own.select("run_id", "query_id", F.when(F.col("n") % 4 == 0, "positive").otherwise("negative").alias("rating"), F.when(F.col("n") % 5 == 0, "STALE_ANSWER").alias("correct_label"), F.col("n").alias("created_at"))


def numbers(rows: list[tuple], schema: str, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows, schema)


IT = r"""it as (select *, case when regexp_matches(valid_from, '^\d{4}-\d{2}-\d{2}([T ].*)?$') then cast(epoch(try_cast(valid_from as timestamp)) as bigint) end as at from fx_eval_items)"""
ANS = """ans as (select r.*, it.at, it.modality, it.expected_version, it.failure_type, it.temporal_pair_id, it.source_docs,
  round(r.input_tokens * 0.15 / 1e6 + r.output_tokens * 0.6 / 1e6, 9) as cost_usd
  from fx_query_results r left join it on it.id = r.query_id where coalesce(r.status, 'ok') <> 'error')"""
EV = """per as (select a.run_id, a.query_id, a.at, c.*exclude (run_id, query_id),
    case when c.effective_from is not null and a.at is not null then case when c.effective_from > a.at then 'not_yet_valid' when c.effective_to < a.at then 'expired' else 'in_period' end end as period,
    coalesce(c.chunk_type, 'text') in ('table', 'spreadsheet_cell', 'image') as nt, c.chunk_type = 'image' or coalesce(c.source = 'gpt4o_vision', false) as vi,
    coalesce(c.chunk_type, 'text') in ('table', 'spreadsheet_cell', 'image') and (len(coalesce(a.source_docs, [])) = 0 or list_contains(a.source_docs, c.filename)) as gr, c.doc_version <> a.expected_version as mm
  from ans a left join fx_retrieved c using (run_id, query_id)),
ev as (select run_id, query_id, case when any_value(at) is not null then count(period) end as dated,
    count(effective_from) as known, count(*) filter (period = 'in_period') as valid,
    case when any_value(at) is not null then count(*) filter (period = 'expired') end as expired,
    case when any_value(at) is not null then count(*) filter (period = 'not_yet_valid') end as not_yet_valid,
    case when any_value(at) is not null then count(*) filter (period in ('expired', 'not_yet_valid')) end as out_of_period,
    case when any_value(at) is not null then coalesce(bool_or(rank = 1 and period in ('expired', 'not_yet_valid')), false) end as top_out,
    arg_min(period, rank) filter (period in ('expired', 'not_yet_valid')) as direction,
    coalesce(bool_or(nt), false) as nontext, coalesce(bool_or(gr), false) as grounded, coalesce(bool_or(vi), false) as vision, coalesce(bool_or(mm), false) as version_mismatch
  from per group by run_id, query_id),
dg as (select ans.*, ev.* exclude (run_id, query_id), top_out or 2 * out_of_period > dated as dominant,
  case when (top_out or 2 * out_of_period > dated) and (answer_correctness is null or answer_correctness < 0.5) then case when direction = 'expired' then 'STALE_ANSWER' else 'WRONG_VERSION' end
    when version_mismatch then 'WRONG_VERSION'
    when modality = 'chart' and not vision then 'CHART_LAYOUT_BLINDNESS'
    when modality in ('table', 'chart', 'spreadsheet', 'mixed') and not nontext then 'TABLE_RETRIEVAL_MISS'
    when context_recall is null then null when context_recall < 0.3 then 'LOW_RECALL_RETRIEVAL'
    when faithfulness is null then null when faithfulness < 0.4 then 'UNSUPPORTED_SYNTHESIS'
    when context_precision is null then null when context_precision < 0.3 and faithfulness > 0.5 then 'IRRELEVANT_CONTEXT_POLLUTION'
    when answer_correctness is null then null when answer_correctness < 0.4 and context_recall > 0.5 then 'CHUNKING_BOUNDARY_ERROR'
    else 'NO_FAILURE' end as failure_category
  from ans join ev using (run_id, query_id))"""
MET = """met as (select run_id, count(q.query_id) as n_ok, round(avg(latency_ms), 9) as avg_latency_ms, round(avg(faithfulness), 9) as faithfulness, round(avg(context_precision), 9) as context_precision,
    round(avg(context_recall), 9) as context_recall, round(avg(answer_relevance), 9) as answer_relevance, round(avg(answer_correctness), 9) as answer_correctness,
    round(quantile_cont(latency_ms, 0.5), 9) as latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 9) as latency_p95_ms,
    round(avg(input_tokens + output_tokens), 9) as avg_tokens, round(avg(cost_usd), 9) as avg_cost_usd,
    round(avg(case when q.at is not null then cast(valid > 0 as int) end), 9) as freshness_validity,
    round(sum(case when q.at is not null then valid end) / nullif(sum(case when q.at is not null then known end), 0), 9) as temporal_citation_accuracy,
    round(avg(case when q.modality in ('table', 'chart', 'spreadsheet', 'mixed') then cast(grounded as int) end), 9) as multimodal_grounding_rate
  from fx_runs left join dg q using (run_id) group by run_id)"""
DG = f"with {IT}, {ANS}, {EV}"
ALL = f"{DG}, {MET}"
FB = """fb as (select run_id, query_id, case when n % 4 = 0 then 'positive' else 'negative' end as rating, case when n % 5 = 0 then 'STALE_ANSWER' end as correct_label from fx_query_results where n % 6 = 0)"""
LONG = "long as (select run_id, metric, value from (unpivot (select run_id, faithfulness, context_precision, context_recall, answer_relevance, answer_correctness, freshness_validity, multimodal_grounding_rate, latency_p50_ms, avg_cost_usd from met) on columns(* exclude run_id) into name metric value value))"
CATS = "cats(category) as (values " + ", ".join(f"('{c}')" for c in diagnosis.CATEGORIES) + ")"


# --- metrics ----------------------------------------------------------------


@query(f"{ALL} select * from met")
def f10_run_metrics(spark, d):
    return run_metrics(spark, d)


@query("select run_id, " + ", ".join(f"round(avg({c}), 9) as {c}, count({c}) as n_{c}" for c in scalars.SCORES) + " from fx_query_results group by run_id")
def f2_mean_valid(spark, d):
    return metrics.mean_valid(results(spark, d), ["run_id"])


@query(f"with {IT}, {ANS}, u as (" + " union all ".join(f"select run_id, '{c}' as metric, count({c}) as n_scored, count(*) - count({c}) as n_unscored from ans group by run_id" for c in scalars.SCORES) + ") select * from u")
def f4_scored_counts(spark, d):
    return metrics.scored_counts(results(spark, d))


@query("select n, case when n % 5 = 1 then null when n % 5 = 2 then null when n % 5 = 3 then null when n % 5 = 4 then 0.0 else n / 100.0::double end as score from (select event_id as n from events)")
def f1_sanitize_score(spark, d):
    x = F.when(F.col("event_id") % 5 == 1, F.lit("NaN")).when(F.col("event_id") % 5 == 2, "Infinity").when(F.col("event_id") % 5 == 3, "n/a").when(F.col("event_id") % 5 == 4, "0.0").otherwise((F.col("event_id") / 100.0).cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("n"), scalars.sanitize_score(x).alias("score"))


@query(f"{DG} select run_id, round(quantile_cont(latency_ms, 0.5), 9) as latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 9) as latency_p95_ms from ans group by run_id")
def f5_latency_percentiles(spark, d):
    return metrics.latency_percentiles(results(spark, d))


@query(f"{ALL} select a.experiment_id, a.chunking_strategy, a.parsing_strategy, a.freshness_policy, round(x.avg_latency_ms - y.avg_latency_ms, 6) as overhead_ms from fx_runs a join fx_runs b using (experiment_id, chunking_strategy, parsing_strategy, freshness_policy) join met x on x.run_id = a.run_id join met y on y.run_id = b.run_id where a.retrieval_strategy = 'hybrid_reranker' and b.retrieval_strategy = 'hybrid'")
def f11_reranker_overhead(spark, d):
    return metrics.reranker_overhead(runs(spark, d), run_metrics(spark, d)).withColumn("overhead_ms", F.round("overhead_ms", 6))


@query(f"with {IT}, {ANS} select ans.run_id, ans.query_id, coalesce(it.question, '') as question, coalesce(it.ground_truth, '') as ground_truth, 1 as n_contexts from ans left join it on it.id = ans.query_id")
def f3_score_inputs(spark, d):
    rows = results(spark, d).withColumn("contexts", F.array(F.col("query_id"), F.lit(" "), F.lit(None).cast("string")))
    return metrics.score_inputs(rows, items(spark, d)).select("run_id", "query_id", "question", "ground_truth", F.size("contexts").alias("n_contexts"))


@query("with k as (select run_id, max(n % 7) = 6 and max(n) % 3 = 0 as bad from fx_query_results group by run_id), s as (select q.* from fx_query_results q join k using (run_id) where not bad or n % 5 <> 0), w as (select r.run_id, bool_and(s.run_id is not null) as whole from fx_query_results r left join s using (run_id, query_id) group by r.run_id) select run_id, query_id, case when whole then faithfulness end as faithfulness from fx_query_results join w using (run_id)")
def f12_align_scores(spark, d):
    own = results(spark, d)
    bad = own.groupBy("run_id").agg(((F.max(F.col("n") % 7) == 6) & (F.max("n") % 3 == 0)).alias("bad"))
    scores = own.join(bad, "run_id").where("not bad or n % 5 <> 0")
    return metrics.align_scores(own.select("run_id", "query_id"), scores, ["faithfulness"])


@query(f"{ALL} select run_id, faithfulness, case when run_id < 'r_2' then avg_cost_usd end as avg_cost_usd, case when run_id < 'r_2' then 0.25 else 0.5 end::double as diagnostic_accuracy from met")
def a15_upsert_run_metrics(spark, d):
    new = run_metrics(spark, d)
    old = new.select("run_id", F.lit(0.5).alias("faithfulness"), F.lit(1.0).alias("avg_cost_usd"), F.lit(0.5).alias("diagnostic_accuracy"))
    early = F.col("run_id") < "r_2"
    fresh = new.select("run_id", "faithfulness", F.when(early, F.col("avg_cost_usd")).alias("avg_cost_usd"), F.when(early, 0.25).alias("diagnostic_accuracy"))
    return metrics.upsert_run_metrics(old, fresh)


# --- diagnosis --------------------------------------------------------------


@query(f"{DG} select run_id, query_id, failure_category, dated, expired, not_yet_valid, out_of_period, top_out, direction, dominant, nontext, vision, version_mismatch from dg")
def g8_diagnose(spark, d):
    return diagnoses(spark, d).select("run_id", "query_id", "failure_category", "dated", "expired", "not_yet_valid", "out_of_period", "top_out", "direction", "dominant", "nontext", "vision", "version_mismatch")


@query(f"""{DG} select run_id, query_id, concat_ws(',', case when failure_category = 'LOW_RECALL_RETRIEVAL' and faithfulness < 0.4 then 'UNSUPPORTED_SYNTHESIS' end, case when failure_category = 'UNSUPPORTED_SYNTHESIS' and context_precision < 0.3 then 'IRRELEVANT_CONTEXT_POLLUTION' end) as secondary,
concat_ws(',', case when faithfulness is null then 'faithfulness' end, case when context_recall is null then 'context_recall' end, case when context_precision is null then 'context_precision' end, case when answer_correctness is null then 'answer_correctness' end) as missing from dg""")
def g7_secondary_failures(spark, d):
    return diagnoses(spark, d).select("run_id", "query_id", F.array_join("secondary_failures", ",").alias("secondary"), F.array_join("missing", ",").alias("missing"))


@query(f"""{DG} select run_id, count(*) as n, round(avg(cast(failure_category = failure_type as int)), 9) as diagnostic_accuracy,
round(avg(cast(case when failure_category in ('STALE_ANSWER', 'WRONG_VERSION') then 'T' else failure_category end = case when failure_type in ('STALE_ANSWER', 'WRONG_VERSION') then 'T' else failure_type end as int)), 9) as temporal_family_accuracy
from dg where failure_category is not null and failure_type is not null group by run_id""")
def g9_diagnostic_accuracy(spark, d):
    return diagnosis.diagnostic_accuracy(diagnoses(spark, d))


@query(f"{DG}, t as (select count(*) as total, count(*) filter (status = 'error') as errored, count(distinct run_id) as run_count from fx_query_results) select failure_category as category, count(*) as n, any_value(total) as total, any_value(errored) as errored, any_value(run_count) as run_count from dg cross join t group by failure_category")
def g17_failure_summary(spark, d):
    return diagnosis.failure_summary(diagnoses(spark, d), results(spark, d))


@query(f"{DG} select run_id, count(failure_category) as n_diagnosed, round(count(*) filter (failure_category <> 'NO_FAILURE') / nullif(count(failure_category), 0), 9) as failure_rate from dg group by run_id")
def g18_failure_rate(spark, d):
    return diagnosis.failure_rate(diagnoses(spark, d))


@query(f"{DG} select run_id, query_id, failure_category, cast(0.7 as double) as confidence, direction, dated, out_of_period from dg")
def g19_query_diagnosis(spark, d):
    return diagnosis.query_diagnosis(diagnoses(spark, d))


_LACK = "(faithfulness is null or context_recall is null or context_precision is null or answer_correctness is null)"


@query(f"with {IT}, {ANS} select run_id, query_id from ans where run_id in (select run_id from ans where {_LACK})")
def g24_scores_to_compute(spark, d):
    return diagnosis.scores_to_compute(results(spark, d))


@query(f"""with x as (select run_id, case when run_id like '%7' then 'running' when run_id like '%3' then null else 'done' end as status, case when run_id like '%5' then null else 1 end as evaluated_at from fx_runs),
own as (select * from fx_query_results where run_id not like '%9'),
c as (select run_id, count(*) as total, count(*) filter (coalesce(status, 'ok') <> 'error') as ok, count(*) filter (coalesce(status, 'ok') <> 'error' and {_LACK}) as missing from own group by run_id)
select run_id, coalesce(ok, 0) as ok, coalesce(missing, 0) as missing, case when missing > 0 then ok else 0 end as will_rescore,
case when x.status is distinct from 'done' then 'status is ' || coalesce(x.status, 'unknown') when evaluated_at is null then 'not evaluated' when coalesce(total, 0) = 0 then 'no results' end as reason from x left join c using (run_id)""")
def g20_rediagnosis_plan(spark, d):
    ends = lambda c: F.col("run_id").endswith(c)
    own = runs(spark, d).withColumns({"status": F.when(ends("7"), "running").when(~ends("3"), "done"), "evaluated_at": F.when(~ends("5"), 1)})
    return diagnosis.rediagnosis_plan(own, results(spark, d).where(~ends("9")))


@query(f"{DG} select run_id, query_id, coalesce(failure_category, 'UNDIAGNOSED') as category from dg where n % 3 <> 0")
def g25_reasoning_todo(spark, d):
    cached = results(spark, d).where("n % 3 < 2").select("run_id", "query_id", (F.col("n") % 3 == 1).alias("parse_error"))
    return diagnosis.reasoning_todo(diagnoses(spark, d), cached)


_LABELS = f"""{DG}, {FB}, t as (select dg.*, rating, correct_label from dg left join fb using (run_id, query_id) where failure_category is not null and not {_LACK}),
l as (select *, case when rating = 'positive' then 'NO_FAILURE' when correct_label is not null then correct_label when failure_category <> 'NO_FAILURE' and failure_type in (select category from cats) then failure_type else failure_category end as label,
case when rating = 'positive' or correct_label is not null then 'feedback' when failure_category <> 'NO_FAILURE' and failure_type in (select category from cats) then 'eval_set' else 'classifier' end as source from t where coalesce(failure_type, '') <> 'UNANSWERABLE')""".replace("with ", f"with {CATS}, ", 1)


@query(f"""{_LABELS}
select run_id, query_id, label, source, round(least(latency_ms / 10000, 1), 6) as f_latency, cast(case when modality in ('mixed', 'spreadsheet') then 'table' else modality end = 'table' as int) as f_is_table from l""")
def g13_training_set(spark, d):
    own = diagnosis.training_set(diagnoses(spark, d), feedback(spark, d))
    return own.select("run_id", "query_id", "label", "source", F.round("f_latency", 6).alias("f_latency"), F.col("f_is_table").cast("int").alias("f_is_table"))


@query(f"""{_LABELS}, c as (select source, count(*) as n from l group by source), b as (select *, sum(n) over () as total, row_number() over (order by n desc, case source when 'feedback' then 0 when 'eval_set' then 1 else 2 end) = 1 as dominant from c)
select source, n, round(n / total, 9) as share, dominant, case when dominant and source = 'classifier' then printf('%.0f', n / total * 100) || '% of the labels are the classifier''s own' end as warning from b""")
def g14_label_source_summary(spark, d):
    return diagnosis.label_source_summary(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)))


@query(f"""{_LABELS}, o as (select dg.*, {_LACK} as short, coalesce(failure_type = 'UNANSWERABLE', false) as odd from dg where failure_category is not null),
k as (select count(*) filter (short) as missing_scores, count(*) filter (not short and odd) as unanswerable from o)
select missing_scores, unanswerable, count(*) as rows, count(*) filter (label <> failure_category) as overrides, count(*) filter (rating = 'positive') as positive_ratings from l cross join k group by all""")
def g13_training_counts(spark, d):
    return diagnosis.training_counts(diagnoses(spark, d), feedback(spark, d))


@query()
def g15_classifier_report(spark, d):
    own = ml.prepared(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)))
    return ml.report(ml.train_classifier(own), own)


@query()
def g15_accuracy(spark, d):
    own = ml.prepared(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)))
    return ml.accuracy(ml.train_classifier(own), own)


@query()
def g15_importances(spark, d):
    own = ml.prepared(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)))
    return ml.importances(ml.train_classifier(own), spark)


@query(f"""{_LABELS}, c as (select label, count(*) as n, sum(count(*)) over () as m, (sum(count(*)) over () + 4) // 5 as want from l group by label),
p as (select *, n * want // m as least, n * want % m as rest from c)
select label, n, cast(least + case when row_number() over (order by rest desc, label) <= want - sum(least) over () then 1 else 0 end as bigint) as held from p""")
def g15_split(spark, d):
    """How many rows of each label the split holds out."""
    own = ml.prepared(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)).select("run_id", "query_id", "label"))
    return own.groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held"))


@query()
def g15_permutation_importances(spark, d):
    own = ml.prepared(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)))
    return ml.permutation_importances(ml.train_classifier(own), own)


@query()
def g15_reliability(spark, d):
    own = ml.prepared(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)))
    return ml.reliability(ml.train_classifier(own), own)


@query()
def g16_predict(spark, d):
    own = ml.prepared(diagnosis.training_set(diagnoses(spark, d), feedback(spark, d)))
    return ml.predict(ml.train_classifier(own), own)


_DESCRIBED = "case failure_category " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in diagnosis.DESCRIPTIONS.items()) + " else 'UNDIAGNOSED' end"


#: Texts of 2^11 documents are looked up together; answers mostly name documents that are near each other.
NEAR_BITS = 11


@query(f"""{DG}, shown as (select run_id, query_id, string_agg('Chunk ' || rank || ' (' || concat_ws(', ', 'type=' || coalesce(chunk_type, 'text'), 'file=' || filename, 'version=' || doc_version, 'page=' || page) || '):' || chr(10) || substring(coalesce(content, ''), 1, 400), chr(10) order by rank) filter (rank <= 5) as chunks from fx_retrieved group by all)
select run_id, query_id, concat('# Question', chr(10), coalesce(i.question, ''), chr(10), chr(10), '# Answer', chr(10), coalesce(generated_answer, ''), chr(10), chr(10), '# Chunks', chr(10), coalesce(chunks, ''), chr(10), chr(10), '# Metrics', chr(10),
  concat_ws(chr(10), 'faithfulness: ' || printf('%.3f', faithfulness), 'context_recall: ' || printf('%.3f', context_recall), 'context_precision: ' || printf('%.3f', context_precision), 'answer_correctness: ' || printf('%.3f', answer_correctness)),
  chr(10), chr(10), '# Category', chr(10), coalesce(failure_category, 'UNDIAGNOSED'), chr(10), {_DESCRIBED}) as prompt
from dg left join fx_eval_items i on i.id = query_id left join shown using (run_id, query_id)""")
def g22_reasoning_prompt(spark, d):
    own = settled(diagnosis.prompt_rows(diagnoses(spark, d, keyed=True)))
    document = lambda chunk_id: F.substring_index(chunk_id, "#", 1).cast("long")
    texts = view(spark, d, "fx_chunks_keyed").select("chunk_id", "text_key", "filename", "doc_version", "chunk_type", "page", "content")
    shown = diagnosis.with_texts(own, texts, lambda chunk_id: F.shiftright(document(chunk_id), NEAR_BITS))
    return diagnosis.reasoning_prompt(shown, items(spark, d))


@query("""with e as (select event_id as id, event_id % 3 as k from events)
select id, k = 2 as parse_error, case k when 0 then 'a|b' when 1 then '' else 'no structured response' end as steps, case k when 0 then concat('cause ', id) when 1 then '' else substring(concat(repeat('free text ', 60), id), 1, 500) end as root_cause,
case k when 0 then 'fix' when 1 then '' else 'read the raw response' end as fix_suggestion, case when k = 2 then 'the analysis gave no structured result' else '' end as stakeholder_summary, case k when 0 then cast(0.25 as double) end as confidence from e""")
def g23_parse_reasoning(spark, d):
    n = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('\n{"reasoning_steps": ["a", "b"], "root_cause": "cause '), n, F.lit('", "fix_suggestion": "fix", "confidence": 0.25}'))).when(F.col("event_id") % 3 == 1, F.lit("{}")).otherwise(F.concat(F.lit("free text " * 60), n))
    own = diagnosis.parse_reasoning(table(spark, d, "events").select(F.col("event_id").alias("id"), raw.alias("raw")))
    return own.select("id", "parse_error", F.array_join("reasoning_steps", "|").alias("steps"), "root_cause", "fix_suggestion", "stakeholder_summary", "confidence")


# --- ranking ----------------------------------------------------------------


@query(f"{DG}, u as (select run_id, count(*) as u from dg where failure_category is null group by run_id), c as (select run_id, count(*) as total, count(*) filter (status = 'error') as errored, count(*) filter (coalesce(status, 'ok') <> 'error' and answer_correctness is null) as s from fx_query_results group by run_id) select run_id, coalesce(total, 0) as total, coalesce(errored, 0) as errored, coalesce(s, 0) as unscored, coalesce(u, 0) as undiagnosed from fx_runs left join c using (run_id) left join u using (run_id)")
def h1_query_counts(spark, d):
    return ranking.query_counts(runs(spark, d), results(spark, d), diagnoses(spark, d))


@query(f"{ALL} select run_id, latency_p50_ms, row_number() over (order by latency_p50_ms asc nulls last, run_id) as rank from met where run_id not like '%5'")
def h2_leaderboard(spark, d):
    states = runs(spark, d).withColumn("status", F.when(F.col("run_id").endswith("5"), "running").otherwise("done"))
    return ranking.leaderboard(run_metrics(spark, d), "latency_p50_ms", states).select("run_id", "latency_p50_ms", "rank")


@query("select run_id from fx_runs where retrieval_strategy = 'vector_only' and chunking_strategy = 'recursive' and parsing_strategy = 'text_only' and freshness_policy = 'none'")
def h4_baseline(spark, d):
    return runs(spark, d).where(ranking.is_baseline()).select("run_id")


_DELTA = f"""{ALL}, {LONG}, b as (select metric, value as base from long where run_id = (select min(run_id) from fx_runs where retrieval_strategy = 'vector_only' and chunking_strategy = 'recursive' and parsing_strategy = 'text_only' and freshness_policy = 'none')),
dl as (select l.run_id, l.metric, l.value, base, round(l.value - base, 9) as delta, case when base = 0 then case when round(l.value - base, 9) = 0 then 0.0 else 100.0 end else round(round(l.value - base, 9) / abs(base) * 100, 2) end as relative_pct,
case when l.metric in ('latency_p50_ms', 'avg_cost_usd') then round(l.value - base, 9) < 0 else round(l.value - base, 9) > 0 end as improved
from long l join b using (metric) where l.run_id <> (select min(run_id) from fx_runs where retrieval_strategy = 'vector_only' and chunking_strategy = 'recursive' and parsing_strategy = 'text_only' and freshness_policy = 'none'))"""
def _deltas(spark, d):
    base = runs(spark, d).where(ranking.is_baseline()).agg(F.min("run_id")).first()[0]
    return ranking.baseline_deltas(run_metrics(spark, d), base)


@query(f"{_DELTA} select * from dl")
def h5_baseline_deltas(spark, d):
    return _deltas(spark, d)


_PLACE = "case metric " + " ".join(f"when '{m}' then {k}" for k, m in enumerate(ranking.SORTABLE)) + " end"


@query(f"{_DELTA} select run_id, count(*) filter (improved) as improvements, count(*) filter (not improved and delta <> 0) as regressions, 9 - count(*) as not_compared, arg_max(metric, relative_pct * 1000 - {_PLACE}) as top_improvement, max(relative_pct) as top_change from dl group by run_id")
def h6_comparison_summary(spark, d):
    return ranking.comparison_summary(_deltas(spark, d))


@query(f"""{_DELTA}, o as (select run_id, round(0.4 * faithfulness + 0.3 * answer_correctness + 0.2 * context_recall, 9) as v from met where run_id <> (select min(run_id) from fx_runs where retrieval_strategy = 'vector_only' and chunking_strategy = 'recursive' and parsing_strategy = 'text_only' and freshness_policy = 'none')),
top as (select run_id from o where v is not null order by v desc, run_id limit 1)
select (select min(run_id) from fx_runs where retrieval_strategy = 'vector_only' and chunking_strategy = 'recursive' and parsing_strategy = 'text_only' and freshness_policy = 'none') as baseline_id, run_id, cast(null as varchar) as error, count(*) filter (improved) as improvements, count(*) filter (not improved and delta <> 0) as regressions, 9 - count(*) as not_compared, arg_max(metric, relative_pct * 1000 - {_PLACE}) as top_improvement, max(relative_pct) as top_change from dl join top using (run_id) group by run_id""")
def h6_baseline_comparison(spark, d):
    return ranking.baseline_comparison(runs(spark, d), run_metrics(spark, d))


_RECOMMENDED = f"""{ALL}, j as (select * from fx_runs join met using (run_id)),
o as (select 'lowest_cost' as objective, run_id, avg_cost_usd as value, row_number() over (order by round(avg_cost_usd, 9), run_id) as k from j where avg_cost_usd is not null
union all select 'best_latency', run_id, latency_p50_ms, row_number() over (order by round(latency_p50_ms, 9), run_id) from j where latency_p50_ms is not null
union all select 'best_faithfulness', run_id, faithfulness, row_number() over (order by round(faithfulness, 9) desc, run_id) from j where faithfulness is not null
union all select 'best_for_tables', run_id, multimodal_grounding_rate, row_number() over (order by round(multimodal_grounding_rate, 9) desc, run_id) from j where multimodal_grounding_rate is not null and parsing_strategy = 'text_table'
union all select 'best_for_drift', run_id, freshness_validity, row_number() over (order by round(freshness_validity, 9) desc, run_id) from j where freshness_validity is not null and freshness_policy <> 'none'
union all select 'best_for_long_pdfs', run_id, context_recall, row_number() over (order by round(context_recall, 9) desc, run_id) from j where context_recall is not null and parsing_strategy = 'text_table'
union all select 'best_overall', run_id, v, row_number() over (order by round(v, 9) desc, run_id) from (select run_id, 0.4 * faithfulness + 0.3 * answer_correctness + 0.2 * context_recall + 0.1 * (1 - avg_cost_usd / max(avg_cost_usd) over ()) as v from j where faithfulness is not null and answer_correctness is not null and context_recall is not null and avg_cost_usd is not null))"""


@query(f"""{_RECOMMENDED}
select objective, 'ok' as status, run_id, round(value, 9) as value from o where k = 1""")
def h7_recommend(spark, d):
    return ranking.recommend(runs(spark, d), run_metrics(spark, d))


@query(f"{ALL} select run_id, concat(retrieval_strategy, ' + ', chunking_strategy, ': faithfulness ', coalesce(printf('%.3f', floor(faithfulness * 1000 + 0.5) / 1000), 'n/a'), ', correctness ', coalesce(printf('%.3f', floor(answer_correctness * 1000 + 0.5) / 1000), 'n/a'), ', p50 ', coalesce(printf('%.0f', floor(latency_p50_ms + 0.5)), 'n/a'), ' ms') as rationale from fx_runs join met using (run_id)")
def h8_explain_run(spark, d):
    return ranking.explain_run(runs(spark, d), run_metrics(spark, d))


@query(f"""{_RECOMMENDED}
select objective, 'ok' as status, run_id, round(value, 9) as value, case objective
  when 'best_overall' then printf('best overall: composite of faithfulness, correctness, recall and cost %.2f', value)
  when 'lowest_cost' then printf('lowest mean cost of a query: $%.4f', value)
  when 'best_latency' then printf('fastest median answer: %.0f ms', value)
  when 'best_faithfulness' then printf('highest faithfulness: %.3f', value)
  when 'best_for_tables' then printf('best for tables and sheets: grounding rate %.3f with parsing ', value) || parsing_strategy
  when 'best_for_drift' then printf('best under temporal drift: freshness validity %.3f with policy ', value) || freshness_policy
  else printf('best for long documents: context recall %.3f with parsing ', value) || parsing_strategy end as rationale
from o join fx_runs using (run_id) where k = 1
union all select 'best_of_luck', 'ok', min(run_id), 0.0, 'chosen by default for best_of_luck' from j""")
def h8_explain_recommendations(spark, d):
    known = ranking.recommend(runs(spark, d), run_metrics(spark, d), [*ranking.OBJECTIVES, "best_of_luck"])
    return ranking.explain_recommendations(known, runs(spark, d))


@query(f"{ALL} select run_id, row_number() over (order by faithfulness desc, run_id) as rank, faithfulness as value from met where faithfulness is not null qualify rank <= 10")
def h21_top_k_chart(spark, d):
    return ranking.top_k_chart(run_metrics(spark, d), "faithfulness")


@query(f"{ALL}, {LONG} select run_id, metric, value from long where metric not in ('latency_p50_ms', 'avg_cost_usd')")
def h21_radar(spark, d):
    return ranking.radar(run_metrics(spark, d))


@query(f"{ALL}, {LONG}, v as (select *, case when metric like 'latency%' then 1 - value / 5000 when metric = 'avg_cost_usd' then 1 - value / 0.05 else value end as x from long) select run_id, metric, value, case when x >= 0.7 then 'good' when x >= 0.4 then 'fair' else 'poor' end as band from v")
def h22_score_band(spark, d):
    return ranking.score_band(ranking.long_metrics(run_metrics(spark, d), list(ranking.SORTABLE)))


@query(f"""{ALL}, e as (select experiment_id, bool_and(run_id not like '%55') as done from fx_runs group by 1)
select (select count(*) from fx_documents) as documents, (select count(*) from fx_documents where cast(doc_id as bigint) % 5 <> 0) as indexed, (select count(effective_from) from fx_documents) as dated, (select count(*) from e) as experiments, (select count(*) filter (done) from e) as completed,
(select count(*) from fx_runs) as runs, (select count(faithfulness) from met) as evaluated_runs, (select run_id from met where faithfulness is not null order by faithfulness desc, run_id limit 1) as best_run""")
def h20_overview_kpis(spark, d):
    docs = view(spark, d, "fx_documents").withColumn("parse_status", F.when(F.col("doc_id").cast("long") % 5 != 0, "done").otherwise("failed"))
    states = runs(spark, d).withColumns({"status": F.when(F.col("run_id").endswith("55"), "running").otherwise("done")})
    experiments = lifecycle.experiment_status(states).select("experiment_id", F.coalesce("next_status", F.lit("running")).alias("status"))
    return ranking.overview_kpis(docs, states, run_metrics(spark, d), experiments)


# --- reports ----------------------------------------------------------------


@query(f"with {FB} select run_id, count(*) filter (rating = 'positive') as positive, count(*) filter (rating = 'negative') as negative, count(rating) as total, round(count(rating) / count(*), 3) as coverage from fx_query_results left join fb using (run_id, query_id) group by run_id")
def h9_feedback_summary(spark, d):
    return reporting.feedback_summary(results(spark, d), feedback(spark, d))


@query("select run_id, query_id, case when n % 4 = 0 then 'positive' else 'negative' end as rating, case when n % 5 = 0 then 'STALE_ANSWER' end as correct_label, case when n % 12 = 0 and coalesce(status, 'ok') <> 'error' then n + 1 else n end as created_at from fx_query_results where n % 6 = 0")
def h10_upsert_feedback(spark, d):
    old = feedback(spark, d)
    new = old.where("created_at % 12 = 0")
    both = new.withColumn("created_at", F.col("created_at") + 1).union(new).union(new.withColumn("rating", F.lit("unknown")))
    return reporting.upsert_feedback(old, both, results(spark, d))


@query(f"{ALL}, c as (select run_id, count(*) filter (coalesce(status, 'ok') <> 'error') as n_answers, count(*) filter (status = 'error') as n_error, count(*) filter (coalesce(status, 'ok') <> 'error' and answer_correctness is null) as n_unscored from fx_query_results group by run_id), u as (select run_id, count(*) filter (failure_category is null) as n_undiagnosed from dg group by run_id) select r.run_id, retrieval_strategy, faithfulness, avg_cost_usd, coalesce(n_answers, 0) as n_answers, coalesce(n_error, 0) as n_error, coalesce(n_unscored, 0) as n_unscored, coalesce(n_undiagnosed, 0) as n_undiagnosed from fx_runs r left join met using (run_id) left join c using (run_id) left join u using (run_id)")
def h11_report_runs(spark, d):
    return reporting.report_runs(runs(spark, d), run_metrics(spark, d), results(spark, d), diagnoses(spark, d)).select("run_id", "retrieval_strategy", "faithfulness", "avg_cost_usd", "n_answers", "n_error", "n_unscored", "n_undiagnosed")


_MEANS = ", ".join(f"round(avg({c}) filter (ok), 9) as {c}, count({c}) filter (ok) as n_{c}" for c in scalars.SCORES)


@query(f"""with j as (select r.*, coalesce(i.modality, 'None') as modality, coalesce(cast(i.answerable as varchar), 'false') as answerable, coalesce(status, 'ok') <> 'error' as ok from fx_query_results r left join fx_eval_items i on i.id = r.query_id)
select run_id, 'modality' as grouping, modality as value, count(*) as n, count(*) filter (not ok) as n_error, {_MEANS} from j group by all
union all select run_id, 'answerable', answerable, count(*), count(*) filter (not ok), {_MEANS} from j group by all""")
def h12_report_by_group(spark, d):
    return reporting.report_by_group(results(spark, d), items(spark, d))


@query(f"{DG}, f as (select run_id, failure_category as category, count(*) as n from dg where failure_category is not null group by all), t as (select run_id, sum(n) as n_diagnosed from f group by run_id) select run_id, category, coalesce(n, 0) as n, cast(coalesce(n_diagnosed, 0) as bigint) as n_diagnosed from fx_runs cross join cats left join f using (run_id, category) left join t using (run_id)".replace("with ", f"with {CATS}, ", 1).replace("select run_id, category, coalesce", "select fx_runs.run_id, cats.category, coalesce"))
def h13_report_failures(spark, d):
    return reporting.report_failures(runs(spark, d), diagnoses(spark, d)).select("run_id", "category", "n", "n_diagnosed")


@query(f"{DG} select r.run_id, count(*) as n, count(*) filter (r.status = 'error') as n_error, count(r.answer_correctness) filter (coalesce(r.status, 'ok') <> 'error') as n_scored, round(avg(r.answer_correctness) filter (coalesce(r.status, 'ok') <> 'error'), 9) as answer_correctness, count(failure_category) as n_diagnosed, count(*) filter (failure_category = 'STALE_ANSWER') as n_stale, count(*) filter (failure_category = 'WRONG_VERSION') as n_wrong_version from fx_query_results r join it on it.id = r.query_id and it.temporal_pair_id is not null left join dg on dg.run_id = r.run_id and dg.query_id = r.query_id group by r.run_id")
def h14_report_temporal(spark, d):
    return reporting.report_temporal(results(spark, d), items(spark, d), diagnoses(spark, d))


@query("with x as (select * from fx_query_results union all select * from fx_query_results where n % 31 = 0), i as (select * from fx_eval_items where ord % 9 <> 0) select distinct 'unmatched' as issue, run_id, query_id from x where query_id not in (select id from i) union all select 'duplicate', run_id, query_id from x group by run_id, query_id having count(*) > 1")
def h15_join_integrity(spark, d):
    own = view(spark, d, "fx_query_results")
    return reporting.join_integrity(own.union(own.where("n % 31 = 0")), items(spark, d).where("ord % 9 <> 0"))


@query(f"{DG}, c as (select 'missing' as issue, run_id, id as query_id from fx_runs cross join fx_eval_items where (run_id, id) not in (select (run_id, query_id) from fx_query_results) union all select 'errored', run_id, query_id from fx_query_results where status = 'error' union all select 'unscored', run_id, query_id from ans where answer_correctness is null union all select 'undiagnosed', run_id, query_id from dg where failure_category is null union all select 'empty_run', run_id, null from fx_runs where run_id not in (select run_id from fx_query_results)) select * from c")
def h16_completeness(spark, d):
    return reporting.completeness(runs(spark, d), results(spark, d), items(spark, d), diagnoses(spark, d))


@query(f"{DG}, b as (select r.run_id, retrieval_strategy, count(*) as n, avg(faithfulness) as x, count(*) > 5 as many from dg join fx_runs r using (run_id) where failure_category = 'NO_FAILURE' group by all) select run_id, retrieval_strategy, cast(n as varchar) as n, coalesce(printf('%.6f', x), '') as faithfulness, cast(many as varchar) as many from b")
def a16_report_cells(spark, d):
    own = diagnoses(spark, d).where("failure_category = 'NO_FAILURE'").groupBy("run_id").agg(F.count("*").alias("n"), F.avg("faithfulness").alias("faithfulness"), (F.count("*") > 5).alias("many"))
    cells = reporting.csv_cells(own.join(runs(spark, d), "run_id").select("run_id", "retrieval_strategy", "n", "faithfulness", "many"))
    return cells.withColumn("faithfulness", F.coalesce(F.format_string("%.6f", F.col("faithfulness").try_cast("double")), F.lit("")))


# --- lifecycle and accounting -----------------------------------------------


def _experiments(spark, d):
    own = table(spark, d, "orders").select(F.concat(F.lit("e_"), (F.col("o_orderkey") % 50).cast("string")).alias("experiment_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 50 < 10, F.when(F.col("o_orderstatus") == "O", "running").otherwise("done")).when(F.col("o_orderkey") % 50 < 20, "failed").otherwise("done").alias("status"), F.when(F.col("o_orderkey") % 50 < 40, 1).alias("evaluated_at"), F.when(F.col("o_orderkey") % 50 < 30, 1).alias("diagnosed_at"))
    return own


_EXP = "with e as (select concat('e_', cast(o_orderkey % 50 as varchar)) as experiment_id, o_orderkey as run_id, case when o_orderkey % 50 < 10 then case when o_orderstatus = 'O' then 'running' else 'done' end when o_orderkey % 50 < 20 then 'failed' else 'done' end as status, case when o_orderkey % 50 < 40 then 1 end as evaluated_at, case when o_orderkey % 50 < 30 then 1 end as diagnosed_at from orders)"


_NEXT = "case when bool_or(status in ('pending', 'running')) then null when count(*) filter (status = 'done') = 0 then 'failed' when bool_and(status <> 'done' or diagnosed_at is not null) then 'done' when bool_and(status <> 'done' or evaluated_at is not null) then 'diagnosing' else 'evaluating' end"


@query(f"{_EXP} select experiment_id, {_NEXT} as next_status from e group by experiment_id")
def h17_experiment_status(spark, d):
    return lifecycle.experiment_status(_experiments(spark, d))


@query(f"{_EXP}, x as (select experiment_id, case when min(run_id) % 2 = 0 then 'running' else 'created' end as status, {_NEXT} as next_status from e group by experiment_id) select experiment_id, case when status = 'running' then coalesce(next_status, status) else status end as status from x")
def h17_moved(spark, d):
    own = _experiments(spark, d)
    states = own.groupBy("experiment_id").agg(F.when(F.min("run_id") % 2 == 0, "running").otherwise("created").alias("status"))
    return lifecycle.moved(states, own)


@query(f"{_EXP} select experiment_id, count(*) filter (status = 'done') as done, count(*) as runs from e group by experiment_id")
def h25_experiment_progress(spark, d):
    return lifecycle.experiment_progress(_experiments(spark, d))


@query("select run_id, query_id, n from fx_query_results where run_id = 'r_3'")
def h19_run_trace(spark, d):
    own = runs(spark, d).withColumn("experiment_id", F.lit("e"))
    return lifecycle.run_trace(view(spark, d, "fx_query_results"), own, "e", "r_3").select("run_id", "query_id", "n")


_BUDGET = 0.004


@query(f"with c as (select *, round(input_tokens * 0.15 / 1e6 + output_tokens * 0.6 / 1e6, 9) as cost from fx_query_results), s as (select *, coalesce(sum(cast(cost as decimal(18, 9))) over (partition by run_id order by n, query_id rows between unbounded preceding and 1 preceding), 0) > 0.004 as over from c) select run_id, query_id, case when over then 'error' else status end as status, case when over then 0.0 else cost end as cost_usd from s")
def e5_apply_budget(spark, d):
    return accounting.apply_budget(results(spark, d), _BUDGET).select("run_id", "query_id", "status", "cost_usd")


@query("with x as (select *, run_id like '%3' and n % 50 = 3 as over from fx_query_results) select run_id, count(*) as total, count(*) filter (status = 'error' or over) as errored, count(*) filter (over) as skipped, case when bool_or(over) or 2 * count(*) filter (status = 'error' or over) > count(*) then 'failed' else 'done' end as status from x group by run_id")
def e6_run_outcome(spark, d):
    over = F.col("run_id").endswith("3") & (F.col("n") % 50 == 3)
    own = view(spark, d, "fx_query_results").withColumns({"error_message": F.when(over, "budget exceeded"), "status": F.when(over, "error").otherwise(F.col("status"))})
    return lifecycle.run_outcome(own)


@query("select run_id, query_id, round(input_tokens * 5.0 / 1e6 + output_tokens * 15.0 / 1e6, 9) as cost_usd from fx_query_results")
def e2_token_cost(spark, d):
    return accounting.token_cost(view(spark, d, "fx_query_results").withColumn("llm_model", F.lit("unknown"))).select("run_id", "query_id", "cost_usd")


@query("select event_id as id, case when event_id % 3 = 0 then event_id when event_id % 3 = 1 then event_id + 1 else 0 end as input_tokens, 0 as output_tokens from events")
def e3_token_usage(spark, d):
    n = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"usage_metadata": {"input_tokens": '), n, F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"response_metadata": {"token_usage": {"prompt_tokens": '), (F.col("event_id") + 1).cast("string"), F.lit("}}}"))).otherwise(F.lit("{}"))
    return accounting.token_usage(table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("response"))).drop("response")


@query("select conv_id, string_agg(coalesce(text, ''), '' order by turn, role) as answer from conversations group by conv_id")
def e4_flatten_answer(spark, d):
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("parts"))
    return own.select("conv_id", accounting.flatten_answer("parts").alias("answer"))


@query("select id, concat('Context:' || chr(10), ground_truth, chr(10) || chr(10) || 'Question: ', question, chr(10) || 'Answer:') as prompt from fx_eval_items")
def e1_render_prompt(spark, d):
    return items(spark, d).select("id", accounting.render_prompt(F.col("ground_truth"), F.col("question")).alias("prompt"))


# --- configurations and evaluation sets -------------------------------------


def _values(name, values):
    return f"(values {', '.join(f'({chr(39)}{v}{chr(39)})' for v in values)}) {name}({name})"


@query("select id, " + ", ".join(configs.AXES) + " from fx_eval_items cross join " + " cross join ".join(_values(k, v) for k, v in configs.AXES.items()))
def c1_plan_full_matrix(spark, d):
    return configs.plan_runs(configs.config_matrix(spark), items(spark, d).select("id")).select("id", *configs.AXES)


@query("select id, " + ", ".join(configs.MVP) + ", retrieval_strategy = 'hybrid_reranker' as reranker_enabled from fx_eval_items cross join " + " cross join ".join(_values(k, v) for k, v in configs.MVP.items()))
def c4_plan_preset(spark, d):
    return configs.plan_runs(configs.config_matrix(spark, configs.MVP), items(spark, d).select("id")).select("id", *configs.MVP, "reranker_enabled")


_ITEMS = """i as (select case when ord % 11 = 3 then concat('q_', cast(ord - 1 as varchar)) else id end as id, case when ord % 10 = 0 then chr(10) || ' ' else question end as question, ground_truth, valid_from,
case when ord % 4 = 0 then '2020-01-01' when ord % 9 = 2 then '2024-02-30' end as valid_to, case when ord % 13 = 0 then 'video' else modality end as modality, case ord % 3 when 0 then 'easy' when 1 then 'trivial' end as difficulty, failure_type, answerable,
ord % 14 <> 0 as answerable_valid, ord % 15 <> 0 as evidence_valid, ord % 16 = 0 as extra_cells, case when ord % 3 = 0 then null when ord % 6 = 1 then ['a', ' '] when ord % 6 = 2 then [] else ['f_' || cast(ord % 8 as varchar)] end as source_docs, temporal_pair_id, ord from fx_eval_items),
f as (select *, min(ord) over (partition by id) as first, case when regexp_full_match(valid_from, '\\d{4}-\\d{2}-\\d{2}') then try_cast(valid_from as date) end as a, case when regexp_full_match(valid_to, '\\d{4}-\\d{2}-\\d{2}') then try_cast(valid_to as date) end as b from i)"""
_DATES = "select ord, id, 'valid_from' as field, 'not a date' as message from f where valid_from is not null and a is null union all select ord, id, 'valid_to', 'not a date' from f where valid_to is not null and b is null union all select ord, id, 'valid_to', 'before valid_from' from f where a > b"
_KINDS = "select ord, id, 'modality', 'unknown' from f where modality = 'video' union all select ord, id, 'difficulty', 'unknown' from f where difficulty = 'trivial' union all select ord, id, 'id', '@dup' from f where first < ord"


def _faulty(spark, d):
    n = F.col("ord")
    on = lambda k, r=0: n % k == r
    texts = lambda *x: F.array(*x).cast("array<string>")
    return items(spark, d).withColumns({"id": F.when(on(11, 3), F.concat(F.lit("q_"), (n - 1).cast("string"))).otherwise(F.col("id")), "question": F.when(on(10), "\n ").otherwise(F.col("question")), "valid_to": F.when(on(4), "2020-01-01").when(on(9, 2), "2024-02-30"), "modality": F.when(on(13), "video").otherwise(F.col("modality")), "difficulty": F.when(on(3), "easy").when(on(3, 1), "trivial"), "answerable_valid": ~on(14), "evidence_valid": ~on(15), "extra_cells": on(16), "source_docs": F.when(~on(3), F.when(on(6, 1), texts(F.lit("a"), F.lit(" "))).when(on(6, 2), texts()).otherwise(texts(F.concat(F.lit("f_"), (n % 8).cast("string")))))})


@query(f"""with {_ITEMS} {_DATES} union all {_KINDS.replace("'@dup'", "concat('duplicate, first seen in row ', first)")} union all select ord, id, 'question', 'required' from f where ord % 10 = 0 union all select ord, id, 'source_docs', 'not a list of names' from f where ord % 6 = 1 and ord % 3 <> 0
union all select ord, id, 'answerable', 'not a boolean' from f where not answerable_valid union all select ord, id, 'evidence', 'neither object nor text' from f where not evidence_valid union all select ord, id, null, 'more cells than the header' from f where extra_cells""")
def c5_validate_eval_items(spark, d):
    return evalsets.validate_eval_items(_faulty(spark, d))


@query(f"""with {_ITEMS} {_DATES} union all {_KINDS.replace('@dup', 'duplicate')} union all select ord, id, 'question', 'empty' from f where ord % 10 = 0 union all select ord, id, 'source_docs', 'missing' from f where source_docs is null union all select ord, id, 'difficulty', 'missing' from f where difficulty is null
union all select ord, id, 'failure_type', 'unknown' from f where failure_type = 'NO_FAILURE' union all select ord, id, 'failure_type', 'unanswerable' from f where not answerable and failure_type <> 'UNANSWERABLE' union all select ord, id, 'source_docs', 'answerable without documents' from f where answerable and len(source_docs) = 0
union all select ord, id, 'source_docs', 'not in the manifest: ' || x from (select ord, id, unnest(source_docs) as x from f) where x not in ('f_1', 'f_4', 'a')""")
def c6_validate_strict(spark, d):
    return evalsets.validate_eval_items_strict(_faulty(spark, d), numbers([("f_1",), ("f_4",), ("a",)], "filename string", spark))


@query("select distinct concat('doc_', cast(item_id * 40 as varchar), '.html') as filename from benchmark where concat('doc_', cast(item_id * 40 as varchar), '.html') not in (select filename from fx_documents)")
def c7_unmatched_source_docs(spark, d):
    own = table(spark, d, "benchmark").select(F.array(F.concat(F.lit("doc_"), (F.col("item_id") * 40).cast("string"), F.lit(".html"))).alias("source_docs"))
    return evalsets.unmatched_source_docs(own, view(spark, d, "fx_documents"))


@query("select * exclude (source_docs) from fx_eval_items where temporal_pair_id is not null")
def c10_subset_temporal(spark, d):
    return evalsets.subset_temporal(items(spark, d)).drop("source_docs")


@query("select id from fx_eval_items where temporal_pair_id is null and answerable and modality in ('table', 'chart', 'spreadsheet')")
def c10_subset_multimodal(spark, d):
    return evalsets.subset_multimodal(items(spark, d)).select("id")


@query("""with p as (select temporal_pair_id from fx_eval_items where temporal_pair_id is not null order by ord limit 1), k as (select min(ord) as ord from fx_eval_items where answerable and modality in ('table', 'chart') group by modality union all select min(ord) from fx_eval_items where not answerable)
select id from fx_eval_items where temporal_pair_id in (select temporal_pair_id from p) or ord in (select ord from k)""")
def c10_subset_smoke(spark, d):
    return evalsets.subset_smoke(items(spark, d)).select("id")


@query("""with p as (select temporal_pair_id from fx_eval_items where temporal_pair_id is not null group by 1 order by min(ord) limit 8), w(class, wanted) as (values ('unanswerable', 6), ('table', 800), ('spreadsheet', 4), ('chart', 6), ('pairs', 8)),
h as (select case when not answerable then 'unanswerable' else modality end as class, count(*) as held from fx_eval_items where coalesce(temporal_pair_id, '') not in (select temporal_pair_id from p) group by 1 union all select 'pairs', count(distinct temporal_pair_id) from fx_eval_items)
select class, wanted, coalesce(held, 0) as held from w left join h using (class) where coalesce(held, 0) < wanted""")
def c10_core_shortfalls(spark, d):
    return evalsets.core_shortfalls(items(spark, d), counts=evalsets.CORE_COUNTS | {"table": 800})


@query("""with p as (select temporal_pair_id from fx_eval_items where temporal_pair_id is not null group by 1 order by min(ord) limit 8),
k as (select id, ord, case when not coalesce(answerable, true) then 'unanswerable' else modality end as kind from fx_eval_items where coalesce(temporal_pair_id, '') not in (select temporal_pair_id from p)),
r as (select id, row_number() over (partition by kind order by ord) as n, kind from k)
select id from fx_eval_items where temporal_pair_id in (select temporal_pair_id from p) union all select id from r where n <= case kind when 'unanswerable' then 6 when 'table' then 8 when 'spreadsheet' then 4 when 'chart' then 6 else 0 end""")
def c10_subset_core(spark, d):
    return evalsets.subset_core(items(spark, d)).select("id")


@query("with s as (select * from fx_eval_items where ord % 5 <> 2 or ord % 2 = 0), a as (select temporal_pair_id, count(*) as n from s where temporal_pair_id is not null group by 1), b as (select temporal_pair_id, count(*) as m from fx_eval_items where temporal_pair_id is not null group by 1) select temporal_pair_id, n, m from a join b using (temporal_pair_id) where n <> m")
def c11_pairs_intact(spark, d):
    own = items(spark, d)
    return evalsets.check_pairs_intact(own.where("ord % 5 <> 2 or ord % 2 = 0"), own)


@query(r"""with q as (select item_id, text, item_id * 7 % (select max(doc_id) + 1 from documents) as doc from benchmark), n as (select doc_id, trim(regexp_replace(regexp_replace(text, '[ \t\n\f\r\x0B]+', ' ', 'g'), ' ([,.;:])', '\1', 'g')) as t from documents),
w as (select q.*, case item_id % 4 when 0 then (select coalesce(t, '') from n where n.doc_id = q.doc)[1:200] else text end as quote from q),
m as (select item_id, doc, trim(regexp_replace(regexp_replace(quote, '[ \t\n\f\r\x0B]+', ' ', 'g'), ' ([,.;:])', '\1', 'g')) as t from w)
select item_id, m.doc as doc_id, coalesce(contains(n.t, m.t), false) as found, case when n.t is null then 'no document' when contains(n.t, m.t) then 'ok' when item_id % 3 = 0 then 'note' else 'missing' end as status from m left join n on n.doc_id = m.doc""")
def c8_check_evidence(spark, d):
    """Every fourth quote is the start of its document, as a quote of it would be."""
    docs = table(spark, d, "documents")
    most = docs.agg((F.max("doc_id") + 1).alias("_m"))
    quotes = table(spark, d, "benchmark").crossJoin(most).select("item_id", (F.col("item_id") * 7 % F.col("_m")).alias("filename"), "text", F.when(F.col("item_id") % 3 == 0, "p. 3, chart image").alias("location"))
    starts = docs.select(F.col("doc_id").alias("filename"), F.substring(evalsets.normalise_quotes(F.coalesce("text", F.lit(""))), 1, 200).alias("_start"))
    quotes = quotes.join(starts, "filename", "left").withColumn("quote", F.when(F.col("item_id") % 4 == 0, F.col("_start")).otherwise(F.col("text"))).drop("_start", "text")
    return evalsets.check_evidence(quotes, docs.select(F.col("doc_id").alias("filename"), "text")).select("item_id", F.col("filename").alias("doc_id"), "found", "status")


@query("""with e as (select o_orderkey, o_totalprice, o_orderpriority from orders)
select o_orderkey as id, o_orderkey % 5 <> 0 as matches from e""")
def c8_check_cells(spark, d):
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), "o_orderpriority")
    even = F.col("o_orderkey") % 2 == 0
    cells = own.select(F.lit("book.xlsx").alias("filename"), F.lit("s").alias("sheet"), F.concat(F.lit("A"), "o_orderkey").alias("ref"), F.when(even, F.col("price").cast("string")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("value"))
    off = F.when(F.col("o_orderkey") % 5 == 0, 1.0).otherwise(1e-9)
    value = F.when(even, (F.col("price") + off).cast("string")).otherwise(F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.concat("o_orderpriority", F.lit("  "))))
    expected = own.select(F.col("o_orderkey").alias("id"), F.lit("book.xlsx").alias("filename"), F.lit("s").alias("sheet"), F.concat(F.lit("A"), "o_orderkey").alias("ref"), value.alias("value"))
    return evalsets.check_cells(expected, cells).select("id", "matches")


# --- ingest and chunking ----------------------------------------------------


@query("select n_regionkey as region, n_name as filename, case when n_nationkey % 3 = 0 then 'v1' else concat('v', n_nationkey) end as version_label, case when n_nationkey % 2 = 0 then '2024-01-01' end as effective_from, null as effective_to from nation")
def a1_manifest(spark, d):
    """A manifest for each region, written as JSON from the table and read again."""
    n = F.col("n_nationkey")
    entry = F.struct(F.col("n_name").alias("filename"), F.when(n % 3 == 1, F.concat(F.lit("v"), n.cast("string"))).when(n % 3 == 2, F.concat(F.lit(" v"), n.cast("string"), F.lit(" "))).alias("version_label"), F.when(n % 2 == 0, "2024-01-01").alias("effective_from"), F.lit(" ").alias("effective_to"))
    texts = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.to_json(F.struct(F.collect_list(entry).alias("documents"))).alias("text"))
    return ingest.parse_manifest(texts).select("region", "filename", F.trim("version_label").alias("version_label"), "effective_from", "effective_to")


@query("select item_id % 7 as set_no, concat('q', item_id) as id, text as question, case when item_id % 2 = 0 then item_id % 3 = 0 end as answerable, row_number() over (partition by item_id % 7 order by item_id) - 1 as ord from benchmark")
def a9_eval_set(spark, d):
    """Seven sets, some a list, some an object, written as JSON from the table and read again."""
    n = F.col("item_id")
    entry = F.struct(n.alias("_at"), F.concat(F.lit("q"), n.cast("string")).alias("id"), F.col("text").alias("question"), F.when(n % 2 == 0, n % 3 == 0).alias("answerable"))
    sets = table(spark, d, "benchmark").groupBy((n % 7).alias("set_no")).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    texts = sets.select("set_no", F.when(F.col("set_no") % 2 == 0, F.to_json("items")).otherwise(F.to_json(F.struct("items"))).alias("text"))
    return ingest.parse_eval_set(texts).select("set_no", "id", "question", "answerable", "ord")


_URL_TYPE = "case lower(regexp_extract(f, '\\.[^.]+$')) when '.pdf' then 'pdf' when '.docx' then 'docx' when '.doc' then 'docx' when '.xlsx' then 'xlsx' when '.csv' then 'csv' when '.html' then 'html' when '.htm' then 'html' else 'unknown' end"
_NAMED = "n as (select doc_id, concat('f', cast(doc_id as varchar), case doc_id % 6 when 0 then '.PDF' when 1 then '.doc' when 2 then '.csv' when 3 then '.htm' when 4 then '.xlsx' else '.bin' end) as f from documents)"


@query(f"with {_NAMED}, t as (select doc_id, {_URL_TYPE} as file_type from n) select doc_id, file_type, case when file_type in ('xlsx', 'csv') then 'spreadsheet_aware' when file_type = 'pdf' then 'text_table_vision' else 'text_table' end as strategy, true as vision_requested, file_type <> 'pdf' as vision_ignored from t")
def a3_parsing_strategy(spark, d):
    ends = [".PDF", ".doc", ".csv", ".htm", ".xlsx", ".bin"]
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.array(*map(F.lit, ends))[(F.col("doc_id") % 6).cast("int")])
    return ingest.select_parsing_strategy(table(spark, d, "documents").select("doc_id", name.alias("filename")), True).drop("filename")


@query("select n_nationkey as nation, row_number() over (partition by n_nationkey order by s_suppkey) - 1 as elem_idx, concat('Row ', row_number() over (partition by n_nationkey order by s_suppkey), ': ', concat_ws(', ', 's_suppkey=' || s_suppkey, 's_name=' || nullif(trim(s_name), ''))) as content from supplier join nation on s_nationkey = n_nationkey")
def a4_csv_rows(spark, d):
    own = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = ingest.csv_rows_to_elements(own.withColumnRenamed("n_nationkey", "nation"), "nation", "s_suppkey", ["s_suppkey", "s_name"])
    return out.select("nation", "elem_idx", "content")


@query("with r as (select n_regionkey as doc_id, row_number() over (partition by n_regionkey order by n_nationkey) as row_no, n_nationkey, n_name from nation) select doc_id, string_agg(case when row_no = 1 then concat('| ', n_nationkey, ' | ', n_name, ' |', chr(10), '| --- | --- |') else concat('| ', n_nationkey, ' | ', n_name, ' |') end, chr(10) order by row_no) as content from r group by doc_id")
def a6_table_markdown(spark, d):
    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    own = table(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), F.lit("t").alias("table_id"), row.alias("row_no"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    return ingest.table_rows_to_markdown(own).select("doc_id", "content")


@query(r"""with a as (select page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g') as h from pages), b as (select page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') as h from a)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\f\r\x0B]+', ' ', 'g')) as text from b""")
def a7_html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", ingest.html_to_text("html").alias("text"))


@query()
def a8_html_to_elements(spark, d):
    return ingest.html_to_elements(table(spark, d, "pages"))


@query("select * from fx_documents where cast(doc_id as bigint) % 10 <> 0 union all select * replace (concat('new ', doc_id) as text) from fx_documents where cast(doc_id as bigint) % 10 = 0")
def a12_replace_document_chunks(spark, d):
    store = view(spark, d, "fx_documents")
    hit = store.where("cast(doc_id as bigint) % 10 = 0")
    return ingest.replace_document_chunks(store, hit.withColumn("text", F.concat(F.lit("new "), F.col("doc_id"))), hit.select("doc_id"))


@query("select chunk_id from fx_chunks where cast(doc_id as bigint) % 10 = 0")
def a13_scan_chunks(spark, d):
    ids = view(spark, d, "fx_documents").where("cast(doc_id as bigint) % 10 = 0").select("doc_id")
    return ingest.scan_chunks(view(spark, d, "fx_chunks"), ids).select("chunk_id")


@query("select doc_id, filename, chunks from (select doc_id, filename from fx_documents where cast(doc_id as bigint) % 4 <> 0) left join (select doc_id, count(*) as chunks from fx_chunks where cast(doc_id as bigint) % 4 <> 0 group by doc_id) using (doc_id)")
def a21_delete_documents(spark, d):
    docs = view(spark, d, "fx_documents")
    store, left = ingest.delete_documents(view(spark, d, "fx_chunks"), docs, docs.where("cast(doc_id as bigint) % 4 = 0").select("doc_id"))
    return left.join(store.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "full_outer").select("doc_id", "filename", "chunks")


@query("with w as (select doc_id, unnest(range(0, length(text), 448)) as start_index, text from documents where length(text) > 0) select doc_id, start_index, substring(text, start_index + 1, 512) as content, start_index + length(substring(text, start_index + 1, 512)) as end_index from w where regexp_matches(substring(text, start_index + 1, 512), '\\S')")
def b1_chunk_fixed(spark, d):
    return chunking.chunk_fixed(table(spark, d, "documents"))


@query()
def b2_chunk_recursive(spark, d):
    return chunking.chunk_recursive(table(spark, d, "documents"))


@query()
def b3_chunk_semantic(spark, d):
    return chunking.chunk_semantic(table(spark, d, "documents"))


def letter_counts(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(c) for c in _LETTERS] for t in map(str.lower, texts)], float)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VECTOR = lambda t: "[" + ", ".join(f"(length({t}) - length(replace({t}, '{c}', '')))::double" for c in _LETTERS) + "]"


@query(rf"""with d as (select doc_id, text, list_filter(list_transform(string_split(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])[ \t\n\f\r\x0B]+', '\1<cut>', 'g'), '<cut>'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') as s from documents where text <> ''),
e as (select doc_id, unnest(s) as x, unnest(range(1, len(s) + 1)) as pos from d where len(s) > 3),
v as (select doc_id, x, pos, {_VECTOR("lower(x)")} as v from e),
c as (select doc_id, x, pos, case when list_sum(v) = 0 or list_sum(lag(v) over w) = 0 then 0.0 else list_cosine_similarity(v, lag(v) over w) end < 0.85 and pos > 1 as cut from v window w as (partition by doc_id order by pos)),
g as (select doc_id, x, pos, sum(cast(cut as int)) over (partition by doc_id order by pos) as k from c)
select doc_id, cast(k as int) as chunk_idx, string_agg(x, ' ' order by pos) as content, cast(count(*) as int) as sentence_count from g group by doc_id, k
union all select doc_id, 0, text, len(s) from d where len(s) <= 3""")
def b3_chunk_letters(spark, d):
    """Semantic chunks by letter counts, an embedding that SQL can count too."""
    return chunking.chunk_semantic(table(spark, d, "documents"), vectors=letter_counts).select("doc_id", "chunk_idx", "content", "sentence_count")


@query()
def b4_chunk_structure(spark, d):
    return chunking.chunk_structure(table(spark, d, "documents"))


@query("""with e as (select conv_id as doc_id, turn as elem_idx, text as content, turn % 5 <> 3 and coalesce(trim(text), '') <> '' as is_text, turn % 4 = 0 as h, turn // 6 as page from conversations),
n as (select *, case when coalesce(lag(is_text) over w, false) and lag(page) over w is not distinct from page then 0 else 1 end as new from e window w as (partition by doc_id order by elem_idx)),
u as (select *, sum(new) over (partition by doc_id order by elem_idx) as unit from n)
select doc_id, cast(unit as bigint) as unit, any_value(page) as page, string_agg(case when h then concat('## ', content) else content end, chr(10) || chr(10) order by elem_idx) as content from u where is_text group by doc_id, unit""")
def b7_text_units(spark, d):
    kind = F.when(F.col("turn") % 5 == 3, "table").otherwise("text")
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("elem_idx"), F.col("text").alias("content"), kind.alias("chunk_type"), (F.col("turn") % 4 == 0).alias("is_heading"), F.floor(F.col("turn") / 6).alias("page"))
    return chunking.text_units(own)


@query("select s as chunk_strategy, count(c.chunk_id) as n from (values ('fixed'), ('recursive'), ('structure_aware'), ('atomic')) v(s) left join fx_chunks c on c.chunk_strategy = s group by s")
def b9_chunk_counts(spark, d):
    return chunking.chunk_counts(view(spark, d, "fx_chunks"), ["fixed", "recursive", "structure_aware"])


@query("select d.doc_id, count(c.chunk_id) as chunks_indexed from fx_documents d left join fx_chunks c on c.doc_id = d.doc_id and c.chunk_strategy = 'recursive' group by d.doc_id")
def b9_document_counts(spark, d):
    return chunking.document_counts(view(spark, d, "fx_documents"), view(spark, d, "fx_chunks").where("chunk_strategy = 'recursive'"))


@query(f"with {IT} select id, at from it")
def b10_to_epoch(spark, d):
    return items(spark, d).select("id", scalars.to_epoch("valid_from").alias("at"))


# --- retrieval --------------------------------------------------------------


def _probed(spark, d):
    own = table(spark, d, "embeddings")
    questions = own.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "question_id")
    lists = vector_lists.train_lists(own)
    return questions, own, vector_lists.probed_top_k(questions, vector_lists.with_list(own, lists), lists, 10)


@query()
def d7_probed_top_k(spark, d):
    """Every fiftieth vector against all, by lists of a trained quantiser."""
    return _probed(spark, d)[2]


@query("select count(*) as n, true as enough from embeddings where vec_id % 50 = 0")
def d7_probed_recall(spark, d):
    """Whether the lists find at least nine of ten of the exact nearest vectors."""
    questions, own, found = _probed(spark, d)
    return vector_lists.recall(questions, own, found, 10).agg(F.count("*").alias("n"), (F.avg("recall") >= 0.9).alias("enough"))


_DATED = "freshness_policy in ('effective_date_filter', 'version_aware')"
_ELIGIBLE = f"""with {IT}, keys as (select distinct parsing_strategy, chunking_strategy, freshness_policy, case when {_DATED} then at end as at from fx_runs cross join (select distinct at from it)),
el as (select k.*, c.* from keys k join fx_chunks c on c.chunk_type = 'text' or k.parsing_strategy in ('text_table', 'text_table_vision') and c.chunk_type = 'table' or k.parsing_strategy = 'text_table_vision' and c.chunk_type = 'image' or k.parsing_strategy = 'spreadsheet_aware' and c.chunk_type = 'spreadsheet_cell'
where (c.chunk_strategy = k.chunking_strategy or c.chunk_strategy = 'atomic')
and (k.at is null or c.effective_from <= k.at and (c.effective_to is null or c.effective_to >= k.at)))"""


@query(f"{_ELIGIBLE} select parsing_strategy, chunking_strategy, freshness_policy, at, count(*) as n, count(distinct doc_id) as docs from el group by all")
def d5_eligible_chunks(spark, d):
    own = retrieval.eligible_chunks(retrieval.corpus_keys(runs(spark, d), items(spark, d)), view(spark, d, "fx_chunks"))
    return own.groupBy("parsing_strategy", "chunking_strategy", "freshness_policy", "at").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""with c as (select case when start_index = 0 then null when start_index = 448 then 'semantic' else chunk_strategy end as tag from fx_chunks where chunk_type = 'text')
select s as strategy, case when count(tag) + count(*) filter (tag is null) > 0 and not coalesce(bool_or(coalesce(tag, 'recursive') = s), false) then 'not indexed' end as reason from (values ('fixed'), ('recursive'), ('semantic'), ('structure_aware')) v(s) cross join c group by s""")
def d6_strategy_not_indexed(spark, d):
    tag = F.when(F.col("start_index") == 448, "semantic").when(F.col("start_index") > 0, F.col("chunk_strategy"))
    own = view(spark, d, "fx_chunks").where("chunk_type = 'text'").withColumn("chunk_strategy", tag)
    return retrieval.strategy_not_indexed(own, numbers([("fixed",), ("recursive",), ("semantic",), ("structure_aware",)], "strategy string", spark))


_D7 = """with q as (select vec_id as question_id, embedding as e from embeddings where vec_id % 50 = 0), v as (select vec_id, embedding as e from embeddings),
s as (select question_id, vec_id, round(list_cosine_similarity(q.e::double[], v.e::double[]), 6) as similarity, list_cosine_similarity(q.e::double[], v.e::double[]) as raw from q cross join v)
select question_id, vec_id, similarity, row_number() over (partition by question_id order by round(raw, 9) desc, vec_id) as rank from s qualify rank <= 10"""


@query(_D7)
def d7_vector_top_k(spark, d):
    own = table(spark, d, "embeddings")
    found = retrieval.vector_top_k(own.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "question_id"), own, 10)
    return found.withColumn("similarity", F.round("similarity", 6))


_BM = f"""{_ELIGIBLE}, co as (select parsing_strategy as p, chunking_strategy as c, freshness_policy as f, coalesce(at, -1) as t, chunk_id, content from el),
ask as (select distinct parsing_strategy as p, chunking_strategy as c, freshness_policy as f, coalesce(case when {_DATED} then at end, -1) as t, id, question from fx_runs cross join it),
words as (select chunk_id, list_filter(regexp_split_to_array(content, '[ \\t\\n\\f\\r\\x0B]+'), lambda w: w <> '') as w from fx_chunks where content <> ''),
tok as (select p, c, f, t, chunk_id, w from co join words using (chunk_id)),
sz as (select p, c, f, t, count(*) as n, avg(len(w)) as al from tok group by all),
tf as (select chunk_id, l, term, count(*) as k from (select chunk_id, len(w) as l, unnest(w) as term from words) group by all),
df as (select p, c, f, t, term, count(*) as d from co join tf using (chunk_id) group by all),
i0 as (select df.*, n, al, ln(n - d + 0.5) - ln(d + 0.5) as x from df join sz using (p, c, f, t)),
mi as (select p, c, f, t, avg(x) as m from i0 group by all),
idf as (select i0.p, i0.c, i0.f, i0.t, term, al, case when x < 0 then 0.25 * m else x end as y from i0 join mi using (p, c, f, t)),
qs as (select id, term, count(*) as times from (select id, unnest(list_filter(regexp_split_to_array(question, '[ \\t\\n\\f\\r\\x0B]+'), lambda w: w <> '')) as term from fx_eval_items) group by all),
sc as (select p, c, f, t, id, chunk_id, round(sum(times * y * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * l / al))), 6) as score from co join tf using (chunk_id) join idf using (p, c, f, t, term) join qs using (term) join ask using (p, c, f, t, id) group by all),
lex as (select p, c, f, t, id, chunk_id, coalesce(score, 0.0) as score, row_number() over (partition by p, c, f, t, id order by coalesce(score, 0.0) desc, chunk_id) as rank from tok join ask using (p, c, f, t) left join sc using (p, c, f, t, id, chunk_id) qualify rank <= 5)"""


@query(f"{_BM} select p as parsing_strategy, c as chunking_strategy, f as freshness_policy, t as at_date, id as question_id, floor(score * 10000 + 0.5) / 10000 as score, rank from lex")
def d8_bm25_top_k(spark, d):
    chunks, keys = view(spark, d, "fx_chunks"), ["parsing_strategy", "chunking_strategy", "freshness_policy", "at"]
    groups = retrieval.eligible_groups(retrieval.corpus_keys(runs(spark, d), items(spark, d)), chunks).withColumn("at", F.coalesce("at", F.lit(-1)))
    dated = items(spark, d).select(F.col("id").alias("question_id"), "question", scalars.to_epoch("valid_from").alias("date"))
    asked = dated.crossJoin(runs(spark, d).select(*keys[:3]).distinct()).withColumn("at", F.coalesce(retrieval.key_date("freshness_policy", "date"), F.lit(-1)))
    own = retrieval.bm25_top_k(dated, retrieval.with_group(chunks), groups, keys, 5, asked)
    return own.select(*keys[:3], F.col("at").alias("at_date"), "question_id", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"), "rank")


@query("""with v as (select run_id, filename as content, min(rank) as rank from fx_retrieved where rank <= 3 group by all), l as (select run_id, filename as content, min(rank) - 1 as rank from fx_retrieved where rank > 1 group by all),
b as (select run_id, content, 0.6 / (rank + 60) as part, 0 as s, rank from v union all select run_id, content, 0.4 / (rank + 60), 1, rank from l),
m as (select run_id, content, round(sum(part), 9) as score, min((s, rank)) as seen from b group by all)
select run_id, content, score, row_number() over (partition by run_id order by score desc, seen, content) as rank from m qualify rank <= 10""")
def d9_rrf_fuse(spark, d):
    own = view(spark, d, "fx_retrieved").select("run_id", F.col("filename").alias("content"), "rank")
    v = own.where("rank <= 3").groupBy("run_id", "content").agg(F.min("rank").alias("rank"))
    lexical = own.where("rank > 1").groupBy("run_id", "content").agg((F.min("rank") - 1).alias("rank"))
    return retrieval.rrf_fuse(v, lexical, ["run_id"], "content", 10)


@query("""with s as (select *, case when n % 5 = 0 and rank = 2 then null when chunk_type = 'table' then 1.0 else 0.0 end as score from fx_retrieved join (select run_id, query_id, n from fx_query_results) using (run_id, query_id)),
f as (select *, bool_or(score is null) over (partition by run_id, query_id) as failed from s), k as (select *, row_number() over (partition by run_id, query_id order by case when failed then 0 else -score end, rank) as r from f)
select run_id, query_id, chunk_id, r as rank, not failed as reranked, case when failed then 'a candidate has no score' end as rerank_error from k where failed or r <= 3""")
def d10_rerank(spark, d):
    own = view(spark, d, "fx_retrieved").join(view(spark, d, "fx_query_results").select("run_id", "query_id", "n"), ["run_id", "query_id"])
    score = F.when((F.col("n") % 5 != 0) | (F.col("rank") != 2), F.when(F.col("chunk_type") == "table", 1.0).otherwise(0.0))
    return retrieval.rerank(own, ["run_id", "query_id"], 3, score).select("run_id", "query_id", "chunk_id", "rank", "reranked", "rerank_error")


@query("select run_id, query_id, chunk_id, row_number() over (partition by run_id, query_id order by coalesce(effective_from, 0) desc, rank) as rank from fx_retrieved")
def d11_recency_sort(spark, d):
    return retrieval.recency_sort(view(spark, d, "fx_retrieved"), ["run_id", "query_id"]).select("run_id", "query_id", "chunk_id", "rank")


@query("select run_id, query_id, string_agg(filename, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) filter (rank <= 2) as context, count(*) as n from fx_retrieved group by run_id, query_id")
def d12_assemble_context(spark, d):
    own = view(spark, d, "fx_retrieved").withColumn("content", F.col("filename"))
    return retrieval.assemble_context(own, ["run_id", "query_id"], 2).select("run_id", "query_id", "context", F.size("chunks").alias("n"))


def letters(text):
    """A vector of letter counts: an embedding that SQL can count too; of a null text nulls."""

    def counted(texts: pa.Array) -> pa.Array:
        lists = letter_counts(texts.fill_null("").to_pylist()).reshape(-1)
        gone = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), len(_LETTERS))
        return pa.ListArray.from_arrays(np.arange(0, len(lists) + 1, len(_LETTERS), dtype=np.int32), pa.array(lists, mask=gone))

    return F.arrow_udf(counted, T.ArrayType(T.DoubleType()))(F.lower(text))


_WORDSET = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^A-Za-z0-9_]+'), lambda w: w <> ''))"


_RETRIEVE = f"""{_BM}, cv as (select chunk_id, content, effective_from, {_VECTOR('lower(content)')} as v from fx_chunks where content is not null),
qv as (select id, question, {_VECTOR('lower(question)')} as u from fx_eval_items),
sim as (select id, chunk_id, round(case when list_sum(u) = 0 or list_sum(v) = 0 then 0.0 else list_cosine_similarity(u, v) end, 9) as s from qv cross join cv),
vec as (select p, c, f, t, id, chunk_id, row_number() over (partition by p, c, f, t, id order by s desc, chunk_id) as rank from co join ask using (p, c, f, t) join sim using (id, chunk_id) qualify rank <= 5),
two as (select p, c, f, t, id, chunk_id, 0.6 / (rank + 60) as part, 0 as src, rank from vec union all select p, c, f, t, id, chunk_id, 0.4 / (rank + 60), 1, rank from lex),
hy0 as (select p, c, f, t, id, content, round(sum(part), 9) as score, min((src, rank)) as seen, arg_min(chunk_id, src * 1000 + rank) as chunk_id from two join cv using (chunk_id) group by all),
hy as (select *, row_number() over (partition by p, c, f, t, id order by score desc, seen, content) as rank from hy0),
re as (select hy.* exclude (rank), row_number() over (partition by p, c, f, t, id order by round(coalesce(len(list_intersect({_WORDSET('question')}, {_WORDSET('content')})) / nullif(len({_WORDSET('question')}), 0), 0.0), 12) desc, hy.rank) as place from hy join qv using (id) qualify place <= 5),
ranked as (select 'vector_only' as r, p, c, f, t, id, chunk_id, rank from vec union all select 'bm25', p, c, f, t, id, chunk_id, rank from lex union all select 'hybrid', p, c, f, t, id, chunk_id, rank from hy union all select 'hybrid_reranker', p, c, f, t, id, chunk_id, place from re),
every as (select r, p, c, f, t, id, chunk_id, case when f = 'recency_biased' then row_number() over (partition by r, p, c, f, t, id order by coalesce(effective_from, 0) desc, rank) else rank end as rank from ranked join (select chunk_id, effective_from from cv) using (chunk_id))
select run_id, id as query_id, chunk_id, rank, every.r = 'hybrid_reranker' as reranked from every join fx_runs x on x.retrieval_strategy = every.r and x.parsing_strategy = p and x.chunking_strategy = c and x.freshness_policy = f"""


@query(_RETRIEVE)
def d14_retrieve(spark, d):
    return retrieval.retrieve(runs(spark, d), items(spark, d), view(spark, d, "fx_chunks"), embedding=letters)


@query(_RETRIEVE.replace("fx_runs", "fx_more_runs"))
def d14_retrieve_policies(spark, d):
    """All four strategies under the policies and parsings that the other runs don't have."""
    return retrieval.retrieve(view(spark, d, "fx_more_runs"), items(spark, d), view(spark, d, "fx_chunks"), embedding=letters)


@query(_ELIGIBLE.replace("fx_runs", "fx_more_runs") + " select parsing_strategy, chunking_strategy, freshness_policy, at, count(*) as n from el group by all")
def d5_eligible_policies(spark, d):
    own = retrieval.eligible_chunks(retrieval.corpus_keys(view(spark, d, "fx_more_runs"), items(spark, d)), view(spark, d, "fx_chunks"))
    return own.groupBy("parsing_strategy", "chunking_strategy", "freshness_policy", "at").agg(F.count("*").alias("n"))


# --- models' contracts and streams ------------------------------------------


@query()
def j1_embed(spark, d):
    return table(spark, d, "documents").select("doc_id", scorers.embed("text").alias("embedding"))


_TOKENS = """tok as (select id, question, ground_truth, list_distinct(list_filter(regexp_split_to_array(lower(question), '[^A-Za-z0-9_]+'), lambda w: w <> '')) as q,
  list_distinct(list_filter(regexp_split_to_array(lower(ground_truth), '[^A-Za-z0-9_]+'), lambda w: w <> '')) as t from fx_eval_items)"""


@query(f"""with {_TOKENS} select id, round(len(list_intersect(q, t)) / nullif(len(q), 0), 6) as faithfulness, round(len(list_intersect(t, q)) / nullif(len(t), 0), 6) as answer_correctness,
case when len(t) > 0 then 1.0::double end as context_recall, case when len(t) > 0 then 1.0::double end as context_precision, case when len(q) > 0 then 1.0::double else 0.0 end as answer_relevance from tok""")
def j4_score_answers(spark, d):
    own = items(spark, d).select("id", "question", "ground_truth", F.col("question").alias("generated_answer"), F.array("ground_truth").alias("contexts"))
    return scorers.score_answers(own).select("id", *[F.round(c, 6).alias(c) for c in scalars.SCORES])


@query("select run_id, date_trunc('hour', ts) as start, date_trunc('hour', ts) + interval 1 hour as \"end\", count(*) as n, count(*) filter (status = 'error') as errors, round(sum(cost) filter (status is distinct from 'error'), 9) as cost_usd, round(avg(latency_ms) filter (status is distinct from 'error'), 9) as latency_ms from (select q.*, e.ts, q.input_tokens * 0.15 / 1e6 as cost from fx_query_results q join events e on e.event_id = q.n) group by 1, 2")
def i3_run_health(spark, d):
    out = jobs.run_health(_run_events(spark, d), by=["run_id"])
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


def _run_events(spark, d):
    own = view(spark, d, "fx_query_results").select("run_id", F.col("n").alias("event_id"), "status", "latency_ms", (F.col("input_tokens") * 0.15 / 1e6).alias("cost_usd"))
    return own.join(table(spark, d, "events").select("event_id", "ts"), "event_id")


@query("""with k as (select unnest(range(0, 4)) as s), w as (select e.*, q.status, q.latency_ms, q.input_tokens * 0.15 / 1e6 as cost, date_trunc('hour', ts) + interval 15 minute * cast(floor(minute(ts) / 15) as int) - interval 15 minute * k.s as start from events e join fx_query_results q on e.event_id = q.n cross join k)
select start, start + interval 1 hour as \"end\", count(*) as n, count(*) filter (status = 'error') as errors, round(sum(cost) filter (status is distinct from 'error'), 9) as cost_usd, round(avg(latency_ms) filter (status is distinct from 'error'), 9) as latency_ms from w group by start""".replace('\\"', '"'))
def i3_run_health_sliding(spark, d):
    out = jobs.run_health(_run_events(spark, d), slide="15 minutes")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("""with e as (select concat('e_', user_id % 20) as experiment_id, concat('r_', user_id) as run_id, ts, event_id, case event_type when 'error' then 'failed' when 'view' then 'running' else 'done' end as status, case when event_id % 3 > 0 then 1 end as evaluated_at, case when event_id % 3 = 2 then 1 end as diagnosed_at from events),
l as (select experiment_id, run_id, arg_max(status, k) as status, arg_max(evaluated_at, k) as evaluated_at, arg_max(diagnosed_at, k) as diagnosed_at from (select *, row_number() over (order by ts, diagnosed_at is not null, evaluated_at is not null, status, event_id) as k, coalesce(evaluated_at, -1) from e) group by all)
select experiment_id, case when bool_or(status in ('pending', 'running')) then null when count(*) filter (status = 'done') = 0 then 'failed' when bool_and(status <> 'done' or diagnosed_at is not null) then 'done' when bool_and(status <> 'done' or evaluated_at is not null) then 'diagnosing' else 'evaluating' end as next_status from l group by experiment_id""".replace("arg_max(evaluated_at, k)", "case when max(k) filter (evaluated_at is not null) = max(k) then 1 end").replace("arg_max(diagnosed_at, k)", "case when max(k) filter (diagnosed_at is not null) = max(k) then 1 end"))
def i4_experiment_status(spark, d):
    """The batch form of the stream: the latest row of each run, then the experiments' states."""
    kind, n = F.col("event_type"), F.col("event_id") % 3
    own = table(spark, d, "events").select(F.concat(F.lit("e_"), (F.col("user_id") % 20).cast("string")).alias("experiment_id"), F.concat(F.lit("r_"), F.col("user_id").cast("string")).alias("run_id"), "ts", F.when(kind == "error", "failed").when(kind == "view", "running").otherwise("done").alias("status"), F.when(n > 0, 1).alias("evaluated_at"), F.when(n == 2, 1).alias("diagnosed_at"))
    return lifecycle.experiment_status(jobs.latest_runs(own))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, k""")
def i3_run_sessions(spark, d):
    out = jobs.run_sessions(table(spark, d, "events"))
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query(f"with {_TOKENS} select id, round(coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0.0), 6) as score from tok")
def j2_score_pairs(spark, d):
    return items(spark, d).select("id", F.round(scorers.score_pairs("question", "ground_truth"), 6).alias("score"))


_COUNT = lambda t: f"len(list_filter(regexp_split_to_array(lower({t}), '[^A-Za-z0-9_]+'), lambda w: w <> ''))"


@query(f"with {_TOKENS} select id, case when len(list_intersect(q, t)) >= len(q) then ground_truth else question end as generated_answer, 'ok' as status, 2 * {_COUNT('question')} + {_COUNT('ground_truth')} as input_tokens, {_COUNT('case when len(list_intersect(q, t)) >= len(q) then ground_truth else question end')} as output_tokens from tok")
def j3_generate(spark, d):
    chunk = lambda rank, c: F.struct(F.lit(rank).alias("rank"), F.col(c).alias("content"))
    own = items(spark, d).withColumn("chunks", F.array(chunk(1, "ground_truth"), chunk(2, "question")))
    return scorers.generate(own).select("id", "generated_answer", "status", "input_tokens", "output_tokens")


# --- further operators of ingest, sets and scope ------------------------------


@query("""with r as (select s_nationkey as doc_id, row_number() over (partition by s_nationkey order by s_suppkey) as row_no, cast(s_suppkey as varchar) as a, s_name as b from supplier), h as (select * from r where row_no = 1)
select doc_id, 0 as row_no, concat('Sheet: suppliers | Columns: ', concat_ws(', ', a, nullif(trim(b), ''))) as content, 'text' as chunk_type from h
union all select r.doc_id, r.row_no, concat('suppliers | row ', r.row_no, ': ', concat_ws(', ', h.a || '=' || r.a, case when trim(r.b) <> '' then h.b || '=' || r.b end)), 'spreadsheet_cell' from r join h using (doc_id) where r.row_no > 1""")
def a5_sheet_rows(spark, d):
    row = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    own = table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.lit(0).alias("sheet_idx"), F.lit("suppliers").alias("sheet_name"), row.alias("row_no"), F.array(F.col("s_suppkey").cast("string"), "s_name").alias("cells"))
    return ingest.sheet_rows_to_elements(own).drop("sheet_idx")


@query("""select event_id as id, concat('a', event_id, ',b') as docs, case event_id % 5 when 0 then true when 1 then false when 4 then true end as answerable, event_id % 5 <> 2 as answerable_valid,
case event_id % 4 when 0 then '{"quote": "x"}' when 1 then 'a quote' when 2 then '{broken' end as evidence, case event_id % 4 when 0 then 'x' end as quote, event_id % 4 <> 2 as evidence_valid from events""")
def a10_eval_rows(spark, d):
    pick = lambda k, *words: F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % k + 1).cast("int"))
    own = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit(" a"), F.col("event_id").cast("string"), F.lit(" ; ;b")).alias("source_docs"), pick(5, "Yes", "0", "maybe", "", " TRUE").alias("answerable"), pick(4, '{"quote": "x"}', "a quote", "{broken", " ").alias("evidence"))
    return ingest.parse_eval_row(own).select("id", F.array_join("source_docs", ",").alias("docs"), "answerable", "answerable_valid", "evidence", F.col("evidence_object")["quote"].alias("quote"), "evidence_valid")


@query("with c as (select concat('s_', ord % 5) as eval_set_id, ord % 5 as k, count(*) as n from fx_eval_items group by all) select eval_set_id, case when k < 2 then 'built_in' else 'upload' end as source, k as uploaded_at, case when k = 3 then 0 else n end as item_count, k = 1 as is_default, row_number() over (order by k >= 2, case when k >= 2 then k end desc, eval_set_id) as place from c where k <> 4")
def a11_eval_set_catalog(spark, d):
    n = F.col("ord") % 5
    own = items(spark, d).withColumns({"eval_set_id": F.concat(F.lit("s_"), n.cast("string")), "uploaded_at": n})
    sources = own.select("eval_set_id", F.when(n < 2, "built_in").otherwise("upload").alias("source"), "uploaded_at", (n != 4).alias("readable")).distinct()
    listed = evalsets.eval_set_catalog(own.where(n != 3), sources, "s_1")
    return listed.withColumn("place", F.row_number().over(Window.orderBy(F.col("source") == "upload", F.when(F.col("source") == "upload", F.col("uploaded_at")).desc(), "eval_set_id")).cast("long"))


@query("select doc_id, case doc_id % 3 when 0 then 'text_only' when 1 then 'text_table' end as parsing_strategy, row_number() over (order by doc_id % 100 desc, doc_id) as place from documents")
def a14_list_documents(spark, d):
    n = F.col("doc_id")
    own = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("strategy"), F.when(n % 3 == 0, "text_only").when(n % 3 == 1, "text_table")).alias("metadata"), (n % 100).alias("created_at"), F.lit("done").alias("parse_status"))
    listed = ingest.list_documents(own)
    return listed.select("doc_id", "parsing_strategy", F.row_number().over(Window.orderBy(F.col("created_at").desc(), "doc_id")).cast("long").alias("place"))


@query("select count(*) filter (doc_id % 7 <> 0) as done, count(*) as documents from documents")
def a14_done_count(spark, d):
    return ingest.done_count(table(spark, d, "documents").withColumn("parse_status", F.when(F.col("doc_id") % 7 != 0, "done")))


@query("select chunk_id, chunk_type from fx_chunks where chunk_type in ('text', 'table', 'spreadsheet_cell')")
def a19_parse_elements(spark, d):
    return ingest.parse_elements(view(spark, d, "fx_chunks"), "text_table").select("chunk_id", "chunk_type")


@query("""with s as (select s_suppkey as doc_id, case s_suppkey % 4 when 0 then '.csv' when 1 then '.pdf' when 2 then '.bin' else '' end as x, s_name, s_nationkey from supplier)
select doc_id, 1 as elem_idx, concat('Row 1: name=', s_name, ', nation=', s_nationkey) as content, 'spreadsheet_cell' as chunk_type, null as error from s where x = '.csv'
union all select doc_id, 2, concat('chart of ', s_name), 'image', null from s where x = '.pdf' union all select doc_id, null, null, null, case x when '' then 'no reader for a file without suffix' else 'no reader for .bin' end from s where x in ('.bin', '')""")
def a19_dispatch(spark, d):
    own = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "doc_id")
    ends = F.element_at(F.array(*map(F.lit, (".csv", ".pdf", ".bin", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = own.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), ends).alias("filename"))
    rows = own.select("doc_id", F.lit(1).alias("row_no"), F.array(F.lit("name"), F.lit("note"), F.lit("nation")).alias("names"), F.array("s_name", F.lit(" \n"), F.col("s_nationkey").cast("string")).alias("values"))
    described = own.select("doc_id", F.lit(2).alias("page"), F.concat(F.lit("chart of "), "s_name").alias("description"))
    none = spark.createDataFrame([], "doc_id long, html string")
    sheets = spark.createDataFrame([], "doc_id long, sheet_idx int, sheet_name string, row_no int, cells array<string>")
    return ingest.dispatch_elements(files, none, sheets, rows, described, "text_table_vision")


def _descriptions(spark, d):
    text = F.when(F.col("page_id") % 4 == 0, "PLAIN_TEXT_ONLY").when(F.col("page_id") % 4 == 1, " ").when(F.col("page_id") % 4 == 2, F.concat(F.lit("| a | --- "), "url")).otherwise(F.col("url"))
    return table(spark, d, "pages").select((F.col("page_id") % 10).alias("doc_id"), (F.floor(F.col("page_id") / 10) + 1).alias("page"), text.alias("description"))


_DESC = "with p as (select page_id % 10 as doc_id, page_id // 10 + 1 as page, page_id % 4 as k, url from pages)"


@query(f"{_DESC} select doc_id, page, case k when 2 then concat('| a | --- ', url) else url end as content, concat('vision_', page) as table_id, k = 2 or contains(url, '|') and contains(url, '---') as vision_has_table from p where page <= 20 and k >= 2")
def a20_page_descriptions(spark, d):
    return ingest.page_descriptions_to_elements(_descriptions(spark, d), 20).drop("chunk_type")


@query(f"{_DESC} select doc_id, count(*) filter (page <= 20) as sent, count(*) filter (page > 20) as skipped, count(*) filter (page <= 20 and k = 0) as plain, count(*) filter (page <= 20 and k >= 2) as chunks from p group by doc_id")
def a20_description_counts(spark, d):
    return ingest.description_counts(_descriptions(spark, d), 20)


@query("select event_id as id, event_id % 3 < 2 as is_heading from events")
def b6_heading_flag(spark, d):
    pair = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    n = F.col("event_id") % 3
    own = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(n == 0, pair("element_type", "Title")).when(n == 1, pair("heading_level", "Heading 2")).otherwise(pair("element_type", "Text")).alias("metadata"))
    return own.select("id", chunking.heading_flag().alias("is_heading"))


@query("""with w as (select doc_id, filename, doc_version, unnest(range(0, length(text), 448)) as at_, text from fx_documents where length(text) > 0)
select sha256(concat_ws(chr(31), doc_id, 'fixed', cast(at_ as varchar))) as chunk_id, doc_id, filename, doc_version, 'fixed' as chunk_strategy, 'text' as chunk_type, length(substring(text, at_ + 1, 512)) as n_chars from w where regexp_matches(substring(text, at_ + 1, 512), '\\S')
union all select sha256(concat_ws(chr(31), doc_id, 'atomic', cast(start_index as varchar))), doc_id, filename, doc_version, 'atomic', chunk_type, length(content) from fx_chunks where chunk_type <> 'text' and regexp_matches(content, '\\S')""")
def b8_build_index_chunks(spark, d):
    docs = view(spark, d, "fx_documents")
    others = view(spark, d, "fx_chunks").where("chunk_type <> 'text'").select("doc_id", F.col("start_index").alias("elem_idx"), "content", "chunk_type")
    out = chunking.build_index_chunks(docs.select("doc_id", "text"), others, ["fixed"], docs)
    return out.select("chunk_id", "doc_id", "filename", "doc_version", "chunk_strategy", "chunk_type", F.length("content").alias("n_chars"))


@query("""with s as (select event_id as position, case event_id % 5 when 0 then 'vector_only' when 1 then 'bm25' when 2 then 'hybrid' when 3 then 'hybrid_reranker' else 'magic' end as r, case event_id % 3 when 0 then 'text_only' when 1 then 'text_table' end as p, case event_id % 4 when 0 then 0 when 1 then 5 when 2 then 5 else 7 end as k from events),
f as (select *, min(position) over (partition by r, p, k) as first from s)
select position, 'retrieval_strategy: magic' as error from f where r = 'magic' union all select position, 'parsing_strategy: missing' from f where p is null union all select position, 'top_k below 1' from f where k < 1
union all select position, concat('same as ', first) from f where first < position union all select position, 'too many' from f where position >= 32 union all select position, 'unknown: colour' from f where position % 6 = 1""")
def c3_validate_configs(spark, d):
    n = F.col("event_id")
    names = F.element_at(F.array(*map(F.lit, [*configs.AXES["retrieval_strategy"], "magic"])), (n % 5 + 1).cast("int"))
    own = table(spark, d, "events").select(n.alias("position"), names.alias("retrieval_strategy"), F.lit("recursive").alias("chunking_strategy"), F.when(n % 3 == 0, "text_only").when(n % 3 == 1, "text_table").alias("parsing_strategy"), F.lit("none").alias("freshness_policy"), F.when(n % 4 == 0, 0).when(n % 4 == 2, 5).when(n % 4 == 3, 7).alias("top_k"), F.when(n % 2 == 0, configs.DEFAULT_MODEL).alias("llm_model"), F.when(n % 6 == 1, F.array(F.lit("colour"))).alias("unknown_fields"))
    return configs.validate_configs(own)


@query("select case when item_id % 2 = 0 then cast(item_id as varchar) else concat('x', item_id % 7) end as doc_id, min(item_id) as position, 'unknown document' as error from benchmark where item_id % 2 = 1 or cast(item_id as varchar) not in (select doc_id from fx_documents) group by 1")
def c9_validate_document_ids(spark, d):
    known = F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string")).otherwise(F.concat(F.lit("x"), (F.col("item_id") % 7).cast("string")))
    return evalsets.validate_document_ids(table(spark, d, "benchmark").select(known.alias("doc_id"), F.col("item_id").alias("position")), view(spark, d, "fx_documents"))


@query("""with n as (select concat('doc_', ord * 40, '.html') as f from fx_eval_items), t as (select count(distinct f) as lost from n where f not in (select filename from fx_documents)), s as (select count(*) as c, max(ord) as m from fx_eval_items)
select id, s.c as item_count, t.lost as n_unmatched from fx_eval_items cross join t cross join s where s.m < 5000""")
def c15_register_eval_set(spark, d):
    own = items(spark, d).withColumns({"valid_from": F.nullif("valid_from", F.lit("not-a-date")), "source_docs": F.array(F.concat(F.lit("doc_"), (F.col("ord") * 40).cast("string"), F.lit(".html")))})
    return evalsets.register_eval_set(own, view(spark, d, "fx_documents")).select("id", "item_count", "n_unmatched")


@query("select chunk_id from fx_chunks where cast(doc_id as bigint) % 3 = 0")
def d1_filter_scope(spark, d):
    scope = view(spark, d, "fx_documents").where("cast(doc_id as bigint) % 3 = 0")
    return retrieval.filter_scope(view(spark, d, "fx_chunks"), scope).select("chunk_id")


@query("select doc_id from documents where text is not null and text <> ''")
def d13_drop_null_content(spark, d):
    return retrieval.drop_null_content(table(spark, d, "documents").withColumnRenamed("text", "content"), lexical=True).select("doc_id")


@query("select run_id, query_id, case when status = 'error' then '' else query_id end as generated_answer, case when status = 'error' then 0 else input_tokens end as input_tokens, case when status = 'error' then 0 else output_tokens end as output_tokens from fx_query_results")
def e7_normalise_error(spark, d):
    own = view(spark, d, "fx_query_results").withColumn("generated_answer", F.col("query_id"))
    return accounting.normalise_error(own).select("run_id", "query_id", "generated_answer", "input_tokens", "output_tokens")


@query(f"""{DG}, k as (select *, case when modality in ('mixed', 'spreadsheet') then 'table' else coalesce(modality, 'text') end as kind from dg)
select run_id, query_id, coalesce(faithfulness, 0.0) as f_faithfulness, coalesce(context_recall, 0.0) as f_context_recall, coalesce(context_precision, 0.0) as f_context_precision, coalesce(answer_correctness, 0.0) as f_answer_correctness, coalesce(answer_relevance, 0.0) as f_answer_relevance,
round(least(coalesce(latency_ms / 10000, 0.0), 1.0), 9) as f_latency, round(least(coalesce(cost_usd / 0.10, 0.0), 1.0), 9) as f_cost, cast(kind = 'text' as double) as f_is_text, cast(kind = 'table' as double) as f_is_table, cast(kind = 'chart' as double) as f_is_chart,
coalesce(cast(dated as double), 0.0) as f_dated, coalesce(cast(out_of_period as double), 0.0) as f_out, cast(nontext as double) as f_nontext, cast(version_mismatch as double) as f_version from k""")
def g11_extract_features(spark, d):
    own = diagnosis.extract_features(diagnoses(spark, d))
    named = [c for c in own.columns if c.startswith("f_") and c not in ("f_latency", "f_cost")]
    return own.select("run_id", "query_id", *named, F.round("f_latency", 9).alias("f_latency"), F.round("f_cost", 9).alias("f_cost"))


@query("with x as (select run_id, query_id, n, status from fx_query_results union all select run_id, query_id, n - 1, 'error' from fx_query_results where n % 5 = 0) select run_id, query_id, n from x qualify row_number() over (partition by run_id, query_id order by coalesce(status, 'ok') = 'error', n) = 1")
def g21_pick_result(spark, d):
    own = view(spark, d, "fx_query_results").select("run_id", "query_id", "n", "status")
    copies = own.where("n % 5 = 0").withColumns({"n": F.col("n") - 1, "status": F.lit("error")})
    return diagnosis.pick_result_for_reasoning(own.unionByName(copies)).select("run_id", "query_id", "n")


@query(f"{_EXP} select experiment_id, count(*) as n_runs, min(run_id) as first_run, round(sum(run_id % 100 / 100.0), 6) as faithfulness from e group by experiment_id")
def h18_experiment_list(spark, d):
    own = _experiments(spark, d)
    scores = own.select("run_id", (F.col("run_id") % 100 / 100).alias("faithfulness"), F.lit(None).cast("double").alias("answer_correctness"))
    named = own.groupBy("experiment_id").agg(F.max("run_id").alias("created_at"))
    listed = lifecycle.experiment_list(named, own, scores)
    total = F.aggregate("runs", F.lit(0.0), lambda s, r: s + r["faithfulness"])
    return listed.select("experiment_id", F.size("runs").alias("n_runs"), F.col("runs")[0]["run_id"].alias("first_run"), F.round(total, 6).alias("faithfulness"))


@query(f"{DG} select retrieval_strategy, parsing_strategy, failure_category, count(*) as n from dg join fx_runs using (run_id) group by all")
def failure_by_config(spark, d):
    """The flagship: from chunks with validity and scores to counts of root causes for each configuration."""
    own = diagnoses(spark, d).join(F.broadcast(runs(spark, d).select("run_id", "retrieval_strategy", "parsing_strategy")), "run_id")
    return own.groupBy("retrieval_strategy", "parsing_strategy", "failure_category").agg(F.count("*").alias("n"))
