import os
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raglens import queries
from raglens.functions import scorers

from raglens.operators import accounting, chunking, diagnosis, evalsets, lifecycle, metrics, ml, ranking, reporting, retrieval, splitting, vector_lists
from raglens.plans import configs
from raglens.sources import ingest
from raglens.streaming import jobs

Q = 1717200000  # 2024-06-01


def test_matrix_sizes(spark):
    assert configs.config_matrix(spark).count() == 256
    assert configs.config_matrix(spark, configs.MVP).count() == 24


def test_budget(spark):
    rows = spark.createDataFrame([("r", f"q{i}", i, "ok", 0.15) for i in range(5)], "run_id string, query_id string, n int, status string, cost_usd double")
    states = lambda limit: [r["status"] for r in accounting.apply_budget(rows, limit).orderBy("n").collect()]
    assert states(0.40) == ["ok", "ok", "ok", "error", "error"]
    assert states(0.75) == ["ok"] * 5
    assert states(None) == ["ok"] * 5


def test_exactly_half_errored_is_not_failed(spark):
    rows = spark.createDataFrame([("r", "ok", None), ("r", "error", None), ("s", "error", "x"), ("s", "error", "x"), ("s", None, None)], "run_id string, status string, error_message string")
    assert {r["run_id"]: r["status"] for r in lifecycle.run_outcome(rows).collect()} == {"r": "done", "s": "failed"}


def test_filter_grid_against_plain_python(spark):
    """Every chunk type, validity, parsing, freshness and date, against a plain predicate."""
    kinds, edges = ["text", "table", "image", "spreadsheet_cell", "spreadsheet"], [None, Q - 1, Q, Q + 1]
    chunks = [(k, a, b) for k in kinds for a in edges for b in edges]
    cases = [(p, f, at) for p in retrieval.CHUNK_TYPES for f in ("none", "effective_date_filter", "version_aware", "recency_biased") for at in (Q, None)]
    left = spark.createDataFrame(chunks, "kind string, effective_from long, effective_to long")
    right = spark.createDataFrame(cases, "parsing string, policy string, at long")
    got = left.crossJoin(right).where(retrieval.type_fits("parsing", "kind") & retrieval.freshness_fits("policy", "at")).collect()

    def fits(k, a, b, p, f, at):
        if k not in retrieval.CHUNK_TYPES[p]:
            return False
        if f in ("effective_date_filter", "version_aware") and at is not None:
            return a is not None and a <= at and (b is None or b >= at)
        return True

    assert sorted(map(str, map(tuple, got))) == sorted(str((*c, *x)) for c in chunks for x in cases if fits(*c, *x))


def test_chunking_tags(spark):
    rows = spark.createDataFrame([("text", None), ("table", None), ("text", "atomic"), ("text", "recursive"), ("text", "fixed")], "kind string, tag string")
    got = [r[0] for r in rows.select(retrieval.chunking_fits(F.lit("recursive"), "tag", "kind")).collect()]
    assert got == [True, True, True, True, False]


def test_rules_stop_at_missing_scores(spark):
    cols = "dominant boolean, direction string, version_mismatch boolean, modality string, vision boolean, nontext boolean, context_recall double, faithfulness double, context_precision double, answer_correctness double"
    base = (False, None, False, "text", False, False)
    rows = [(*base, None, 0.1, 0.1, 0.1), (*base, 0.29, None, None, None), (*base, 0.9, 0.39, 0.9, 0.9), (*base, 0.9, 0.51, 0.29, 0.9), (*base, 0.51, 0.9, 0.9, 0.39), (*base, 0.9, 0.9, 0.9, 0.9), (True, "expired", False, "text", False, False, 1.0, 1.0, 1.0, None), (True, "expired", False, "text", False, False, 1.0, 1.0, 1.0, 0.5), (*base[:3], "chart", False, True, None, None, None, None), (*base[:3], "mixed", False, False, None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(diagnosis.rule_category()).collect()]
    assert got == [None, "LOW_RECALL_RETRIEVAL", "UNSUPPORTED_SYNTHESIS", "IRRELEVANT_CONTEXT_POLLUTION", "CHUNKING_BOUNDARY_ERROR", "NO_FAILURE", "STALE_ANSWER", "NO_FAILURE", "CHART_LAYOUT_BLINDNESS", "TABLE_RETRIEVAL_MISS"]


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "a" * 600), (2, ""), (3, None), (4, "One two.\n\nThree four. " * 60)], "doc_id long, text string")
    got = chunking.chunk_fixed(docs).where("doc_id = 1").orderBy("start_index").collect()
    assert [(r["start_index"], r["end_index"]) for r in got] == [(0, 512), (448, 600)]
    for r in chunking.chunk_recursive(docs).join(docs, "doc_id").collect():
        assert len(r["content"]) <= 512 and r["text"].find(r["content"]) >= 0
    assert all(r["section_title"] is None for r in chunking.chunk_structure(docs).collect())


def plain_split(text, size, overlap, separators=("\n\n", "\n", ". ", " ", "")):
    """The recursive splitter written out: a list of pieces, merged one by one."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer, out, held = separators[at], separators[at + 1 :], [], []
    parts = text.split(mark) if mark else list(text)
    pieces = [p for p in ([parts[0], *(mark + x for x in parts[1:])] if mark else parts) if p]

    def merged(pieces):
        found, run, length = [], [], 0
        for piece in pieces:
            if run and length + len(piece) > size:
                found.append("".join(run).strip())
                while run and (length > overlap or length + len(piece) > size):
                    length -= len(run.pop(0))
            run.append(piece)
            length += len(piece)
        return [x for x in (*found, "".join(run).strip()) if x]

    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        out += merged(held)
        held = []
        out += plain_split(piece, size, overlap, finer) if finer else [piece]
    return out + merged(held)


def plain_offsets(text, chunks):
    cursor, out = 0, []
    for c in chunks:
        cursor = max(cursor, text.find(c, cursor))
        out.append((cursor, c))
    return out


def test_recursive_chunks_equal_a_plain_splitter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if os.path.isdir("/root/testdata/sf0.001") else spark.createDataFrame([], "doc_id long, text string")
    odd = ["\n\n\nab\n\n\n\ncd\n" * 60, "x" * 1500 + ". " + "y z " * 300, ". . . " * 400, " ", "\n" * 700, "é\u2003" * 600, "A" * 511 + "\n\n" + "B" * 512]
    whole = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(odd, -50)), "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in whole.collect()}
    found = {}
    for r in chunking.chunk_recursive(whole).orderBy("doc_id", "chunk_idx").collect():
        found.setdefault(r["doc_id"], []).append((r["start_index"], r["content"]))
    for i, text in texts.items():
        assert found.get(i, []) == plain_offsets(text, plain_split(text, 512, 64)), i
    for size, overlap in ((10, 3), (7, 0), (20, 19)):
        for text in odd:
            text = text[:400]
            assert splitting.recursive_chunks(text, size, overlap) == plain_offsets(text, plain_split(text, size, overlap))


def test_structure_has_headings_over_lines(spark):
    text = "intro words\n\nABSTRACT TEXT\nMORE CAPITALS\nbody one\n# Title\nbody two\nSection 2(a) is no heading\nSection 3 – Terms.\nend"
    docs = spark.createDataFrame([(1, text), (2, "no heading here"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["section"], r["section_title"], r["start_index"], r["content"]) for r in chunking.chunk_structure(docs).orderBy("doc_id", "section").collect()]
    assert [g[:3] for g in got] == [(1, 0, None), (1, 1, "ABSTRACT TEXT\nMORE CAPITALS"), (1, 2, "# Title"), (1, 3, "Section 3 – Terms."), (2, 0, None)]
    assert all(text[g[3] :].startswith(g[4]) for g in got if g[0] == 1)


def test_semantic_chunks_start_at_zero(spark):
    rows = [(1, "One cat sat. One cat sat! Rain fell down? Rain fell down. Rain fell down."), (2, "A. B. C."), (3, ""), (4, None), (5, "a b. c d. e f. g h. i j.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["chunk_idx"], r["start_index"], r["content"], r["sentence_count"]) for r in chunking.chunk_semantic(docs).orderBy("doc_id", "chunk_idx").collect()]
    assert got[:3] == [(1, 0, 0, "One cat sat. One cat sat!", 2), (1, 1, 26, "Rain fell down? Rain fell down. Rain fell down.", 3), (2, 0, 0, "A. B. C.", 3)]
    assert [g[1] for g in got if g[0] == 5] == [0, 1, 2, 3, 4]
    texts = ["Some Words here, some_words", "", "x"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scorers.embed("t").alias("v")).orderBy("i").collect()
    assert np.array_equal(splitting.hashed_counts(texts, scorers.DIM), np.array([r["v"] for r in made]))


def test_dates_meet_validities(spark):
    """100,000 different dates; each sees exactly the groups whose closed validity holds it."""
    rng = np.random.default_rng(5)
    start = rng.integers(-(10**6), 10**6, 60)
    spans = [(int(a), None if i % 7 == 0 else int(a + rng.integers(0, 10**6))) for i, a in enumerate(start)] + [(5, 5), (None, 9), (7, 3)]
    chunks = spark.createDataFrame([(f"c{i}", "text", "recursive", *s) for i, s in enumerate(spans)], "chunk_id string, chunk_type string, chunk_strategy string, effective_from long, effective_to long")
    dates = np.unique(rng.integers(-(10**6), 2 * 10**6, 100_000)).tolist() + [5, 6]
    keys = spark.createDataFrame([("text_only", "recursive", "version_aware", d) for d in sorted(set(dates))], "parsing_strategy string, chunking_strategy string, freshness_policy string, at long")
    found = dict(retrieval.eligible_groups(keys, chunks).groupBy("at").count().collect())
    held = [(a, np.inf if b is None else b) for a, b in spans if a is not None]
    at = np.array(sorted(set(dates)))
    want = sum(((at >= a) & (at <= b)).astype(int) for a, b in held)
    assert found == {int(d): int(n) for d, n in zip(at, want, strict=True) if n}


def test_bm25_keeps_chunks_without_hits(spark):
    chunks = spark.createDataFrame([(1, "a", "x y"), (1, "b", "x x z"), (1, "c", "w")], "group int, chunk_id string, content string")
    groups = spark.createDataFrame([(7, 1)], "key int, group int")
    questions = spark.createDataFrame([("q", "z z")], "question_id string, question string")
    got = retrieval.bm25_top_k(questions, chunks, groups, ["key"], 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a"] and got[0]["score"] > 0 and got[1]["score"] == 0


def test_bm25_counts_by_group(spark, monkeypatch):
    """A task hands on one row a group and term, not one a word; a tie opens a question for smaller ids only."""
    batch = pa.RecordBatch.from_pydict({"group": pa.array([1, 1, 2, 1, 1], pa.int64()), "content": ["x x\x0by", "x\u2003z", " ", "", None]})
    got = sorted((r["group"], r["term"] or "", r["df"], r["words"]) for out in retrieval._count_terms(iter([batch])) for r in out.to_pylist())
    assert got == [(1, "", 2, 4), (1, "x", 1, None), (1, "x\u2003z", 1, None), (1, "y", 1, None), (2, "", 1, 0)]
    scores, bar = np.array([[1.0, 2.0, 2.0], [1.0, 2.0, 2.0], [3.0, 2.0, 2.0], [0.0, 1.0, 0.0]]), np.array([2.0, 2.0, 2.0, -np.inf])
    found = {q: rows.tolist() for q, rows in retrieval._open_rows(scores, bar, np.array(["a", "c", "a", None], object), "b", 2, 6)}
    assert found == {1: [1, 2], 2: [0, 1], 3: [1, 0]}
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 3)
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(20)] * 3
    chunks = spark.createDataFrame([(i % 4, f"c{i:02d}", t) for i, t in enumerate(texts)] + [(9, "z", None), (0, "zz", "")], "group int, chunk_id string, content string")
    groups = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2), ("q", 1), ("q", 3)], "key string, group int")
    asks = {"s": "a b", "t": "c c j", "u": "nowhere"}
    found = retrieval.bm25_top_k(spark.createDataFrame(list(asks.items()), "question_id string, question string"), chunks, groups, ["key"], 4)
    for key, own in (("p", (0, 1, 2)), ("q", (1, 3))):
        seen = [(f"c{i:02d}", t.split()) for i, t in enumerate(texts) if i % 4 in own]
        df = {w: sum(w in x for _, x in seen) for w in "abcdefghij"}
        idf = {w: np.log(len(seen) - n + 0.5) - np.log(n + 0.5) for w, n in df.items() if n}
        low, mean = np.mean(list(idf.values())), np.mean([len(x) for _, x in seen])
        weight = lambda w, x: (idf[w] if idf[w] >= 0 else 0.25 * low) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) if w in idf else 0.0  # noqa: B023, E731
        for q, ask in asks.items():
            want = sorted((-round(sum(weight(w, x) for w in ask.split()), 6), name) for name, x in seen)[:4]
            got = [(-r["score"], r["chunk_id"]) for r in found.where((F.col("key") == key) & (F.col("question_id") == q)).orderBy("rank").collect()]
            assert [n for _, n in got] == [n for _, n in want] and np.allclose([v for v, _ in got], [v for v, _ in want], atol=2e-6)


def test_letters_are_counted_in_batches(spark):
    texts = spark.createDataFrame([("Aaz\u00c9\u212a\u0130!",), ("",), (None,)], "t string")
    low = F.lower("t")
    plain = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    made = texts.select(queries.letters(F.col("t")).alias("own"), plain.alias("plain"))
    assert all(r["own"] == r["plain"] for r in made.collect())
    plan = texts.select(queries.letters(F.col("t")).alias("own"))._jdf.queryExecution().executedPlan().toString()
    assert "replace(" not in plan


def test_rankings_are_computed_once(spark):
    """What is asked for reads rankings, not chunks; copies and chunks without content leave the order as it is."""
    chunks = spark.createDataFrame([(f"c{i}", "text", "recursive", 0, None, f"word{i % 3} word") for i in range(9)] + [("n", "text", "recursive", 0, None, None), ("o", "text", "recursive", 0, None, "")], "chunk_id string, chunk_type string, chunk_strategy string, effective_from long, effective_to long, content string")
    items = spark.createDataFrame([("q", "word1 ab", None), ("r", "word2", "2020-01-01")], "id string, question string, valid_from string")
    runs = spark.createDataFrame([(s, s, "text_only", "recursive", f) for s in retrieval.STRATEGIES for f in ("none", "recency_biased")], "run_id string, retrieval_strategy string, parsing_strategy string, chunking_strategy string, freshness_policy string")
    found = retrieval.retrieve(runs, items, chunks, 3, queries.letters)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault((r["run_id"], r["query_id"]), {})[r["rank"]] = r["chunk_id"]
    assert [got["bm25", "q"][k] for k in (1, 2, 3)] == ["c1", "c4", "c7"] and [got["bm25", "r"][k] for k in (1, 2, 3)] == ["c2", "c5", "c8"]
    assert [got["vector_only", "q"][k] for k in (1, 2, 3)] == ["c0", "c1", "c2"]  # digits are no letters: all alike
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)] + [(99, [float("nan"), 1.0])], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, [2.0, 2.0]), (2, [3.0, 0.0])], "question_id long, embedding array<double>")
    top = retrieval.vector_top_k(asked, vectors, 3).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["vec_id"], r["similarity"]) for r in top] == [(1, 1, 1.0), (1, 3, 1.0), (1, 5, 1.0), (2, 0, 1.0), (2, 2, 1.0), (2, 4, 1.0)]


def test_comparison_computes_metrics_once(spark):
    """Each run's metrics are made once for the baseline, the best other run and the deltas."""
    asked = spark.sparkContext.accumulator(0)

    def seen(v):
        asked.add(1)
        return v

    kind = "run_id string, retrieval_strategy string, chunking_strategy string, parsing_strategy string, freshness_policy string"
    runs = spark.createDataFrame([(f"r{i}", "vector_only" if i % 2 else "hybrid", "recursive", "text_only", "none") for i in range(6)], kind)
    made = spark.createDataFrame([(f"r{i}", *[0.1 * i + 0.01 * j for j in range(len(ranking.SORTABLE))]) for i in range(6)], "run_id string, " + ", ".join(f"{m} double" for m in ranking.SORTABLE))
    counted = made.withColumn("faithfulness", F.udf(seen, "double")("faithfulness"))
    got = ranking.baseline_comparison(runs, counted).collect()
    assert [(r["baseline_id"], r["run_id"], r["error"], r["improvements"], r["regressions"]) for r in got] == [("r1", "r5", None, 7, 2)]
    assert asked.value == 6


def test_html_and_types(spark):
    row = spark.range(1).select(ingest.html_to_text(F.lit("<p>a&amp;b</p><script>x()</script><b>c</b>")).alias("t"), ingest.detect_file_type(F.lit("A.Doc")).alias("k")).first()
    assert (row["t"], row["k"]) == ("a&b c", "docx")


def test_feedback_last_wins(spark):
    results = spark.createDataFrame([("r", "a", "ok"), ("r", "b", "error")], "run_id string, query_id string, status string")
    schema = "run_id string, query_id string, rating string, correct_label string, created_at long"
    old = spark.createDataFrame([("r", "a", "negative", None, 1)], schema)
    new = spark.createDataFrame([("r", "a", "positive", None, 2), ("r", "a", "negative", "NO_FAILURE", 3), ("r", "b", "positive", None, 9), ("r", "a", "odd", None, 8)], schema)
    got = reporting.upsert_feedback(old, new, results).collect()
    assert [(r["rating"], r["correct_label"]) for r in got] == [("negative", "NO_FAILURE")]


def test_valid_items_have_no_rows(spark):
    schema = "ord int, id string, question string, ground_truth string, valid_from string, modality string, failure_type string"
    rows = spark.createDataFrame([(0, "a", "q", "t", "2024-01-31", "text", None), (1, "a", "q", "t", "2024-02-31", "text", None), (2, "b", " ", "t", "2024-1-1", "film", "X")], schema)
    got = {(r["ord"], r["field"]) for r in evalsets.validate_eval_items(rows).collect()}
    assert got == {(1, "id"), (1, "valid_from"), (2, "question"), (2, "valid_from"), (2, "modality"), (2, "failure_type")}


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import types as T

    rows = [(f"r{i % 3}", f"2024-01-01 {i % 5:02d}:00:00", "error" if i % 4 == 0 else "ok", 0.25, float(i)) for i in range(40)]
    batch = spark.createDataFrame(rows, "run_id string, t string, status string, cost_usd double, latency_ms double").withColumn("ts", F.to_timestamp("t")).drop("t")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(T.StructType(batch.schema.fields)).parquet(str(tmp_path / "in"))
    query = jobs.run_health(stream, by=["run_id"]).writeStream.outputMode("complete").format("memory").queryName("health").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(str, spark.table("health").collect())) == sorted(map(str, jobs.run_health(batch, by=["run_id"]).collect()))


def test_stream_ingest_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 100) for i in range(5)], "doc_id long, text string")
    for k in range(2):
        docs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert jobs.current_chunks(spark, str(tmp_path / "store")).count() == chunking.chunk_fixed(docs).count()


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"documents": [{"filename": "a.pdf", "version_label": "", "effective_from": "2024-01-01"}, {"filename": "b.csv", "effective_to": ""}]}')
    got = [tuple(r) for r in ingest.read_manifest(spark, str(tmp_path / "m.json")).select("filename", "version_label", "effective_from", "effective_to").orderBy("filename").collect()]
    assert got == [("a.pdf", "v1", "2024-01-01", None), ("b.csv", "v1", None, None)]
    for name, text in (("list.json", '[{"id": "x"}, {"id": "y"}]'), ("object.json", '{"items": [{"id": "x"}, {"id": "y"}]}')):
        (tmp_path / name).write_text(text)
        assert [(r["ord"], r["id"]) for r in ingest.read_eval_set_json(spark, str(tmp_path / name)).orderBy("ord").collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "e.csv").write_text('id,source_docs,answerable\nx," a ; ;b",Yes\ny,,perhaps\nz,a,no,more\nzz,a,no,\nzzz,a\n')
    got = [(r["source_docs"], r["answerable"], r["answerable_valid"], r["extra_cells"]) for r in ingest.read_eval_set_csv(spark, str(tmp_path / "e.csv")).orderBy("id").collect()]
    assert got == [(["a", "b"], True, True, False), (None, None, False, False), (["a"], False, True, True), (["a"], False, True, True), (["a"], None, True, False)]


def test_document_ids(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    ids = spark.createDataFrame([("x", 2), ("a", 1), ("x", 0)], "doc_id string, position long")
    assert [tuple(r) for r in evalsets.validate_document_ids(ids, docs).collect()] == [("x", 0, "unknown document")]
    assert [r["error"] for r in evalsets.validate_document_ids(ids.limit(0), docs).collect()] == ["no document is named"]
    assert evalsets.validate_document_ids(None, docs).collect() == []


def test_model_answers_and_errors(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no answer")
        return pd.DataFrame({"answer": prompts.str.upper(), "input_tokens": prompts.str.len(), "output_tokens": [7] + [None] * (len(prompts) - 1)})

    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id int, prompt string").coalesce(1)
    got = [(r["generated_answer"], r["input_tokens"], r["output_tokens"], r["status"], r["error_message"]) for r in scorers.generate(rows, model).orderBy("id").collect()]
    assert got == [("GOOD", 4, 7, "ok", None), ("", 0, 0, "error", "no answer"), ("FINE", 4, 7, "ok", None)]
    plain = scorers.generate(rows, lambda p: p.str[:2]).where("id <> 2").orderBy("id").collect()
    assert [(r["generated_answer"], r["input_tokens"]) for r in plain] == [("go", 0), ("fi", 0)]


def test_missing_results_by_bitmaps(spark):
    items = spark.createDataFrame([(f"q{i}", i) for i in range(40_000)], "id string, ord long")
    runs = spark.createDataFrame([("whole",), ("short",), ("none",)], "run_id string")
    gone = {3, 8, 32_767, 32_768, 39_999}
    rows = items.select(F.lit("whole").alias("run_id"), F.col("id").alias("query_id")).union(items.where(~F.col("ord").isin(*gone)).select(F.lit("short"), "id"))
    found = reporting.missing_results(runs, rows.union(rows.limit(5)), items)
    got = {(r["run_id"], r["n"]) for r in found.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert got == {("short", 5), ("none", 40_000)}
    assert {r["query_id"] for r in found.where("run_id = 'short'").collect()} == {f"q{i}" for i in gone}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_repeated_text_keeps_its_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 2000, "f", "v1", 0, None)], "doc_id long, text string, filename string, doc_version string, effective_from long, effective_to long")
    others = spark.createDataFrame([(1, 0, "t", "table"), (1, 1, "t", "table"), (1, 2, " ", "table")], "doc_id long, elem_idx int, content string, chunk_type string")
    out = chunking.build_index_chunks(docs, others, list(chunking.PLACES), docs)
    assert out.count() == out.select("chunk_id").distinct().count()
    assert out.where("chunk_strategy = 'atomic'").count() == 2 and out.where("filename is null").count() == 0


def test_a_fault_keeps_the_whole_set_out(spark):
    schema = "ord int, id string, question string, ground_truth string, valid_from string, modality string, failure_type string, source_docs array<string>"
    good = [(0, "a", "q", "t", None, None, None, ["f", "g"]), (1, "b", "q", "t", None, None, None, None)]
    docs = spark.createDataFrame([("f",)], "filename string")
    got = evalsets.register_eval_set(spark.createDataFrame(good, schema), docs).collect()
    assert [(r["item_count"], r["n_unmatched"]) for r in got] == [(2, 1)] * 2
    assert evalsets.register_eval_set(spark.createDataFrame([*good, (2, "a", "q", "t", None, None, None, None)], schema), docs).isEmpty()


def test_stream_evaluate_equals_batch(spark, tmp_path):
    schema = "run_id string, query_id string, status string, ts timestamp, faithfulness double, context_recall double, context_precision double, answer_correctness double, retrieved_chunks array<struct<rank:int,filename:string,doc_version:string,chunk_type:string,effective_from:long,effective_to:long,source:string>>"
    at = Q - Q % 86400
    from datetime import datetime

    rows = [(f"r{i % 2}", f"q{i % 4}", "error" if i == 3 else "ok", datetime(2024, 1, 1), i / 10, 0.9, 0.9, 0.2, [(1, "f", "v1", "text", at - 10, at - 5, None)]) for i in range(8)]
    results = spark.createDataFrame(rows, schema).dropDuplicates(["run_id", "query_id"])
    items = spark.createDataFrame([(f"q{i}", "2024-06-01" if i else None, "text", None, None, None) for i in range(4)], "id string, valid_from string, modality string, source_docs array<string>, expected_version string, failure_type string")
    results.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.stream_evaluate(spark.readStream.schema(results.schema).parquet(str(tmp_path / "in")), items, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    want = diagnosis.diagnose(spark.read.parquet(str(tmp_path / "in")), items).select("run_id", "query_id", "failure_category", "confidence")
    held = lambda: sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(want.columns).collect()))
    first = sorted(map(str, want.collect()))
    assert held() == first
    # the same results two hours and two days later add nothing; a new one does
    later = results.union(results.limit(1).withColumn("run_id", F.lit("r9")))
    for hours in (2, 48):
        later.withColumn("ts", F.col("ts") + F.expr(f"interval {hours} hours")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_evaluate(spark.readStream.schema(results.schema).parquet(str(tmp_path / "in")), items, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
        assert len(held()) == len(first) + 1 and set(first) < set(held())


def test_stream_status_keeps_runs_over_batches(spark, tmp_path):
    """A batch that lacks a run still counts it, and each state is emitted once."""
    schema = "experiment_id string, run_id string, ts long, status string, evaluated_at long, diagnosed_at long"
    batches = [
        [("e", "r1", 1, "running", None, None), ("e", "r1", 2, "done", 5, 6), ("e", "r2", 1, "running", None, None), ("f", "r3", 1, "running", None, None)],
        [("e", "r2", 3, "running", None, None)],
        [("e", "r2", 4, "done", 7, 8), ("e", "r1", 0, "pending", None, None)],
        [("e", "r2", 5, "done", 7, 8), ("f", "r3", 2, "failed", None, None)],
    ]
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        jobs.stream_experiment_status(events, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
        seen.append({r["experiment_id"]: r["next_status"] for r in spark.read.parquet(str(tmp_path / "out" / "changes" / f"batch={k}")).collect()})
    assert seen == [{"e": None, "f": None}, {}, {"e": "done"}, {"f": "failed"}]


def test_emptied_documents_lose_their_chunks(spark, tmp_path):
    schema = "doc_id long, text string"
    for rows in ([(1, "x" * 600), (2, "y" * 600)], [(1, ""), (2, "z" * 100)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(docs, str(tmp_path / "store"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    assert [(r["doc_id"], r["content"]) for r in jobs.current_chunks(spark, str(tmp_path / "store")).collect()] == [(2, "z" * 100)]


def test_a_batch_writes_only_its_own_chunks(spark, tmp_path):
    """Batches, compactions between them and a compaction ended halfway give each document's last chunks."""
    store, schema = str(tmp_path / "store"), "doc_id long, text string"
    batches = [[(i, f"a{i} " * 300) for i in range(6)] + [(None, "nobody")], [(1, "b1"), (2, None)], [(2, "c2 " * 400), (3, " "), (9, "c9")], [(9, "d9")]]
    want: dict = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(docs, store, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
        want |= {i: text for i, text in rows if i is not None}
        plain = chunking.chunk_fixed(spark.createDataFrame(list(want.items()), schema))
        read = lambda: sorted(map(str, jobs.current_chunks(spark, store).select(plain.columns).collect()))
        expected = sorted(map(str, plain.collect()))
        assert read() == expected
        (written,) = [f for f in (tmp_path / "store").iterdir() if f.name == f"gen={2 * k}"]
        assert {r["doc_id"] for r in spark.read.parquet(str(written)).collect()} == {i for i, _ in rows if i is not None}
        if k == 1:
            jobs.compact_chunks(spark, store)
            assert [f.name for f in (tmp_path / "store").iterdir()] == ["gen=3"] and read() == expected
        if k == 2:
            (tmp_path / "store" / "gen=5" / "_temporary").mkdir(parents=True)
            assert read() == expected
    jobs.compact_chunks(spark, store)
    jobs.compact_chunks(spark, store)
    assert [f.name for f in (tmp_path / "store").iterdir() if (f / "_SUCCESS").exists()] == ["gen=7"] and read() == expected
    with pytest.raises(FileNotFoundError):
        jobs.current_chunks(spark, str(tmp_path / "none"))


def test_statuses_of_random_events(spark, tmp_path):
    """The changes of each batch against a plain recount of all events so far."""
    rng, schema = np.random.default_rng(5), "experiment_id string, run_id string, ts long, status string, evaluated_at long, diagnosed_at long"
    held, last = [], {}
    for k in range(4):
        made = [(f"e{e}", f"r{r}", int(rng.integers(30)) if rng.random() < 0.9 else None, str(rng.choice(["pending", "done", "done", "done", "failed"])), *(1 if rng.random() < 0.8 else None for _ in range(2))) for e, r in zip(rng.integers(4, size=12).tolist(), rng.integers(3, size=12).tolist(), strict=True)]
        held += made
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_experiment_status(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
        got = {r["experiment_id"]: r["next_status"] for r in spark.read.parquet(str(tmp_path / "out" / "changes" / f"batch={k}")).collect()}
        runs: dict = {}
        for e, r, ts, status, evaluated, diagnosed in held:
            row = (-1 if ts is None else ts, diagnosed is not None, evaluated is not None, status)
            runs[e, r] = max(runs.get((e, r), row), row)
        now = {}
        for e in {e for e, _ in runs}:
            own = [row for (x, _), row in runs.items() if x == e]
            done = [row for row in own if row[3] == "done"]
            now[e] = None if any(row[3] == "pending" for row in own) else "failed" if not done else "done" if all(row[1] for row in done) else "diagnosing" if all(row[2] for row in done) else "evaluating"
        assert got == {e: state for e, state in now.items() if e not in last or last[e] != state}
        last = now


def test_grounding_counts_source_documents_only(spark):
    chunk = "array<struct<chunk_type:string,filename:string,effective_from:long,effective_to:long>>"
    results = spark.createDataFrame([("r", "a", "ok", [("table", "f", None, None)]), ("r", "b", "ok", [("table", "f", None, None)]), ("r", "c", "ok", [(None, "g", None, None), ("image", "g", None, None)]), ("r", "d", "ok", [("text", "g", None, None)])], f"run_id string, query_id string, status string, retrieved_chunks {chunk}")
    items = spark.createDataFrame([("a", None, "table", ["g"]), ("b", None, "table", ["f"]), ("c", None, "mixed", None), ("d", None, "chart", [])], "id string, valid_from string, modality string, source_docs array<string>")
    assert metrics.with_items(results, items).agg(metrics.multimodal_grounding_rate().alias("x")).first()["x"] == 0.5


def test_new_metrics_take_the_place_of_old_ones(spark):
    schema = "run_id string, faithfulness double, diagnostic_accuracy double"
    got = metrics.upsert_run_metrics(spark.createDataFrame([("r", 0.5, 0.9), ("s", 0.1, 0.2)], schema), spark.createDataFrame([("r", None, None)], schema)).collect()
    assert sorted(map(tuple, got)) == [("r", None, 0.9), ("s", 0.1, 0.2)]


def test_headings_and_blanks(spark):
    lines = ["Section 2.1 applies here", "GPT4 2024", "Section 1 – Definitions.", "INTRODUCTION", "## Two", "Section 2(a)(1)", "Article 7: x"]
    got = [bool(splitting.HEADING.search(x)) for x in lines]
    assert got == [False, False, True, True, True, False, True]
    assert chunking.chunk_fixed(spark.createDataFrame([(1, "\n\t" * 300)], "doc_id long, text string")).count() == 0


def test_untagged_text_serves_the_recursive_strategy(spark):
    chunks = spark.createDataFrame([("text", None), ("table", "fixed")], "chunk_type string, chunk_strategy string")
    names = spark.createDataFrame([("fixed",), ("recursive",)], "strategy string")
    found = lambda df: {r["strategy"]: r["reason"] for r in retrieval.strategy_not_indexed(df, names).collect()}
    assert found(chunks) == {"fixed": "not indexed", "recursive": None}
    assert found(chunks.where("chunk_type = 'table'")) == {"fixed": None, "recursive": None}


def test_each_strategy_retrieves_in_its_own_way(spark):
    """Unknown strategies act as vector_only, unknown parsing sees all types, the newest come first under recency_biased."""
    chunks = [("a", "cat cat cat", "text", 30), ("b", "dog dog", "text", 20), ("c", "cat dog", "image", 10), ("d", "mouse", "image", 5), ("e", "mouse", "image", 4)]
    chunks = spark.createDataFrame([(i, t, k, "recursive", f, None) for i, t, k, f in chunks], "chunk_id string, content string, chunk_type string, chunk_strategy string, effective_from long, effective_to long")
    items = spark.createDataFrame([("q", "cat", None)], "id string, question string, valid_from string")
    settings = [("r1", "vector_only", "text_only", "none"), ("r2", "bm25", "text_only", "none"), ("r3", "hybrid", "text_only", "none"), ("r4", "hybrid_reranker", "text_only", "none"), ("r5", "magic", "any", "none"), ("r6", "bm25", "any", "recency_biased")]
    runs = spark.createDataFrame([(r, s, p, "recursive", f) for r, s, p, f in settings], "run_id string, retrieval_strategy string, parsing_strategy string, chunking_strategy string, freshness_policy string")
    count = lambda t: F.array(*[F.size(F.split(t, w)).cast("double") - 1 for w in ("cat", "dog", "mouse")])
    got = retrieval.retrieve(runs, items, chunks, 2, count).orderBy("run_id", "rank").collect()
    lists = {}
    for r in got:
        lists.setdefault(r["run_id"], []).append(r["chunk_id"])
    assert lists == {"r1": ["a", "b"], "r2": ["a", "b"], "r3": ["a", "b"], "r4": ["a", "b"], "r5": ["a", "c"], "r6": ["a", "c"]}
    assert {r["run_id"] for r in got if r["reranked"]} == {"r4"}


def test_a_comparison_names_what_is_missing(spark):
    schema = "run_id string, retrieval_strategy string, chunking_strategy string, parsing_strategy string, freshness_policy string"
    base, other = ("b", *ranking.BASELINE.values()), ("r", "hybrid", "recursive", "text_only", "none")
    values = "run_id string, " + ", ".join(f"{m} double" for m in ranking.SORTABLE)
    scored = spark.createDataFrame([("b", *[0.5] * 9), ("r", *[0.6] * 8, None)], values)
    error = lambda rows, target=None: ranking.baseline_comparison(spark.createDataFrame(rows, schema), scored, target).first()
    assert error([other])["error"] == "no_baseline" and error([base])["error"] == "no_other_runs" and error([base, other], "x")["error"] == "unknown_target"
    good = error([base, other])
    assert (good["run_id"], good["improvements"], good["regressions"], good["not_compared"], good["top_change"]) == ("r", 7, 1, 1, 20.0)


def test_an_empty_or_overlong_set_is_one_fault(spark):
    schema = "ord int, id string, question string, ground_truth string"
    assert [r["message"] for r in evalsets.validate_eval_items(spark.createDataFrame([], schema)).collect()] == ["no items"]
    many = spark.range(evalsets.MOST_ITEMS + 1).select(F.col("id").cast("int").alias("ord"), F.lit(None).cast("string").alias("id"), F.lit("q").alias("question"), F.lit("t").alias("ground_truth"))
    assert [r["message"] for r in evalsets.validate_eval_items(many).collect()] == ["too many items"]


def test_classifier_is_judged_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    rows = [("r", f"q{i}", "A" if x > 0.5 else "B", float(x), float(rng.random())) for i, x in enumerate(rng.random(120))]
    own = spark.createDataFrame(rows, "run_id string, query_id string, label string, f_x double, f_noise double").cache()
    parts = {r["query_id"]: r["held_out"] for r in ml.split(own).collect()}
    for label in "AB":
        n = [parts[q] for _, q, k, *_ in rows if k == label]
        assert abs(sum(n) - 0.2 * len(n)) <= 1
    model = ml.train_classifier(own, trees=20)
    said = {r["query_id"]: (r["label"], r["probability"]) for r in ml.predict(model, own).collect()}
    held = [(q, k) for _, q, k, *_ in rows if parts[q]]
    right = sum(said[q][0] == k for q, k in held)
    got = ml.accuracy(model, own).first()
    assert got["n"] == len(held) and abs(got["accuracy"] - right / len(held)) < 1e-4 and right / len(held) > 0.8
    table = ml.importances(model, spark).collect()
    assert [r["feature"] for r in table] == ["f_x", "f_noise"] and abs(sum(r["importance"] for r in table) - 1) < 1e-6
    bins = ml.reliability(model, own).collect()
    assert sum(r["n"] for r in bins) == len(held) and all(abs(r["probability"] - np.mean([said[q][1] for q, _ in held if min(int(said[q][1] * 10), 9) == r["bin"]])) < 1e-3 for r in bins)
    few = own.limit(12).union(own.limit(1).withColumn("label", F.lit("C")))
    assert 0 <= ml.split(few).where("held_out").count() < 13 and "C" in {r["label"] for r in ml.split(few).collect()}


def test_the_split_holds_exact_quotas(spark):
    """Largest remainders by label, the rows of smallest hashes; one stratum where labels are too few."""

    def want(sizes):
        whole = -(-sum(sizes.values()) // 5)
        held = {k: n * whole // sum(sizes.values()) for k, n in sizes.items()}
        rest = sorted(sizes, key=lambda k: (-(sizes[k] * whole % sum(sizes.values())), k))
        return {k: held[k] + (k in rest[: whole - sum(held.values())]) for k in sizes}

    for sizes in ({"A": 7003, "B": 11, "C": 2, "D": 9, "": 6}, {"A": 3, "B": 3}, {"A": 30, "B": 1}, {"A": 21}):
        rows = [(f"r{i % 7}", f"q{i}", k, float(i)) for k, n in sizes.items() for i in range(n)]
        own = spark.createDataFrame(rows, "run_id string, query_id string, label string, f_x double").withColumn("query_id", F.concat("query_id", F.lit("_"), "label"))
        got = ml.split(own).withColumn("h", F.xxhash64("run_id", "query_id")).collect()
        assert len(got) == len(rows) and set(got[0].asDict()) == {"run_id", "query_id", "label", "f_x", "held_out", "h"}
        strata = {k: [r for r in got if r["label"] == k] for k in sizes} if min(sizes.values()) > 1 and len(rows) >= 20 else {"": got}
        for k, n in want({k: len(v) for k, v in strata.items()}).items():
            assert {r["query_id"] for r in strata[k] if r["held_out"]} == {r["query_id"] for r in sorted(strata[k], key=lambda r: r["h"])[:n]}
    assert ml.split(own.limit(0)).collect() == []


def test_permuted_values_and_their_importances(spark):
    rng = np.random.default_rng(6)
    rows = [("r", f"q{i}", "A" if x > 0.5 else "B", float(x), i) for i, x in enumerate(rng.random(90))]
    own = spark.createDataFrame(rows, "run_id string, query_id string, label string, f_x double, f_noise long").cache()
    names = ["f_noise", "f_x"]
    for block in (20, 1000):
        found = ml.permuted(own, names, 3, block).toPandas()
        assert len(found) == 90 * (1 + 2 * 3)
        for (feature, _), part in found.dropna(subset="feature").groupby(["feature", "repeat"]):
            part, other = part.set_index("query_id"), next(n for n in names if n != feature)
            plain = {q: {"f_x": x, "f_noise": n} for _, q, _, x, n in rows}
            assert sorted(part[feature]) == sorted(v[feature] for v in plain.values())
            assert all(part.loc[q, other] == v[other] for q, v in plain.items()) and sum(part.loc[q, feature] != v[feature] for q, v in plain.items()) > 80
    model = ml.train_classifier(own, trees=20)
    got = {r["feature"]: (r["importance"], r["spread"]) for r in ml.permutation_importances(model, own, 3).collect()}
    said = model.transform(ml.permuted(ml.split(own).where("held_out"), names, 3)).select("feature", "repeat", "label", "predicted").toPandas()
    right = (said["label"] == said["predicted"]).groupby([said["feature"].fillna("-"), said["repeat"]]).mean()
    for name in names:
        lost = right["-", 0] - right[name]
        assert np.allclose(got[name], (lost.mean(), lost.std(ddof=0)), atol=1e-8)
    assert got["f_x"][0] > 0.2 > abs(got["f_noise"][0])
    assert ml.permuted(own.limit(0), names, 2).collect() == []


def test_importances_need_no_copies_of_rows(spark, monkeypatch):
    """A block's rows meet the forest's tables once; classes and importances are those of Spark's model on all copies."""
    rng = np.random.default_rng(11)
    rows = [(f"r{i % 3}", f"q{i}", "ABC"[int(x + z / 4) % 3], float(x), float(rng.random()), float(z), 1.0) for i, (x, z) in enumerate(zip(rng.integers(0, 6, 900), rng.integers(0, 5, 900)))]
    own = ml.prepared(spark.createDataFrame(rows, "run_id string, query_id string, label string, f_x double, f_y double, f_z double, f_one double"))
    model = ml.train_classifier(own, trees=30)
    names, monkey = model.stages[1].getInputCols(), ml.PERMUTED
    odd = own.withColumn("label", F.when(F.col("query_id") == "q7", "D").when(F.col("query_id").endswith("1"), None).otherwise(F.col("label")))
    forest = ml.Forest(model.stages[2])
    near = [[x + d for x in t for d in (-1e-9, 0.0, 1e-9)] or [0.0] for t in forest.thresholds]
    points = [[float(rng.choice(c)) for c in near] for _ in range(500)]
    said = model.transform(spark.createDataFrame([("r", f"q{i}", "A", *p) for i, p in enumerate(points)], ["run_id", "query_id", "label", *names])).toPandas()["prediction"]
    (feature, repeat, classes), *_ = forest.moved(list(np.array(points).T), [1])
    assert feature is None and repeat == 0 and (classes == said).all() and len(set(said)) == 3
    for rows, block in ((own, monkey), (odd, 40)):
        copies = model.transform(ml.permuted(rows.where("held_out"), names, 3, block)).dropna(subset="label").toPandas()
        right = (copies["label"] == copies["predicted"]).groupby([copies["feature"].fillna("-"), copies["repeat"]]).mean()
        with monkeypatch.context() as m:
            m.setattr(ml, "PERMUTED", block)
            m.setattr(ml, "permuted", None)
            got = {r["feature"]: (r["importance"], r["spread"]) for r in ml.permutation_importances(model, rows, 3).collect()}
        assert got.keys() == set(names) and got["f_one"] == (0, 0)
        for name in names:
            lost = right["-", 0] - right[name]
            assert np.allclose(got[name], (lost.mean(), lost.std(ddof=0)), atol=1e-8)


def test_embedding_counts_hashed_words(spark):
    import re

    texts = ["One two two, THREE", "", None, "a_b 7"]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scorers.embed("t", 8).alias("v")).collect()]
    words = sorted({w for t in texts if t for w in re.split(r"\W+", t.lower()) if w})
    places = {r["w"]: r["h"] % 8 for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for text, vector in zip(texts, got, strict=True):
        want = [0.0] * 8
        for w in re.split(r"\W+", (text or "").lower()):
            if w:
                want[places[w]] += 1
        assert vector == want


def test_html_elements_against_plain_python(spark):
    import re

    pages = ["<h1>T &amp; U</h1><p>a <b>b</b>\nc</p><script><p>no</p></script><table><tr><td>1</td></tr></table><p> </p><ul><li>x</li></ul><table>2</table>", "", None, "plain"]
    got = [(r["page_id"], r["content"], r["chunk_type"], r["table_id"], r["is_heading"]) for r in ingest.html_to_elements(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).orderBy("page_id", "elem_idx").collect()]
    want = []
    for i, page in enumerate(pages):
        tables = 0
        for m in re.finditer(r"(?is)<(h[1-6]|p|li|table)\b[^>]*>(.*?)</\1>", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", page or "")):
            text = " ".join(re.sub(r"<[^>]*>", " ", m[2]).replace("&amp;", "&").split())
            if text:
                table = m[1] == "table"
                want.append((i, text, "table" if table else "text", f"table_{tables}" if table else None, m[1][0] == "h"))
                tables += table
    assert got == want and len(want) == 5


def test_probed_lists_find_most_of_the_nearest(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.4, 16)).tolist()) for i in range(1500)] + [(1500, None), (1501, [0.0] * 16)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    questions = own.where("vec_id % 50 = 0 and embedding is not null").withColumnRenamed("vec_id", "question_id")
    centroids = vector_lists.train_lists(own, lists=16, sample=500)
    assert centroids.centroids.shape == (16, 16) and 1 <= centroids.probes <= 16
    listed = vector_lists.with_list(own, centroids)
    assert listed.count() == 1501
    kept = own.where("embedding is not null")
    found = vector_lists.probed_top_k(questions, listed, centroids, 10)
    assert np.mean([r["recall"] for r in vector_lists.recall(questions, kept, found, 10).collect()]) >= 0.9
    whole = vector_lists.probed_top_k(questions, listed, centroids, 10, probes=16)
    assert all(r["recall"] == 1 for r in vector_lists.recall(questions, kept, whole, 10).collect())
    none = own.limit(0)
    assert vector_lists.probed_top_k(questions, vector_lists.with_list(none, centroids), vector_lists.train_lists(none), 10).collect() == []


def test_percentiles_of_large_runs(spark):
    """Runs above and below the size that is ranked whole, with ties, nulls, errors and runs without a latency."""
    rng = np.random.default_rng(3)
    rows = [("ties", "ok", float(x)) for x in rng.choice([5, 5, 5, 90, 1000], 6000)]
    rows += [("wide", None, float(x)) for x in rng.lognormal(5, 2, 30001)] + [("wide", "error", 1e9)] * 2000 + [("wide", "ok", None)] * 700
    rows += [("edge", "ok", 1.0)] * 1900 + [("edge", "ok", 2.0)] * 1900 + [("edge", "ok", float("nan"))] * 200
    rows += [("few", "ok", float(x)) for x in range(8)] + [(None, "ok", 3.0), ("none", "ok", None), ("failed", "error", 1.0)]
    results = spark.createDataFrame(rows, "run_id string, status string, latency_ms double")
    got = {r["run_id"]: (r["latency_p50_ms"], r["latency_p95_ms"]) for r in metrics.latency_percentiles(results).collect()}
    whole = results.where("coalesce(status, 'ok') <> 'error'").groupBy("run_id").agg(F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    expected = {r["run_id"]: tuple(r["q"] or (None, None)) for r in whole.collect()}
    assert got.keys() == expected.keys() and len(got) == 6
    for run, pair in expected.items():
        assert [x is None for x in got[run]] == [x is None for x in pair]
        assert np.allclose([x for x in got[run] if x is not None], [x for x in pair if x is not None], rtol=0, atol=1e-6, equal_nan=True)
    assert metrics.latency_percentiles(results.where("false")).count() == 0


def test_embedding_cuts_a_text_once(spark):
    """Its time is that of cutting the text, not that times the vector's places."""
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 977}" for j in range(3000))) for i in range(1000)], "i long, t string").cache()

    def seconds(c):
        took = []
        for _ in range(2):
            began = time.time()
            texts.select(F.sum(F.hash(c))).collect()
            took.append(time.time() - began)
        return min(took)

    texts.count()
    assert seconds(scorers.embed("t")) < 8 * seconds(scorers.tokens("t")) + 1


def test_a_prepared_training_set_is_computed_once(spark):
    """The split, the fit and all judgements read what prepared() computed."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [("r", f"q{i}", "AB"[i * 7 % 10 > 4], float(i * 7 % 10), "text") for i in range(200)]
    plain = spark.createDataFrame(rows, "run_id string, query_id string, label string, f_x double, more string")
    own = ml.prepared(plain.mapInArrow(passed, plain.schema))
    assert own.columns == ["run_id", "query_id", "label", "f_x", "held_out"]
    model = ml.train_classifier(own, trees=5)
    got = ml.accuracy(model, own).first(), ml.report(model, own).collect(), ml.reliability(model, own).collect(), ml.permutation_importances(model, own, 2).collect()
    assert ml.predict(model, own).count() == 200 and seen.value == 200
    assert sorted(map(tuple, own.collect())) == sorted(tuple(r[c] for c in own.columns) for r in ml.split(plain).collect())
    assert got[0]["n"] == 40


def test_a_cosine_at_the_threshold_does_not_cut():
    """17 / sqrt(5 * 80) is 0.85 and not below it; the product of the two rounded roots is a little larger."""
    v = np.array([[1, 1, 1, 1, 1, 0], [0, 2, 5, 5, 5, 1], [0, 2, 5, 5, 5, 1], [0, 2, 5, 5, 5, 1]], float)
    assert len(splitting.semantic_chunks(["A. B. C. D."], 0.85, lambda _: v)[0]) == 1
    assert len(splitting.semantic_chunks(["A. B. C. D."], 0.8500001, lambda _: v)[0]) == 2


def test_similarities_are_held_a_slice_at_a_time(monkeypatch):
    """Vectors of a batch meet the questions in slices of CELLS, whatever the size of both; results are the same."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, (6000, 8)).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array([f"v{i}" for i in rng.permutation(6000)]), pa.array(x.tolist()), pa.array((np.arange(6000) % 2).tolist())], ["vec_id", "embedding", "group"])
    sent = type("Sent", (), {"value": (pa.array(np.arange(2000)), retrieval._unit(pa.array(x[:2000].tolist())))})

    def found():
        tracemalloc.start()
        out = pa.Table.from_batches(list(retrieval._nearest(sent, 5, True)(iter([batch])))).to_pandas()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    out, peak = found()
    assert peak < 150e6
    monkeypatch.setattr(retrieval, "CELLS", 1 << 30)
    pd.testing.assert_frame_equal(out, found()[0])
    sims = np.round(sent.value[1][7] @ retrieval._unit(batch.column("embedding")).T, 9)
    want = sorted((-s, v) for s, v, g in zip(sims, batch.column("vec_id").to_pylist(), batch.column("group").to_pylist()) if g == 1)[:5]
    got = out[(out["question_id"] == 7) & (out["group"] == 1)]
    assert list(zip(-got["similarity"], got["vec_id"])) == want


def test_mean_costs_round_the_same_in_any_order(spark):
    """Means halfway between two figures go up, however double sums would come out."""
    rng, rows, want = np.random.default_rng(3), [], {}
    for g in range(60):
        units = rng.integers(50_000, 110_000, 32)
        units[0] += (16 - units.sum()) % 32  # the mean is some figure and a half
        want[f"r{g}"] = (int(units.sum()) // 32 + 1) / 1e9
        rows += [(f"r{g}", f"q{i}", "ok", round(int(u) * 1e-9, 9)) for i, u in enumerate(units)]
    own = spark.createDataFrame(rows, "run_id string, query_id string, status string, cost_usd double")
    scores = {c: F.lit(None).cast("double") for c in metrics.SCORES}
    chunk = "array<struct<chunk_type:string,filename:string,effective_from:bigint,effective_to:bigint>>"
    own = own.withColumns({"latency_ms": F.lit(1.0), "input_tokens": F.lit(1), "output_tokens": F.lit(1), "retrieved_chunks": F.array().cast(chunk)} | scores)
    items = spark.createDataFrame([], "id string, valid_from string, modality string, source_docs array<string>")
    found = metrics.compute_run_metrics(own.select("run_id").distinct(), own, items).select("run_id", "avg_cost_usd").collect()
    assert {r["run_id"]: r["avg_cost_usd"] for r in found} == want


def test_chunk_texts_come_along_as_far_as_prompts_show_them(spark):
    own = queries.results(spark, "/root/testdata/sf0.001", content=True)
    longest = own.select(F.max(F.array_max(F.transform("retrieved_chunks", lambda c: F.length(c["content"]))))).first()[0]
    assert longest == diagnosis.PROMPT_CHARS


def test_a_bucket_gets_each_text_once(spark, monkeypatch):
    """Texts are moved for the buckets that name them, not for the answers; splits and joins of many leave the same rows."""
    rng, original = np.random.default_rng(12), diagnosis._filled
    texts = [(f"{d}#{i}", v, f"text {d} {i} {v} " * 40) for d in range(40) for i in range(2) for v in range(1 + (d == 3))]
    named = [[(f"{(d + k * k) % 41}#{k % 2}", 0 if k != 1 else d % 2) for k in range(n % 6)] for n, d in enumerate(rng.integers(0, 40, 600).tolist())] + [[("5#0", 0), ("5#1", 0)]] * 900
    own = spark.createDataFrame([("r", f"q{n}", n, [(f, k, n) for f, k in c]) for n, c in enumerate(named)], "run_id string, query_id string, n int, retrieved_chunks array<struct<chunk_id:string,text_key:int,page:int>>").localCheckpoint()
    known = {(c, k): t[: diagnosis.PROMPT_CHARS] for c, k, t in texts}
    bucket = lambda c: F.shiftright(F.substring_index(c, "#", 1).cast("long"), 3)

    def found():
        seen = spark.sparkContext.accumulator(0)

        def counted(batches):
            for batch in batches:
                seen.add(batch.column("_row").null_count)
                yield batch

        monkeypatch.setattr(diagnosis, "_filled", lambda batches: original(counted(batches)))
        given = spark.createDataFrame(texts, "chunk_id string, text_key int, content string")
        rows = diagnosis.with_texts(own, given, bucket).collect()
        assert len(rows) == len(named)
        for r in rows:
            assert [tuple(c) for c in r["retrieved_chunks"]] == [(f, k, r["n"], known.get((f, k))) for f, k in named[r["n"]]] and r["query_id"] == f"q{r['n']}"
        return seen.value

    home = lambda f: int(f.partition("#")[0]) // 8
    far = {(home(c[0][0]), x) for c in named for x in c if x in known and home(x[0]) != home(c[0][0])}
    assert found() == len(texts) + len(far) < 400
    monkeypatch.setattr(diagnosis, "MOST_FAR", 0)
    assert found() == len(texts) + len(far)
    monkeypatch.setattr(diagnosis, "MOST_ANSWERS", 300)
    assert len(texts) + len(far) < found() < 600
    empty = diagnosis.with_texts(own.limit(0), spark.createDataFrame(texts, "chunk_id string, text_key int, content string"), bucket)
    assert empty.collect() == []


def test_prompts_have_the_texts_of_their_chunks(spark):
    """The query's prompts are those of results that carry the texts, and its shuffles carry no text with an answer."""
    d = "/root/testdata/sf0.001"
    items = queries.items(spark, d)
    whole = diagnosis.reasoning_prompt(diagnosis.diagnose(queries.results(spark, d, content=True), items), items)
    got = queries.g22_reasoning_prompt(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    grouped = queries.diagnoses(spark, d, keyed=True).select(F.col("retrieved_chunks.content").alias("c")).where(F.exists("c", lambda c: c.isNotNull()))
    assert grouped.count() == 0
