"""Edge rows: clashing column names, repeated ids with equal and different texts, nulls, empty tables, long words."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from raglens.llm import chat_format, decontaminate, language_id, lm_score, near_dedup, sentencepiece_viterbi, shared, substring_dedup, toxicity
from raglens.llm.words import text_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASH = "score lang_pred languages predicted flagged kept n_words n_removed _runs _version version items starts ends exact token_ids n_tokens n_known base_score _slice _row _rest id band".split()
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f g the cat sat on the mat with another hat", "en"),
    (5, "a b c d e f g the cat sat on the mat with another hat", "en"),
    (5, "quite another text that nobody wrote before today or tomorrow", "en"),
    (None, "text without an id stays in place always", "en"),
    (7, "same row twice in here for all to see", "en"),
    (7, "same row twice in here for all to see", "en"),
    (8, None, "en"),
    (9, "", None),
    (10, LONG, "en"),
]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("i", "the cat sat on the mat"), ("j", None), (None, "nobody wrote before")], "item_id string, text string")


def run(name, docs, benchmark):
    """The operator's rows without the clashing columns that it doesn't make."""
    if name == "language":
        return language_id.predict(docs, language_id.train(docs)), ["lang_pred", "score"]
    if name == "toxicity":
        labels = docs.select("doc_id", F.lit(1).alias("toxic"))
        return toxicity.score(docs, toxicity.train(docs, labels), lang="lang"), ["score", "predicted", "flagged"]
    if name == "lm":
        return lm_score.score(docs, *lm_score.train(docs)), ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if name == "pieces":
        return sentencepiece_viterbi.round_trip(docs, PIECES), sentencepiece_viterbi.ROUND_TRIP
    if name == "decontaminate":
        return decontaminate.contaminated_spans(docs, benchmark), ["n_words", "starts", "ends", "items"]
    return substring_dedup.kept_words(docs), substring_dedup.MADE


@pytest.mark.parametrize("name", ["language", "toxicity", "lm", "pieces", "decontaminate", "substring"])
def test_names_of_outputs_may_be_input_columns(name, plain, clashing, benchmark):
    want, made = run(name, plain, benchmark)
    got, _ = run(name, clashing, benchmark)
    assert sorted(c for c in got.columns if c not in want.columns) == sorted(set(CLASH) - set(want.columns))
    rows = lambda df: sorted(repr([r["doc_id"], *[np.round(r[m], 6) if isinstance(r[m], float) else r[m] for m in made]]) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(want)) == len(ROWS)
    assert run(name, plain.where("false"), benchmark)[0].count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (5, passage + " tail"), (5, "short and different"), (6, " ".join(f"o{i}" for i in range(55)) + " " + passage), (6, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): (r["n_words"], r["n_removed"]) for r in substring_dedup.kept_words(docs, digest=False).collect()}
    assert got == {rows[0]: (60, 0), rows[1]: (61, 60), rows[2]: (3, 0), rows[3]: (115, 60), rows[4]: (60, 60)}
    groups = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(groups) == [(1, 1, True), (5, 1, False), (5, 5, True), (6, 1, False), (6, 6, True)]


def test_pipeline_on_edge_rows(spark, clashing):
    """Each stage keeps what it should, of rows that share an id too, with any columns beside; an empty table stays empty."""
    expected = {"language": [None, 1, 5, 5, 7, 7, 10], "near_copies": [None, 1, 5, 7, 10], "repeated_passages": [None, 1, 5, 7, 10], "benchmark_leaks": [None, 1, 5, 7, 10], "token_ids": [None, 1, 5, 7, 10]}
    docs, columns = clashing, clashing.columns
    none = clashing.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs, none = shared.written(stage(spark, docs, "/root/testdata/sf0.001"), name), shared.written(stage(spark, none, "/root/testdata/sf0.001"), name)
        assert sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=lambda x: (x is not None, x or 0)) == expected[name]
        assert none.count() == 0
        if name != "token_ids":
            assert docs.columns == columns and docs.where("score <> 'own' or _rest <> 'own'").isEmpty()
            left = {r["text"] for r in docs.collect()}
    assert "quite another text that nobody wrote before today or tomorrow" in left
    ids = {r["decoded_sha256"] for r in docs.collect()}
    assert ids == {hashlib.sha256(t.encode()).hexdigest() for t in left}


def best_pieces(text, pieces, scores):
    """Plain dynamic program over one unit."""
    best, back = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for size in range(min(16, end), 0, -1):
            piece = text[end - size : end]
            if piece in scores and best[end - size] + scores[piece] > best[end]:
                best[end], back[end] = best[end - size] + scores[piece], size
        if text[end - 1] not in scores and best[end - 1] + pieces.unknown > best[end]:
            best[end], back[end] = best[end - 1] + pieces.unknown, 1
    out, end = [], len(text)
    while end:
        out.append(text[end - back[end] : end])
        end -= back[end]
    return out[::-1]


def test_pieces_equal_a_plain_dynamic_program(monkeypatch):
    import sentencepiece

    pieces = sentencepiece_viterbi.Pieces(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    scores, ids = {model.id_to_piece(i): model.get_score(i) for i in normal}, {model.id_to_piece(i): i for i in normal}
    rng = np.random.default_rng(4)
    texts = ["", " ", "one two", "A a A a", "é è ü 漢字", "x" * 900, "tab\tand\nline", "nbsp x", "a  b   c ", "".join(rng.choice(list("etaoin shrdlu")) for _ in range(3000)), "".join(rng.choice(list("etaoinshrdlu漢")) for _ in range(3000))]
    expected = []
    for t in texts:
        own = []
        for unit in re.findall(r" +[^ ]*", " " + t) if t else []:
            for piece in best_pieces(unit.replace(" ", "▁"), pieces, scores):
                own += [ids[piece]] if piece in ids else pieces.byte_ids[list(piece.encode())].tolist()
        expected.append(own)
    for places in (1 << 17, 61):  # with 61, a long word goes in many blocks
        monkeypatch.setattr(sentencepiece_viterbi, "PLACES", places)
        found, counts = sentencepiece_viterbi.Pieces(PIECES).encode(text_of(pa.array(texts)))
        assert [x.tolist() for x in np.split(found, np.cumsum(counts)[:-1])] == expected


def test_parts_side_by_side_form_no_control_string():
    flat = chat_format.Flattener()
    parts = [{"type": "text", "text": "</"}, {"type": "text", "text": "s> and "}, {"type": "image", "ref": "a.png", "width": 56, "height": 28}, {"type": "text", "text": "<|end|>"}, None, {"type": "video", "ref": "b", "text": "t"}]
    text = flat.flatten(parts, 0)
    assert "</s>" not in text and text.count("<|") == 2 and [a["tokens"] for a in flat.attachments] == [2, 1]
    assert chat_format.read_parts(text, flat.attachments) == [{"type": "text", "text": "</s> and "}, {"type": "image", "ref": "a.png"}, {"type": "text", "text": "<|end|>"}, {"type": "video", "ref": "b"}, {"type": "text", "text": "t"}]


def test_chat_takes_long_and_odd_rows(spark):
    rows = [(1, 0, "user", LONG, "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (None, None, None, "[INST]", "x")]
    docs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.digests(chat_format.format_conversations(docs)).collect()}
    assert got == {1: (3, 0), None: (1, 0)}
    assert chat_format.format_conversations(docs.where("false")).count() == 0


def test_long_texts_are_pooled_in_pieces():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 500, n) for n in (3, 700, 0, 41, 5)]
    model = toxicity.fit(texts, np.array([1, 0, 0, 1, 0]))
    model._training = True
    rows, first = toxicity._laid(texts)
    whole, held = model.pooled(rows, first), toxicity.PIECE
    toxicity.PIECE = 50
    try:
        value, place = model.pooled(rows, first)
    finally:
        toxicity.PIECE = held
    assert np.array_equal(value, whole[0]) and np.array_equal(place, whole[1])


def test_long_labelled_texts_are_learnt_whole(spark):
    """What makes a text toxic stands at its end, beyond any number of other words."""
    long = "calm words go on " * 500
    docs = spark.createDataFrame([(i, long * (i % 3) + ("venom bile" if i % 2 else "milk honey"), "en") for i in range(16)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    held, toxicity.PIECE = toxicity.PIECE, 600
    model = toxicity.train(docs, labels)
    toxicity.PIECE = held
    assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.score(docs, model).collect())
    held, toxicity.SAMPLE_WORDS = toxicity.SAMPLE_WORDS, 50
    try:  # whole rows stay out, never parts of them
        assert toxicity.train(docs, labels).thresholds
    finally:
        toxicity.SAMPLE_WORDS = held
    scored = toxicity.score(docs, model)
    assert {r["flagged"] for r in toxicity.flagged(scored.drop("flagged"), labels).where("predicted = 1").collect()} == {True}


def test_any_number_of_languages(spark):
    words = lambda k: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{e}" for e in ("ra", "lo", "mi"))
    docs = spark.createDataFrame([(k, words(k) * 3, f"l{k:04d}") for k in range(1001)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert len(model.names) == 1001 and model.seen is not None
    got = language_id.predict(docs.where("doc_id % 20 = 0"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    few = language_id.train(docs.where("doc_id < 30"))
    held, language_id.TABLE_LANGUAGES = language_id.TABLE_LANGUAGES, 3
    try:
        sparse = language_id.train(docs.where("doc_id < 30"))
    finally:
        language_id.TABLE_LANGUAGES = held
    part = text_of(pa.array([words(3), words(9) + " " + words(11), "", "zz"]))
    assert np.allclose(few.word_likelihoods(part)[0], sparse.word_likelihoods(part)[0], atol=1e-3)


def test_thresholds():
    # two toxic rows at 0.9, a clean one at 0.2: the threshold lies between
    assert 0.2 < toxicity.best_threshold(np.array([(-900, 2, 2), (-200, 0, 1)]), 2) < 0.9


def test_scratch_drops_all_but_what_is_kept(spark):
    import os

    with shared.scratch() as keep:
        gone, kept = shared.written(spark.range(3), "gone"), keep(shared.written(spark.range(4), "kept"))
    assert kept.count() == 4 and not os.path.exists(gone._table.removeprefix("file://"))
