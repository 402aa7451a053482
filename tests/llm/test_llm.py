"""Operators against brute force on small fixtures, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raglens.llm import chat_format, decontaminate, fingerprints, language_id, lm_score, near_dedup, sentencepiece_viterbi, substring_dedup, token_files, toxicity
from raglens.llm.fm_index import FMIndex, WaveletMatrix, _sorted
from raglens.llm.words import ALNUM as ALNUM_BYTES
from raglens.llm.words import text_of, words_of

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "   ", "one", "two words", "A a A a", "é è ü 漢字", "x" * 5000, "tab\tand\nline", "▁mark ▁▁ own", "nbsp  x", "<|endoftext|> a", "a  b   c "]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéüKM.,", k=rng.randint(1, 7))) for _ in range(words)]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 60, 120, 300]))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Prose with copies, near copies, shared passages, ties and odd texts."""
    rng, out = random.Random(3), prose(1, 40)
    passage = " ".join(f"passage{i % 37} word{i}" for i in range(40))
    for k in range(0, 30, 3):
        out.append(out[k])
        words = out[k].split()
        for _ in range(max(0, len(words) // 60)):
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(f"{out[k + 1]} {passage} {out[k + 2]}")
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(5)


def empty(docs):
    return docs.where("false")


def test_wavelet_and_fm_index():
    rng = np.random.default_rng(5)
    symbols = rng.integers(1, 7, 500)
    starts = np.array([0, 100, 101, 350])
    wavelet = WaveletMatrix(symbols, 7)
    for c in range(7):
        assert [int(x) for x in wavelet.rank(np.full(501, c), np.arange(501))] == [int((symbols[:i] == c).sum()) for i in range(501)]
    assert (wavelet.access(np.arange(500)) == symbols).all()
    index = FMIndex(symbols, starts, 7, sample=8)
    parts = np.split(symbols, starts[1:])
    for n in (1, 2, 3, 5):
        pattern = symbols[110 : 110 + n]
        lo, hi = index.search(pattern, np.array([0]), np.array([n]))
        found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        true = sorted(int(index.first[k]) + i for k, p in enumerate(parts) for i in range(len(p) - n + 1) if (p[i : i + n] == pattern).all())
        assert found == true


def test_suffixes_are_sorted_with_ties_by_place():
    rng = np.random.default_rng(8)
    parts = [rng.integers(1, 4, n) for n in (40, 0, 3, 200)] * 3 + [np.ones(60, np.int64)]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    symbols = np.concatenate(parts)
    lengths = np.array([len(p) for p in parts])
    text = np.concatenate([np.append(p, 0) for p in parts])
    end = np.repeat(starts + np.arange(len(parts)) + lengths, lengths + 1)
    order, ranks = _sorted(text, end, int(lengths.max()) + 1, 4)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (text[i : end[i]].tolist(), i))
    for k, rank in ranks:
        own = [tuple(text[i : end[i] + 1].tolist()[:k]) for i in range(len(text))]
        assert len(set(own)) == len(set(rank.tolist())) == len(set(zip(own, rank.tolist(), strict=True)))
    index = FMIndex(symbols, starts, 4, sample=8)
    assert index.locate(np.arange(index.n)).tolist() == order.tolist()


def test_hits_of_a_shard():
    rng = np.random.default_rng(9)
    common = " ".join(f"c{k}" for k in range(30))
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 3, n)) for n in (0, 1, 50, 400, 0, 7)] + [common, "", common, f"x {common}", common + " w1 w2 w1"]
    items = [" ".join(docs[3].split()[20:45]), common, common, "w1 w2", "absent w1", "", "w0 w0 w0", docs[2]]
    words = words_of(text_of(pa.array(docs)), ALNUM_BYTES, lower=True)
    phrases = decontaminate.Phrases.of(pa.table({"item_id": [str(k) for k in range(len(items))], "text": items}))
    found = decontaminate.hits(phrases, words.hashes, words.first)
    spans, pairs = [], set()
    for d, text in enumerate(docs):
        w, hit = text.split(), set()
        for i, item in enumerate(items):
            t = item.split()
            n = min(len(t), 10)
            for a in range(len(t) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == t[a : a + n]:
                        hit.update(range(b, b + n))
                        pairs.add((d, i))
        spans += [(d, k) for k in sorted(hit)]
    assert [(r, k) for r, a, b in zip(found.row.tolist(), found.start.tolist(), found.end.tolist(), strict=True) for k in range(a, b)] == spans
    assert list(zip(found.with_item.tolist(), found.item.tolist(), strict=True)) == sorted(pairs)
    none = decontaminate.hits(phrases, words.hashes[:0], np.zeros(3, np.int64))
    assert len(none.row) == len(none.item) == 0


def test_repeated_windows_of_one_index():
    rng = np.random.default_rng(6)
    base = rng.integers(1, 5, 300)
    symbols, starts, owner = np.concatenate((base, base[50:150], base[:40], base)), np.array([0, 300, 400, 440]), np.array([7, 3, 9, 3])
    for n in (1, 5, 17, 50):
        index = FMIndex(symbols, starts, 5, sample=0, window=n, owner=owner)
        got = index.repeated(symbols, starts)
        seen = defaultdict(lambda: 10**9)
        parts = np.split(symbols, starts[1:])
        for p, o in zip(parts, owner, strict=True):
            for i in range(len(p) - n + 1):
                seen[p[i : i + n].tobytes()] = min(seen[p[i : i + n].tobytes()], int(o))
        for k, p in enumerate(parts):
            for i in range(len(p) - n + 1):
                assert got[starts[k] + i] == seen[p[i : i + n].tobytes()]


def test_near_duplicates(spark, docs, texts, monkeypatch):
    sets = {}
    for i, t in enumerate(texts):
        w = SPACED.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in range(a + 1, len(texts)):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    expected = {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    for small in (16, 1):  # with 1, what the stars leave goes to cells
        monkeypatch.setattr(near_dedup, "SMALL", small)
        got = near_dedup.near_duplicates(docs).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == expected
    assert near_dedup.near_duplicates(empty(docs)).count() == 0
    other = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["kept"]) for r in near_dedup.near_duplicates(other).collect()) == [("5", True), ("5", True), ("None", True)]


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    from raglens.llm.words import mix

    pool = mix(rng.integers(0, 2**62, 3000).astype(np.uint64))
    a, b, union = np.sort(pool[:2000]), np.sort(pool[500:3000]), np.sort(pool)
    r = near_dedup.set_sketches(np.concatenate((a, b, union)), np.array([0, 2000, 4500, 7500]), 1024)
    assert (near_dedup.merged(r[0], r[1]) == r[2]).all()
    assert abs(near_dedup.joint_estimate(r[:1], r[1:2], np.array([2000.0]), np.array([2500.0]))[0] - 0.5) < 0.06


def test_substring_dedup(spark, docs, texts, monkeypatch):
    first, expected = {}, {}
    for i, t in enumerate(texts):
        w, gone = SPACED.findall(t or ""), set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone.update(range(k, k + 50))
        expected[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    for size in (1 << 19, 200):  # with 200 words a shard, common anchors are cut into blocks
        monkeypatch.setattr(substring_dedup.shards, "__defaults__", (size,))
        got = substring_dedup.kept_words(docs).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == expected
    assert sum(x[1] for x in expected.values()) > 500
    assert substring_dedup.kept_words(empty(docs)).count() == 0


def test_decontamination(spark, docs, texts):
    items = [(1, texts[0]), (2, "word3 passage4 word4"), (3, None), (4, ""), (None, "two words"), (5, " ".join((texts[1] or "x").split()[:30])), (5, "tab and line")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    expected = {}
    for d, t in enumerate(texts):
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= {str(i) for i in ids if i is not None}
        expected[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.contamination(docs, benchmark).collect()
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in got} == expected
    in_slices = decontaminate.contaminated_spans(docs.select("doc_id", "text"), benchmark, most_bytes=300).collect()
    whole = decontaminate.contaminated_spans(docs.select("doc_id", "text"), benchmark).collect()
    key = lambda rows: sorted((r["doc_id"], r["starts"], r["ends"], r["items"]) for r in rows)
    assert key(in_slices) == key(whole)
    assert decontaminate.contamination(empty(docs), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.where("false")).where("contaminated").count() == 0
    cut = decontaminate.without_spans(docs, benchmark)
    assert cut.columns == docs.columns and decontaminate.contamination(cut, benchmark).where("n_hit > 0").count() <= 1


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    for n in (0, 1, 255, 256, 257, 4000):
        ids = rng.integers(0, 60_000, n).astype(np.uint32)
        ids[rng.random(n) < 0.02] = 2**32 - 1
        data = token_files.encode_file(ids, np.array([n]))
        assert (token_files.decode_file(data)[0] == ids).all()
        if n > 600:
            assert (token_files.decode_blocks(data, 1, 3) == ids[256:768]).all()
    model, at = Tokenizer.from_file(BPE), 0
    got = {r["doc_id"]: r for r in token_files.read_token_files(token_files.write_token_files(docs, BPE, 2, file_ids=500)).collect()}
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(empty(docs), BPE, 2)).count() == 0


def test_chat_format(spark):
    bad = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|turn|>", "[\\\\INST]", "<|\\", "plain", "", None]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(bad)] + [(2, None, None, "a", "x"), (2, 1, "<|text|>", "b", "x"), (2, 1, "<|text|>", "b", "x"), (None, 0, "user", "c", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat_format.format_conversations(frame)
    for r in made.collect():
        assert "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert chat_format.read_turns(r["formatted"]) == [(x[2] or "", x[3] or "") for x in own]
    loss = {r["conv_id"]: r["loss_sha256"] for r in chat_format.digests(made).collect()}
    assert loss[1] == hashlib.sha256("".join(t or "" for t in bad[1::2]).encode()).hexdigest()
    parts = [(1, 0, "user", [{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 56, "height": 29}, {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": None, "text": "<|image:0|>"}, None])]
    typed = spark.createDataFrame(parts, f"conv_id long, turn long, role string, content array<{chat_format.PART}>")
    row = chat_format.format_conversations(typed, "content").first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 1536)]
    assert "see <|image:0|><|audio:1|><|document:2|><\\|image:0|>" in row["formatted"]
    assert chat_format.digests(chat_format.format_conversations(frame.where("false"))).count() == 0


def test_fingerprints(spark, docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    order = list(range(len(texts)))[::-1]
    for k, i in enumerate(order):
        a, b = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        x, y, z = (fingerprints.sketches(text_of(pa.array([t])))[0] for t in (a, b, edited))
        assert got[i]["fingerprint"] == fingerprints.to_string(x) and fingerprints.from_string(fingerprints.to_string(x))[1].tolist() == x[1].tolist()
        assert got[i]["near_edited"] == fingerprints.likeness(x, z) and got[i]["near_next"] == fingerprints.likeness(x, y)
    one = fingerprints.edited_likeness(spark.createDataFrame([(4, "alone")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
    assert fingerprints.edited_likeness(empty(docs)).count() == 0
    rng = random.Random(1)
    a, b = "".join(rng.choices("abcdefgh ", k=40_000)), "".join(rng.choices("abcdefgh ", k=10_000))
    x, y, z = fingerprints.sketches(text_of(pa.array([a, b, a[:20_000] + b])))
    assert abs(fingerprints.containment(y, z) - 1) < 0.05 and abs(fingerprints.containment(z, x) - 2 / 3) < 0.08
    assert fingerprints.containment(x, fingerprints.merge(x, y)) == 1.0


def test_sentencepiece(spark, docs, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    got = {r["doc_id"]: r for r in sentencepiece_viterbi.round_trip(docs, PIECES).collect()}
    assert all(r["exact"] for r in got.values()) and got[0]["lang"] == "en"
    back = sentencepiece_viterbi.decode_ids(sentencepiece_viterbi.encode_ids(docs, PIECES), PIECES).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert sentencepiece_viterbi.round_trip(empty(docs), PIECES).count() == 0
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = ["hello", "segmentation", "über", "theorem", "antidisestablishment", "aaaaaaa", "Zug"]
    ids, counts = sentencepiece_viterbi.pieces(PIECES).encode(text_of(pa.array(words)))
    for word, own in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        total = lambda ids: sum(library.get_score(int(i)) for i in ids)
        assert total(own) == max(map(total, library.nbest_encode_as_ids(word, 20)))


def test_language_model(spark, docs, texts):
    rows = docs.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out"))
    counts, tokens = Counter(), {}
    for i, t in enumerate(texts):
        tokens[i] = [*SPACED.findall(lower(t)), None]
        if i % 7 != 2:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for exact in (1 << 20, 20):  # with 20, most tokens are looked up by a join
        model, rest = lm_score.train(rows.where("not held_out"), most_exact=exact)
        for r in lm_score.score(rows, model, rest).collect():
            own = tokens[r["doc_id"]]
            base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[x] > 0 for x in own), n)
            assert abs(r["base_score"] - base) < 1e-6 and r["score"] <= 0
    model, rest = lm_score.train(empty(rows))
    assert lm_score.score(rows, model, rest).where("n_known = 0").count() == len(texts)
    assert lm_score.score(empty(rows), model, rest).count() == 0


def test_bloom_counts():
    keys = lm_score.mix(np.arange(1, 3001, dtype=np.uint64))
    counts = np.arange(1, 3001)
    block, floor = lm_score._filled(keys, counts, 1 << 20)
    bloom = lm_score.BloomCounts(block[None, :], np.array([floor]))
    got = bloom.levels(keys)
    assert (got >= lm_score.level_of(counts)).all() and (got == lm_score.level_of(counts)).mean() > 0.97


def test_language_id(spark):
    rng = random.Random(4)
    words = {"xx": ["thali", "bolu", "karim", "sento"], "yy": ["zwick", "grü", "schtal", "pfun"]}
    rows = [(i, " ".join(rng.choices(words[("xx", "yy")[i % 2]], k=30)), ("xx", "yy")[i % 2]) for i in range(60)] + [(100, None, "xx"), (101, "12 34 !", None), (102, "bolu karim sento thali bolu " * 5 + "zwick schtal pfun grü " * 4, None), (103, "—", "yy")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in language_id.predict(frame, model).collect()}
    assert all(got[i]["lang_pred"] == ("xx", "yy")[i % 2] for i in range(60))
    assert [got[i]["lang_pred"] for i in (100, 101, 103)] == ["und"] * 3 and got[102]["languages"] == ["xx", "yy"]
    assert abs(got[102]["score"] - 25 / 45) < 0.12
    nothing = language_id.train(frame.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(frame, nothing).collect()} == {"und"}
    assert language_id.predict(frame.where("false"), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(400):
        own = rng.choices(vocabulary, k=60)
        if i % 4 == 0:
            own[rng.randrange(60)] = rng.choice(["vile", "rude"])
        rows.append((i, " ".join(own), "en", int(i % 4 == 0)))
    frame = spark.createDataFrame([*rows, (900, None, None, 0), (901, "", "de", 0)], "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(frame.where("doc_id % 5 <> 0"), frame.select("doc_id", "toxic"))
    got = toxicity.score(frame.drop("toxic"), model, lang="lang").join(frame.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r["doc_id"] % 5 == 0]
    assert sum((r["predicted"] == 1) == (r["toxic"] == 1) for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got) and "en" in model.thresholds
    nothing = toxicity.train(frame, frame.select("doc_id", "toxic").where("false"))
    assert toxicity.score(frame, nothing).count() == len(rows) + 2


def test_pipeline(spark, tmp_path, texts):
    """Each stage against brute force or its rule, and stages after stages."""
    import corpus_pipeline

    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join((texts[2] or "x").split()[:14]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        out[name] = docs
        assert docs.count() <= before.count()
        assert name == "token_ids" or docs.columns == before.columns
    stays = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in out["language"].collect()} == stays
    assert near_dedup.near_duplicates(out["near_copies"]).where("not kept").count() == 0
    assert decontaminate.contamination(out["benchmark_leaks"], spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where("contaminated").count() == 0
    assert out["token_ids"].where("not exact").count() == 0
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(out["token_ids"].collect())


def test_lm_score_keeps_every_count(spark, monkeypatch):
    """Short words, so more entries a byte than a filter sized by bytes can hold: scores follow the exact counts' levels."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789!$%&()*+-/:;<=>?[]^_{|}~", k=1200)) for _ in range(12)]
    texts += [" ".join(chr(0x4E00 + i) for i in range(600)), "rare one rare one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    single, pair, context = Counter(), Counter(), Counter()
    for t in texts:
        tokens = [*t.split(), "end"]
        single.update(tokens)
        pair.update(zip(["begin", *tokens], tokens))
        context.update(["begin", *tokens][:-1])
    typical = lambda n: lm_score.TYPICAL[lm_score.level_of(np.array([n]))[0]]
    level = lambda x: int(lm_score.level_of(np.array([single[x]]))[0])
    mass, n = Counter(), Counter()
    for (a, b), c in pair.items():
        mass[level(a)] += c / typical(c)
        n[level(a)] += c
    whole = sum(single.values()) + len(single) + 1

    def expected(t):
        total = 0
        for a, b in zip(["begin", *t.split()], [*t.split(), "end"]):
            alone = (typical(single[b]) + 1) / whole
            share = min(max((mass[level(a)] + 1) / (n[level(a)] + 1), 1e-3), 1)
            p = typical(pair[a, b])
            seen = min(max(p - 1, 0) / max(typical(single[a]), p, 1), 1)
            total += math.log10(min(seen, 1 - share) + share * alone if single[a] else alone)
        return total

    model, rest = lm_score.train(rows)
    for limit in (3 << 20, 3000):  # with 3000, texts go in several slices
        monkeypatch.setattr(lm_score, "SLICE_BYTES", limit, raising=False)
        for r in lm_score.score(rows, model, rest).collect():
            assert abs(r["score"] - expected(texts[r["doc_id"]])) < 0.02 * r["n_tokens"]
    # several hash ranges, and several cells for each
    monkeypatch.setattr(lm_score, "RANGE_TOKENS", 1000)
    model, rest = lm_score.train(rows)
    assert model.ranges > 1
    for r in lm_score.score(rows, model, rest).collect():
        assert abs(r["score"] - expected(texts[r["doc_id"]])) < 0.02 * r["n_tokens"]


def test_substring_dedup_deals_hot_anchors(spark, monkeypatch):
    """A common line in many contexts: no task gets a hot anchor's segments, and the result is brute force's."""
    rng = random.Random(12)
    line = [f"line{i}" for i in range(30)]
    shared = [[f"s{k}w{i}" for i in range(25)] for k in range(3)]
    texts = []
    for i in range(40):
        own = [f"d{i}x{rng.randrange(10**6)}" for _ in range(60)]
        texts.append(own[:20] + (shared[i % 3] if i % 4 else own[20:30]) + line + own[30:])
    first, expected = {}, {}
    for i, w in enumerate(texts):
        gone = set()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone.update(range(k, k + 50))
        expected[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    most, searched = 500, []
    search = substring_dedup.shard_repeats
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", most, raising=False)

    def counted(segments):
        searched.extend(r["n"] for r in segments.groupBy("anchor").agg((F.sum(F.length("words")) / 8).alias("n")).collect())
        return search(segments)

    monkeypatch.setattr(substring_dedup, "shard_repeats", counted)
    got = substring_dedup.kept_words(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == expected
    assert sum(x[1] for x in expected.values()) > 500
    assert 0 < max(searched) <= most
