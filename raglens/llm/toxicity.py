"""Toxicity by a convolutional text classifier in numpy.

Words are hashed to embeddings; filters of several widths slide over them, the
largest response of each filter over the whole text goes to a logistic output.
Training sees a bounded sample of labelled rows: backpropagation only follows
each filter's largest response. Embeddings start from the words' smoothed log
odds in the sample, beside small random numbers. Thresholds for flags are
calibrated by language after training; scores never see a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.shared import beside, schema_of
from raglens.llm.words import ALNUM, U64, mix, ragged, slices, words_of

BITS, DIM, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 8
PAD = 1 << BITS
#: The sample: whole texts, so many rows of each label at most, by the order of a hash; rows beyond the words
#: that a label has left stay out.
MOST_ROWS, SAMPLE_WORDS = 3000, 12_000_000
#: Words whose responses are held at once.
PIECE = 1 << 18
BINS = 1000
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 300, 128, 0.02


def buckets(words) -> tuple[np.ndarray, np.ndarray]:
    """Each word's embedding row, with padding after each text, and where each text starts."""
    counts, gap = words.counts, max(WIDTHS) - 1
    first = words.first + gap * np.arange(len(words.first))
    out = np.full(int(first[-1]), PAD, np.int64)
    out[ragged(first[:-1], counts)] = (mix(words.hashes) >> U64(64 - BITS)).astype(np.int64)
    return out, first


@dataclass
class Model:
    embeddings: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    output: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and filter the largest response (0 at least) and its place (-1: none), piece by piece."""
        gap, out = max(WIDTHS) - 1, []
        if first[-1] <= PIECE:
            return self._pooled(rows, first)
        i, n = 0, len(first) - 1
        while i < n:
            j = max(int(np.searchsorted(first, first[i] + PIECE, side="right")) - 1, i + 1)
            if first[j] - first[i] <= PIECE:
                value, place = self._pooled(rows[first[i] : first[j]], first[i : j + 1] - first[i])
                place[place >= 0] += first[i]
            else:  # one long text: windows that start in a piece read on into the next
                ends = int(first[j]) - gap
                value, place = np.zeros((1, len(WIDTHS) * FILTERS), np.float32), np.full((1, len(WIDTHS) * FILTERS), -1)
                for start in range(int(first[i]), ends, PIECE):
                    part = rows[start : min(start + PIECE, ends) + gap]
                    v, p = self._pooled(part, np.array([0, len(part)]))
                    better = v > value
                    value[better], place[better] = v[better], p[better] + start
            out.append((value, place))
            i = j
        return np.concatenate([v for v, _ in out]), np.concatenate([p for _, p in out])

    def _pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, gap = len(first) - 1, max(WIDTHS) - 1
        sizes = np.diff(first) - gap
        filled = np.flatnonzero(sizes > 0)
        value, place = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1)
        if len(filled) == 0:
            return value, place
        x = self.embeddings[rows]
        words = np.ones(len(rows), bool)
        words[ragged(first[1:] - gap, np.full(n, gap))] = False
        for k, (width, w, b) in enumerate(zip(WIDTHS, self.filters, self.bias, strict=True)):
            y = np.full((len(rows), FILTERS), -1e9, np.float32)
            m = len(rows) - width + 1
            y[:m] = b
            for j in range(width):
                y[:m] += x[j : j + m] @ w[j]
            y[~words] = -1e9
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best = np.maximum.reduceat(y, first[:-1][filled], axis=0)
            value[filled, cols] = np.maximum(best, 0)
            if self._training:
                for c in range(FILTERS):
                    hit = np.flatnonzero(y[:, c] == np.repeat(self._spread(best[:, c], filled, n), np.diff(first)))
                    owner = np.searchsorted(first, hit, side="right") - 1
                    owner, at = np.unique(owner, return_index=True)
                    place[owner, k * FILTERS + c] = hit[at]
        place[value <= 0] = -1
        return value, place

    _training = False

    @staticmethod
    def _spread(values: np.ndarray, filled: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, np.inf, np.float32)
        out[filled] = values
        return out

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        value, _ = self.pooled(rows, first)
        return 1 / (1 + np.exp(-(value.astype(float) @ self.output + self.offset)))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Trains on texts as arrays of embedding rows; with one label only, every score is that label's share."""
    rng = np.random.default_rng(seed)
    model = Model(
        np.zeros((PAD + 1, DIM), np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS),
        0.0,
    )
    n, positive = len(texts), int(labels.sum())
    if positive in (0, n):
        model.output[:] = 0
        model.offset = float(np.log((positive + 0.5) / (n - positive + 0.5)))
        return model
    present = [np.unique(t) for t in texts]
    with_, without = np.zeros(PAD), np.zeros(PAD)
    for t, y in zip(present, labels, strict=True):
        (with_ if y else without)[t] += 1
    odds = np.log((with_ + 0.5) / (positive + 1)) - np.log((without + 0.5) / (n - positive + 1))
    seen = with_ + without > 0
    model.embeddings[:PAD][seen] = rng.normal(0, 0.05, (int(seen.sum()), DIM))
    # a word of few documents says little: its odds shrink towards 0
    model.embeddings[:PAD, 0] = np.where(seen, np.clip(odds * (with_ + without) / (with_ + without + 12), -3, 3), 0)
    for w in model.filters:
        w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2]) + 0.5
    weight = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    step = [np.zeros_like(x) for x in (*model.filters, *model.bias, model.output)]
    model._training = True
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-n // BATCH)))  # a small sample is passed more often
    for epoch in range(epochs):
        rate = RATE / (1 + 3 * epoch / epochs)
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            _step(model, [texts[i] for i in order[a : a + BATCH]], labels[order[a : a + BATCH]], weight[order[a : a + BATCH]], rate, step)
    model._training = False
    return model


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gap = np.full(max(WIDTHS) - 1, PAD)
    first = np.concatenate(([0], np.cumsum([len(t) + len(gap) for t in texts])))
    return np.concatenate([x for t in texts for x in (t, gap)]), first


def _step(model: Model, texts, labels, weight, rate: float, step: list) -> None:
    """One AdaGrad step."""
    rows, first = _laid(texts)
    value, place = model.pooled(rows, first)
    score = 1 / (1 + np.exp(-(value.astype(float) @ model.output + model.offset)))
    error = (score - labels) * weight / len(texts)
    grads_w, grads_b = [np.zeros_like(w) for w in model.filters], [np.zeros_like(b) for b in model.bias]
    touched, changes = [], []
    for k, width in enumerate(WIDTHS):
        for c in range(FILTERS):
            at = place[:, k * FILTERS + c]
            on = np.flatnonzero(at >= 0)
            if len(on) == 0:
                continue
            g = (error[on] * model.output[k * FILTERS + c]).astype(np.float32)
            grads_b[k][c] = g.sum()
            for j in range(width):
                own = rows[at[on] + j]
                grads_w[k][j, :, c] = g @ model.embeddings[own]
                touched.append(own)
                changes.append(g[:, None] * model.filters[k][j, :, c])
    grads = [*grads_w, *grads_b, value.T @ error]
    for x, g, s in zip((*model.filters, *model.bias, model.output), grads, step, strict=True):
        s += g * g
        x -= rate * g / (np.sqrt(s) + 1e-6)
    model.offset -= rate * float(error.sum())
    if touched:
        np.add.at(model.embeddings, np.concatenate(touched), (-rate * np.concatenate(changes)).astype(np.float32))
        model.embeddings[PAD] = 0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str | None = "lang") -> Model:
    """Fits on at most MOST_ROWS rows of each label (1, 0), then, given a language column, calibrates thresholds by language
    on all labelled rows (flagged() does so from scores that are at hand).

    The sample's texts are whole; together they have SAMPLE_WORDS words of each label at most. A doc_id that `labels` holds twice is toxic if either says so; of a doc_id with several texts the one of the
    smallest hash is in the sample. A language without toxic rows has the threshold 0.5.
    """
    own = _labelled(labels)
    order = F.xxhash64("doc_id")
    chosen = own.where("toxic = 1").orderBy(order).limit(MOST_ROWS).union(own.where("toxic = 0").orderBy(order).limit(MOST_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch):
                ids, first = buckets(words_of(part, ALNUM, lower=True))
                data = pa.array([ids[a : b - max(WIDTHS) + 1].astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "toxic")), data], ["doc_id", "toxic", "ids"])

    texts = docs.select("doc_id", F.col(text).alias("text"))
    # two limits bound what is broadcast and collected
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    coded = rows.mapInArrow(run, "doc_id long, toxic int, ids binary")
    sample, left = [], {0: SAMPLE_WORDS, 1: SAMPLE_WORDS}
    for r in coded.orderBy(order, "toxic").toLocalIterator():
        if 4 * left[r["toxic"]] >= len(r["ids"]):
            left[r["toxic"]] -= len(r["ids"]) // 4
            sample.append((r["doc_id"], bytes(r["ids"]), r["toxic"]))
    if not sample:
        return fit([], np.zeros(0, np.int64))
    sample.sort(key=lambda r: r[:2])
    texts = [np.frombuffer(ids, "<i4") for _, ids, _ in sample]
    y = np.array([toxic for *_, toxic in sample])
    model = fit(texts, y)
    if lang:
        model.thresholds = thresholds(docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")), own, model)
    return model


def thresholds(docs: DataFrame, labels: DataFrame, model: Model) -> dict[str, float]:
    """For each language with toxic rows the threshold of the best F1 score, from all labelled rows in bins of their scores.

    docs: doc_id, text, lang; all are scored where they are, and only their bins meet the labels (doc_id, toxic).
    """
    return calibrated(score(docs.where("lang is not null"), model), labels)


def calibrated(scored: DataFrame, labels: DataFrame) -> dict[str, float]:
    """thresholds() from scores: doc_id, lang, score."""
    place = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    scored = scored.where("lang is not null").select("doc_id", "lang", place.alias("bin")).join(labels, "doc_id")
    scored = scored.groupBy("lang", "bin").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"))
    bins = scored.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("at"), "hits", "n"))).alias("bins"), F.sum("hits").alias("all")).where("all > 0")
    # a row a language, of at most BINS bins
    return {r["lang"]: best_threshold(np.array([tuple(b) for b in r["bins"]]), r["all"]) for r in bins.toLocalIterator()}


def flagged(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores (doc_id, lang, score, ...) with flagged: by the language's threshold, 0.5 where it has none.

    The scores are read twice, for the thresholds and for the flags: give a written table.
    """
    limits = calibrated(scored, _labelled(labels))
    known = scored.sparkSession.createDataFrame(list(limits.items()), "lang string, _limit double")  # a row a language
    return scored.join(F.broadcast(known), "lang", "left").withColumn("flagged", F.col("score") >= F.coalesce("_limit", F.lit(0.5))).select(*scored.columns, "flagged")


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def best_threshold(bins: np.ndarray, hits: int) -> float:
    """bins: (minus the bin, toxic rows, all rows), from the highest score on; midway to the next lower bin."""
    f1 = 2 * np.cumsum(bins[:, 1]) / (np.cumsum(bins[:, 2]) + hits)
    k = int(np.argmax(f1))
    low = 1 - bins[k + 1, 0] if k + 1 < len(bins) else 0
    return float((low - bins[k, 0]) / 2 / BINS)


def score(docs: DataFrame, model: Model, text: str = "text", lang: str | None = None) -> DataFrame:
    """docs with score, predicted (score >= 0.5) and, given a language column, flagged (by its threshold, else 0.5).

    Null and empty texts get the output's offset alone, like texts without words. Each row is scored by its
    own text. Input columns named like an output give way to it.
    """
    names, sent = beside(docs, ["score", "predicted", "flagged"]), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for rows, part in slices(batch, text, 1 << 20):
                value = model.scores(*buckets(words_of(part, ALNUM, lower=True)))
                limit = [model.thresholds.get(x, 0.5) for x in rows.column(lang).to_pylist()] if lang else 0.5
                made = [pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array((value >= limit).astype(bool))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *made], [*names, "score", "predicted", "flagged"])

    return docs.mapInArrow(run, schema_of(docs, names, "score double, predicted int, flagged boolean"))
