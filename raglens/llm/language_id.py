"""Language identification by mixture inference.

Each language has a distribution over hashed byte trigrams, counted over all
training documents. A word's likelihood under a language is its trigrams'; a
document is a mixture of languages over its words, whose proportions
expectation-maximisation estimates. Of the nested sets of the likeliest
languages the one with the best penalised likelihood is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.shared import beside, schema_of
from raglens.llm.words import LEAN_SLICE_BYTES, LOWER, Text, ragged, slices, tidy, words_of

BUCKETS = 1 << 15
TURNS = 6
#: A language more must raise the log-likelihood by this, plus as much again for each e-fold of words.
PENALTY = 3.0
UNKNOWN = "und"
#: Up to so many languages the model is a full table of buckets x languages; with more it holds only what was seen.
TABLE_LANGUAGES = 256
#: Words times languages that are held at once; beyond it slices get shorter, to a text at least.
MOST_CELLS = 1 << 24

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_FOLD = np.where(_LETTER, LOWER, 0x20).astype(np.uint8)


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around each byte; what is no letter counts as a space."""
    b = np.full(len(data) + 2, 0x20, np.uint32)
    b[1:-1] = _FOLD[data]
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)


def train(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts the trigrams of all rows with a language; any number of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for own, part in slices(batch, text):
                codes = own.column("lang").dictionary_encode()
                names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
                letter = _LETTER[part.data]
                # a row's first and last bytes see its neighbours' here: put a space between rows
                bucket = _bucket_rows(part)[letter]
                of = np.repeat(codes, np.diff(part.offsets))[letter]
                found = np.bincount(of.astype(np.int64) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    counts[name] = counts.get(name, 0) + found[k]
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    text = "text"
    total = known.mapInArrow(tidy(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r["lang"] for r in total.select("lang").distinct().toLocalIterator())
    found = total.toArrow()  # BUCKETS rows a language at most
    at = pc.index_in(found.column("lang").combine_chunks(), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    return Model.of(names, found.column("bucket").to_numpy(), at, found.column("n").to_numpy())


def _bucket_rows(part: Text) -> np.ndarray:
    bucket = trigrams(part.data)
    data, n = part.data, len(part.data)
    bounds = part.offsets[1:-1]
    for shift in (-1, 0):  # the bytes on both sides of a bound
        at = bounds + shift
        at = at[(at >= 0) & (at < n)]
        if len(at):
            starts = np.isin(at, part.offsets, assume_unique=False)
            ends = np.isin(at + 1, part.offsets)
            left = np.where(starts | (at == 0), 0x20, _FOLD[data[at - 1]]).astype(np.uint32)
            right = np.where(ends, 0x20, _FOLD[data[np.minimum(at + 1, n - 1)]]).astype(np.uint32)
            bucket[at] = ((left << np.uint32(16) | _FOLD[data[at]].astype(np.uint32) << np.uint32(8) | right) * np.uint32(0x9E3779B1)) >> np.uint32(17)
    return bucket


@dataclass
class Model:
    """Languages in order, and the log-probability of each bucket under each of them.

    With more than TABLE_LANGUAGES, log_p holds what a bucket not seen has, and `seen` what the others have beyond
    that: where each bucket starts, then the language and value of each entry.
    """

    names: list[str]
    log_p: np.ndarray
    seen: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, names: list[str], bucket: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Model:
        total = np.bincount(lang, weights=n, minlength=len(names)) + 0.5 * BUCKETS
        if len(names) <= TABLE_LANGUAGES:
            table = np.zeros((BUCKETS, len(names)))
            table[bucket, lang] = n
            return cls(names, np.log((table + 0.5) / total).astype(np.float32))
        order = np.lexsort((lang, bucket))
        value = np.log((n + 0.5) / 0.5).astype(np.float32)
        starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        return cls(names, np.log(0.5 / total).astype(np.float32), (starts, lang[order].astype(np.int32), value[order]))

    def summed(self, buckets: np.ndarray, at: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """The log-probabilities of runs of buckets that start at `at`; of those not `counted` nothing."""
        if self.seen is None:
            values = self.log_p[buckets]
            values[~counted] = 0
            return np.add.reduceat(values, at, axis=0)
        starts, lang, value = self.seen
        run = np.repeat(np.arange(len(at)), np.diff(at, append=len(buckets)))[counted]
        own = buckets[counted]
        sizes = starts[own + 1] - starts[own]
        entries = ragged(starts[own], sizes)
        k = len(self.names)
        out = np.bincount(np.repeat(run, sizes) * k + lang[entries], weights=value[entries], minlength=len(at) * k).reshape(len(at), k)
        return (out + np.bincount(run, minlength=len(at))[:, None] * self.log_p).astype(np.float32)

    def word_likelihoods(self, part: Text) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word under each language, and each row's first word (one more at the end)."""
        words = words_of(part, _LETTER)
        if len(words.starts) == 0:
            return np.zeros((0, len(self.names)), np.float32), words.first
        _, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        size = words.ends[first] - words.starts[first]
        # different words, a space after each
        spaced = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        at = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        spaced[ragged(at, size)] = part.data[ragged(words.starts[first], size)]
        counted = np.ones(len(spaced), bool)
        counted[at + size] = False
        return self.summed(trigrams(spaced).astype(np.int64), at, counted)[which.reshape(-1)], words.first

    def infer(self, part: Text) -> tuple[np.ndarray, np.ndarray]:
        """Each row's language proportions in its selected set, and its number of words."""
        words, first = self.word_likelihoods(part)
        counts, k = np.diff(first), len(self.names)
        share = np.zeros((len(counts), k))
        rows = np.flatnonzero(counts > 0)
        if len(rows) == 0 or k == 0:
            return share, counts
        top = words.max(1, keepdims=True)
        p = np.exp(words - top)
        begin, n = first[:-1][rows], counts[rows]
        alone = np.add.reduceat(words - top, begin, axis=0).astype(float)
        full, best = expectation_maximisation(p, n, np.full((len(rows), k), 1 / k))
        order = np.argsort(-full, axis=1, kind="stable")
        single = np.argmax(alone, axis=1)
        chosen = np.zeros((len(rows), k))
        chosen[np.arange(len(rows)), single] = 1
        value = alone[np.arange(len(rows)), single]
        penalty = PENALTY * (1 + np.log(n))
        mixed = np.flatnonzero(best - value > penalty)
        for size in range(2, k + 1):
            if len(mixed) == 0:
                break
            at = ragged(begin[mixed], n[mixed])
            start = np.zeros((len(mixed), k))
            np.put_along_axis(start, order[mixed, :size], 1 / size, axis=1)
            found, likelihood = expectation_maximisation(p[at], n[mixed], start)
            better = likelihood - penalty[mixed] * (size - 1) > value[mixed]
            value[mixed[better]] = (likelihood - penalty[mixed] * (size - 1))[better]
            chosen[mixed[better]] = found[better]
        share[rows] = chosen
        return share, counts


def expectation_maximisation(p: np.ndarray, counts: np.ndarray, share: np.ndarray, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some turns from `share`, and the log-likelihood under them; languages that start at 0 stay out."""
    begin = np.cumsum(counts) - counts
    for _ in range(turns):
        joint = p * np.repeat(share.astype(np.float32), counts, axis=0)
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(joint, begin, axis=0) / counts[:, None]
    mixed = np.maximum((p * np.repeat(share.astype(np.float32), counts, axis=0)).sum(1), 1e-30)
    return share, np.add.reduceat(np.log(mixed).astype(float), begin)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (its proportion) and languages (the selected set, by proportion).

    A null text, or one without any letter, is UNKNOWN with score 0; so is all where nothing was learned.
    Each row is judged by its own text. Of equal proportions the first language in order wins. Input columns
    named like an output give way to it.
    """
    names, sent = beside(docs, ["lang_pred", "score", "languages"]), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for rows, part in slices(batch, text, min(LEAN_SLICE_BYTES, 2 * MOST_CELLS // max(len(model.names), 1))):
                share, counts = model.infer(part)
                best = share.argmax(1) if len(model.names) else np.zeros(len(counts), np.int64)
                lettered = counts > 0
                plain = np.concatenate(([0], np.cumsum(_LETTER[part.data] & (part.data < 0x80))))
                for k in np.flatnonzero(lettered & (np.diff(plain[part.offsets]) == 0)):
                    lettered[k] = any(c.isalpha() for c in part.bytes_of(k).decode())
                known = lettered & bool(model.names)
                preds = [model.names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
                score = np.where(known, share.max(1, initial=0), 0.0)
                sets = [[model.names[j] for j in np.argsort(-s, kind="stable") if s[j] > 0] if ok else [] for s, ok in zip(share, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(preds, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.list_(pa.string()))], [*names, "lang_pred", "score", "languages"])

    return docs.mapInArrow(tidy(run), schema_of(docs, names, "lang_pred string, score double, languages array<string>"))
