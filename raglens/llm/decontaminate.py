"""Benchmark decontamination by an FM-index over each shard of the training documents.

A shard is what a task reads, up to SHARD_BYTES of it. All its words, as ids of
its own vocabulary, are indexed, one sequence a document. The test phrases are
searched backwards together through wavelet-matrix ranks; those that share a
suffix interval are the same phrase, located once by sampled suffix positions,
and the spans of all are merged for each document. Words are compared as 64-bit
hashes.

The test items go to the workers as word hashes, in slices of about `most_bytes`
of their text; the driver holds one slice at a time. A benchmark of several
slices is searched slice by slice and the spans merged after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.fm_index import FMIndex
from raglens.llm.shared import beside, column, free_name, schema_of, scratch, written
from raglens.llm.words import ALNUM, LEAN_SLICE_BYTES, U64, ragged, slices, text_of, tidy, words_of

WINDOW = 10
MOST_BYTES = 16 << 20
#: Text of one shard, about; a longer document makes one alone.
SHARD_BYTES = 16 << 20


@dataclass
class Phrases:
    """The windows of some items: the items' word hashes laid end to end, each window's first word, length and item."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    items: list[str | None]

    @classmethod
    def of(cls, items: pa.Table, window: int = WINDOW) -> Phrases:
        words = words_of(text_of(items.column("text")), ALNUM, lower=True)
        counts = words.counts
        n = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(n)), n)
        return cls(words.hashes, ragged(words.first[:-1], n), np.minimum(counts, window)[item], item, items.column("item_id").to_pylist())

    def known(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items' words as symbols 1, 2, .. of a vocabulary, and the windows of which it has every word."""
        if len(vocabulary) == 0 or len(self.hashes) == 0:
            return np.zeros(len(self.hashes), np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(vocabulary, self.hashes), len(vocabulary) - 1)
        there = vocabulary[at] == self.hashes
        missing = np.concatenate(([0], np.cumsum(~there)))
        return at + 1, np.flatnonzero(missing[self.starts + self.lengths] == missing[self.starts])


@dataclass
class Hits:
    """What a shard's documents hold: merged spans (row, first word, end) and distinct (row, item), each in order of rows."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    with_item: np.ndarray
    item: np.ndarray


def hits(phrases: Phrases, hashes: np.ndarray, first: np.ndarray) -> Hits:
    """All occurrences of the windows in a shard whose documents' words start at `first` (one more at the end)."""
    none = np.zeros(0, np.int64)
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    pattern, windows = phrases.known(vocabulary)
    if len(windows) == 0:
        return Hits(none, none, none, none, none)
    index = FMIndex(symbols + 1, first[:-1], len(vocabulary) + 1)
    lo, hi = index.search(pattern, phrases.starts[windows], phrases.lengths[windows])
    found = np.flatnonzero(lo < hi)
    lo, hi, windows = lo[found], hi[found], windows[found]
    # equal windows, and only those, share interval and length
    _, one, which = np.unique(lo * (WINDOW + 1) + phrases.lengths[windows], return_index=True, return_inverse=True)
    many = hi[one] - lo[one]
    phrase, place = np.repeat(np.arange(len(one)), many), index.locate(ragged(lo[one], many))
    # in the index each document ends with a terminator, so that no two spans of different documents touch
    cover = np.bincount(place, minlength=index.n + 1) - np.bincount(place + phrases.lengths[windows[one]][phrase], minlength=index.n + 1)
    edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(index.first, start, side="right") - 1
    holder = np.searchsorted(index.first, place, side="right") - 1
    with_item, item = _items(holder, phrase, which, phrases.item_of[windows])
    return Hits(row, start - index.first[row], end - index.first[row], with_item, item)


def _items(row: np.ndarray, phrase: np.ndarray, which: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, item) of rows with phrases; item[k] has the phrase which[k]. Phrases of the same items count as one."""
    if len(row) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = _distinct(which, item)
    cuts = np.searchsorted(pairs[0], np.arange(int(which.max()) + 2))
    sets: dict[bytes, int] = {}
    held, of = [], np.zeros(len(cuts) - 1, np.int64)
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        of[k] = sets.setdefault(pairs[1][a:b].tobytes(), len(sets))
        if of[k] == len(held):
            held.append((a, b - a))
    at = np.array(held, np.int64)
    row, kind = _distinct(row, of[phrase])
    return _distinct(np.repeat(row, at[kind, 1]), pairs[1][ragged(at[kind, 0], at[kind, 1])])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two columns of small numbers, in order."""
    most = int(b.max(initial=0)) + 1
    key = np.unique(a * most + b)
    return key // most, key % most


class Shard:
    """A task's documents until they are searched together."""

    def __init__(self, phrases: Phrases, names: list[str]):
        self.phrases, self.names = phrases, names
        self._empty()

    def _empty(self) -> None:
        self.rows, self.counts, self.hashes, self.size = [], [], [], 0

    def add(self, rows: pa.RecordBatch, part) -> None:
        words = words_of(part, ALNUM, lower=True)
        self.hashes.append(words.hashes)
        self.rows.append(rows)
        self.counts.append(words.counts)
        self.size += len(part.data)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The documents with n_words, starts, ends and items."""
        if not self.rows:
            return
        first = np.concatenate(([0], np.cumsum(np.concatenate(self.counts))))
        hashes, self.hashes = np.concatenate(self.hashes), []
        found = hits(self.phrases, hashes, first)
        titles = np.array([*self.phrases.items, None], object)
        begin = 0
        for rows, counts in zip(self.rows, self.counts, strict=True):
            n = begin + np.arange(len(counts) + 1)
            at, own = np.searchsorted(found.row, n).astype(np.int32), np.searchsorted(found.with_item, n).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at - at[0], pa.array(x[at[0] : at[-1]].astype(np.int32))) for x in (found.start, found.end)]
            named = pa.ListArray.from_arrays(own - own[0], pa.array(titles[found.item[own[0] : own[-1]]].tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in self.names), pa.array(counts), *lists, named], [*self.names, "n_words", "starts", "ends", "items"])
            begin += len(counts)
        self._empty()


FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def find_spans(docs: DataFrame, phrases: Phrases, text: str = "text") -> DataFrame:
    """The documents with n_words, the merged spans' first words and ends, and the items found, as they stand."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    names = beside(docs, ["n_words", "starts", "ends", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(sent.value, names)
        for batch in batches:
            for rows, part in slices(batch, text, LEAN_SLICE_BYTES):
                shard.add(rows, part)
                if shard.size >= SHARD_BYTES:
                    yield from shard.close()
        yield from shard.close()

    return docs.mapInArrow(tidy(run), schema_of(docs, names, FOUND))


def phrase_slices(benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[int, Iterator[Phrases]]:
    """The number of slices of about most_bytes of text at most, and the windows of each, fetched when it is its turn."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * total // most_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, (Phrases.of((items.where(part == k) if n > 1 else items).toArrow()) for k in range(n))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with n_words, starts, ends (merged spans, in words) and items (sorted ids of items with occurring windows).

    A window is WINDOW words in a row of an item, or all words of a shorter one; null and empty texts
    have no words. Items without an id count for spans, not among the items. Rows that are repeated,
    or share an id, each get their own result. Input columns named like an output give way to it.
    """
    n, parts = phrase_slices(benchmark, most_bytes)
    if n == 1:
        return find_spans(docs, next(parts), text).withColumn("items", _ids(F.col("items")))
    docs = docs.select(*map(column, beside(docs, ["n_words", "starts", "ends", "items"])))
    row = free_name(docs, "_row")
    with scratch() as keep:
        marked = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        found = None
        for part in parts:
            own = written(find_spans(marked.select(column(row).alias("_row"), column(text).alias("text")), part).drop("text"), "spans")
            found = own if found is None else found.unionByName(own)
        kept = keep(written(_merged(found), "merged-spans"))
        keep(marked)
    return marked.join(kept.withColumnRenamed("_row", row), row).drop(row)


def _merged(found: DataFrame) -> DataFrame:
    """_row, n_words, starts, ends, items of the spans that several slices found."""
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("s"), x["ends"].alias("e")))
    kept = found.select("_row", "n_words", spans.alias("spans"), "items").groupBy("_row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    empty = F.lit(None).cast("array<struct<s:int,e:int>>")

    def join(done, x):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(done) == 0, F.array(x)).when(x["s"] <= last["e"], grown).otherwise(F.concat(done, F.array(x)))

    runs = F.aggregate("spans", F.coalesce(empty, F.array().cast("array<struct<s:int,e:int>>")), join)
    kept = kept.select("_row", "n_words", runs.alias("runs"), "items")
    return kept.select("_row", "n_words", F.col("runs.s").alias("starts"), F.col("runs.e").alias("ends"), _ids(F.col("items")).alias("items"))


def _ids(items):
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (ids joined by commas), contaminated."""
    found = contaminated_spans(docs.select("doc_id", text), benchmark, text)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans cut from the text; a document that had only such words is left out."""
    rest = [c for c in docs.columns if c != text]
    packed = docs.select(column(text).alias("text"), F.struct(F.lit(0).alias("_"), *[column(c).alias(f"c{k}") for k, c in enumerate(rest)]).alias("rest"))
    found = contaminated_spans(packed, benchmark)
    names = ["text", "rest"]

    def run(batches):
        for batch in batches:
            for rows, part in slices(batch, "text", LEAN_SLICE_BYTES):
                hit = np.flatnonzero(rows.column("starts").value_lengths().to_numpy(zero_copy_only=False))
                words = words_of(part, ALNUM, lower=True) if len(hit) else None
                texts, keep = rows.column("text"), np.ones(len(part), bool)
                if len(hit):
                    texts = texts.to_pylist()
                    for k in hit.tolist():
                        own = slice(words.first[k], words.first[k + 1])
                        a, b = words.starts[own] - part.offsets[k], words.ends[own] - part.offsets[k]
                        raw, done, out, left = part.bytes_of(k), 0, [], len(a)
                        for s, e in zip(rows.column("starts")[k].as_py(), rows.column("ends")[k].as_py(), strict=True):
                            out.append(raw[done : a[s]])
                            done, left = b[e - 1], left - (e - s)
                        texts[k] = b"".join([*out, raw[done:]]).decode()
                        keep[k] = left > 0
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([texts.cast(pa.string()), rows.column("rest")], names).filter(pa.array(keep))

    cut = found.mapInArrow(tidy(run), packed.schema)
    own = {c: f"c{k}" for k, c in enumerate(rest)}
    return cut.select(*[F.col("text").alias(c) if c == text else F.col("rest").getField(own[c]).alias(c) for c in docs.columns])
