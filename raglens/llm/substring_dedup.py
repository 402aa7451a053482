"""Substring dedup by FM-indexes over shards of shared passages.

Each document's windows of 50 words are dealt to anchors: the smallest hash of
8 words in a row inside the window. Equal windows have equal anchors, so what an
anchor's windows span (its segment) meets all its possible repeats at one key.
Segments that are word for word equal count once; an anchor with one distinct
segment needs no search. The others go to shards, whole anchors to each; a
shard's segments become one compressed FM-index, and every segment is streamed
through it by backward search: matching statistics cut at 50 words give, for
each window, the smallest document that holds it. Anchors with many words, such
as those of a common line, would make one task of each: their segments get new
anchors, the smallest hash of 28 words in a row, which what stands around the
line tells apart. What is still large after that shares most of its words: its
windows are dealt one by one, by a hash of their 50 words, and meet in groups of
equal windows.

A document is a row: rows are told apart by doc_id and a hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.fm_index import FMIndex
from raglens.llm.near_dedup import whole_groups
from raglens.llm.shared import beside, column, free_name, schema_of, scratch, version, written
from raglens.llm.words import LEAN_SLICE_BYTES, SPACED, U64, grams, mix, powers, ragged, slices, tidy, words_of

WINDOW = 50
#: Words of an anchor, and of the new ones within large anchors.
GRAM, WIDE_GRAM = 8, 28
SHARD_WORDS = 1 << 19
#: An anchor whose distinct segments have more words is dealt anew.
HOT_WORDS = 1 << 14
_Q = 0xF1357AEA2E62A9C5


def anchors(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """row, anchor hash, segment hash, first window, windows: a row for each run of windows with one anchor."""
    counts = np.diff(first)
    n = np.maximum(counts - window + 1, 0)
    if n.sum() == 0:
        none = np.zeros(0, np.int64)
        return none, none.view(U64), none.view(U64), none, none
    best = grams(hashes, gram)
    place = np.arange(len(best))
    wide, need = 1, window - gram + 1
    while wide < need:
        shift = min(wide, need - wide)
        later = best[shift:]
        left = best[: len(later)] <= later
        place = np.where(left, place[: len(later)], place[shift:])
        best = np.where(left, best[: len(later)], later)
        wide += shift
    start = ragged(first[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    at = place[start]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])))
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(at)))
    begin = start[run]
    end = begin + size + window - 1
    total = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * powers(_Q, len(hashes)), dtype=U64)))
    back = powers(pow(_Q, -1, 2**64), len(hashes))
    segment = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(U64))
    return row[run], best[begin], segment, begin - first[row[run]], size


def anchor_table(docs: DataFrame) -> DataFrame:
    """doc_id, version, anchor, segment, start (first window), windows. docs: doc_id, version, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch, "text", LEAN_SLICE_BYTES):
                words = words_of(part)
                row, anchor, segment, start, size = anchors(words.hashes, words.first)
                yield _anchored(rows.column("doc_id").take(pa.array(row)), rows.column("version").take(pa.array(row)), anchor, segment, start, size)

    return docs.mapInArrow(tidy(run), ANCHORED)


ANCHORED = "doc_id long, version long, anchor long, segment long, start int, windows int"


def _anchored(doc, versions, anchor, segment, start, size) -> pa.RecordBatch:
    made = [pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))]
    return pa.RecordBatch.from_arrays([doc, versions, *made], ["doc_id", "version", "anchor", "segment", "start", "windows"])


def segment_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, doc_id, version, start and the hashes of the segment's words, for wanted segments of docs."""

    def run(batches):
        for batch in batches:
            for rows, part in slices(batch, "text", LEAN_SLICE_BYTES):
                words = words_of(part)
                lists = rows.column("parts")
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                anchor, start, size = (flat.field(k) for k in range(3))
                begin = words.first[owner] + start.to_numpy()
                yield _segments([anchor, *(rows.column(c).take(pa.array(owner)) for c in ("doc_id", "version")), start], words.hashes, begin, size.to_numpy())

    parts = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("parts"))
    return docs.join(parts, ["doc_id", "version"]).mapInArrow(tidy(run), SEGMENTS)


SEGMENTS = "anchor long, doc_id long, version long, start int, words binary"


def _segments(columns: list, hashes: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    length = windows.astype(np.int64) + WINDOW - 1
    bounds = np.concatenate(([0], 8 * np.cumsum(length))).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(hashes[ragged(begin, length)].tobytes())])
    return pa.RecordBatch.from_arrays([*columns, data], ["anchor", "doc_id", "version", "start", "words"])


def _words(batch) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a batch's segments end to end, and where each segment starts (one more at the end)."""
    raw = batch.column("words")
    raw = (raw.combine_chunks() if isinstance(raw, pa.ChunkedArray) else raw).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 8
    return np.frombuffer(raw.buffers()[2], U64) if raw.buffers()[2] is not None else np.zeros(0, U64), offsets


def wide_anchors(segments: DataFrame) -> DataFrame:
    """What anchor_table gives, within segments, for anchors of WIDE_GRAM words; `words` beside it."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                words, offsets = _words(batch)
                words, offsets = words[offsets[0] : offsets[-1]], offsets - offsets[0]
                row, anchor, segment, start, size = anchors(words, offsets, gram=WIDE_GRAM)
                # the old anchor is part of the new one: segments of different anchors need not meet
                anchor = mix(anchor ^ batch.column("anchor").to_numpy().view(U64)[row])
                at, owner = start + batch.column("start").to_numpy()[row], pa.array(row)
                made = _segments([pa.array(anchor.view(np.int64)), batch.column("doc_id").take(owner), batch.column("version").take(owner), pa.array(at.astype(np.int32))], words, offsets[row] + start, size)
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array(segment.view(np.int64)), pa.array(size.astype(np.int32))], [*made.schema.names, "segment", "windows"])

    return segments.mapInArrow(tidy(run), f"{SEGMENTS}, segment long, windows int")


def shard_repeats(segments: DataFrame) -> DataFrame:
    """doc_id, version, first, last: runs of windows of a segment that a smaller document of its anchor holds too."""
    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", "doc_id")

    def run(batches):
        for shard in shards(whole_groups(batches, ["anchor"])):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard_runs(*shard)], ["doc_id", "version", "first", "last"])

    return dealt.mapInArrow(tidy(run), RUNS)


RUNS = "doc_id long, version long, first int, last int"


def shards(tables, most: int = SHARD_WORDS) -> Iterator[tuple]:
    """(words, first, doc_id, version, start) in shards of whole anchors, of at most `most` words or one anchor."""
    for table in tables:
        anchor, *columns = (table.column(c).to_numpy() for c in ("anchor", "doc_id", "version", "start"))
        words, offsets = _words(table)
        groups = np.append(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), len(anchor))
        at = 0
        while at < len(groups) - 1:
            end = max(at + 1, int(np.searchsorted(offsets[groups], offsets[groups[at]] + most, side="right")) - 1)
            a, b = groups[at], groups[end]
            yield words[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], *(c[a:b] for c in columns)
            at = end


def shard_runs(words: np.ndarray, first: np.ndarray, doc: np.ndarray, versions: np.ndarray, start: np.ndarray, window: int = WINDOW):
    """The runs of windows, of all segments of one shard, that a smaller document's segment holds."""
    vocabulary, symbols = np.unique(words, return_inverse=True)
    symbols += 1
    index = FMIndex(symbols, first, len(vocabulary) + 1, sample=0, window=window, owner=doc)
    least = index.repeated(symbols, first)
    owner = np.repeat(np.arange(len(doc)), np.diff(np.append(first, len(words))))
    place = np.flatnonzero(least < doc[owner])
    owner = owner[place]
    new = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])))[: len(place)]
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(place)))
    owner, place = owner[run], place[run]
    at = (start[owner] + place - first[owner]).astype(np.int32)
    return doc[owner], versions[owner], at, (at + size - 1).astype(np.int32)


def window_table(segments: DataFrame) -> DataFrame:
    """anchor, window (a hash of its words), doc_id, version, first: all windows of the segments."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, offsets = _words(batch)
            n = np.diff(offsets) - WINDOW + 1
            owner = np.repeat(np.arange(len(n)), n)
            window = grams(words, WINDOW)[ragged(offsets[:-1], n)]
            first = (batch.column("start").to_numpy()[owner] + ragged(np.zeros(len(n), np.int64), n)).astype(np.int32)
            anchor, doc, versions = (batch.column(c).take(pa.array(owner)) for c in ("anchor", "doc_id", "version"))
            yield pa.RecordBatch.from_arrays([anchor, pa.array(window.view(np.int64)), doc, versions, pa.array(first)], ["anchor", "window", "doc_id", "version", "first"])

    return segments.mapInArrow(tidy(run), "anchor long, window long, doc_id long, version long, first int")


def hot_repeats(segments: DataFrame) -> DataFrame:
    """What shard_repeats finds, window by window."""
    windows = written(window_table(segments), "hot-windows")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_owner")).where("owner < last_owner")
    found = windows.join(least.select("anchor", "window", "owner"), ["anchor", "window"]).where("doc_id > owner")
    return found.select("doc_id", "version", "first", F.col("first").alias("last"))


def open_segments(table: DataFrame) -> DataFrame:
    """Rows of the table whose segment needs more: other documents have it, or its anchor has other segments.

    Beside them `owner`, the segment's smallest document, and `searched`: the anchor has several segments and documents.
    """
    kinds = written(table.groupBy("anchor", "segment").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last_owner")), "segments")
    several = kinds.groupBy("anchor").agg(F.min("owner").alias("x"), F.max("last_owner").alias("y"), F.max("owner").alias("z"))
    several = several.where("x <> y").select("anchor", (F.col("x") < F.col("z")).alias("searched"))
    open_ = kinds.join(several, "anchor").where("searched or owner <> last_owner").select("anchor", "segment", "owner", "searched")
    return written(table.join(open_, ["anchor", "segment"]), "open-segments")


def copied_runs(seen: DataFrame) -> DataFrame:
    """All windows of segments that a smaller document has word for word."""
    return seen.where("doc_id > owner").select("doc_id", "version", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last"))


def large_anchors(own: DataFrame) -> DataFrame:
    return own.groupBy("anchor").agg(F.sum(F.col("windows") + WINDOW - 1).alias("words")).where(F.col("words") > HOT_WORDS).select("anchor")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, version, first, last: runs of windows that also start in a document with a smaller doc_id.

    docs: doc_id, version, text.
    """
    table = written(anchor_table(docs.where("doc_id is not null")), "anchors")
    seen = open_segments(table)
    key = ["doc_id", "version"]
    own = seen.where("doc_id = owner and searched").groupBy("anchor", "segment", *key).agg(F.min(F.struct("start", "windows")).alias("at"), F.collect_list("start").alias("places"))
    own = written(own.select("anchor", *key, "at.start", "at.windows", "places"), "searched-segments")
    again = docs.groupBy(*key).count().where("count > 1").isEmpty()
    words = segment_words(docs if again else docs.dropDuplicates(key), own)
    hot = written(large_anchors(own), "hot-anchors")
    if hot.isEmpty():
        found = shard_repeats(words)
    else:
        words = written(words, "segment-words")
        found = shard_repeats(words.join(hot, "anchor", "left_anti"))
        wide = open_segments(written(wide_anchors(words.join(hot, "anchor", "left_semi")), "wide-anchors"))
        left = wide.where("doc_id = owner and searched").dropDuplicates(["anchor", "segment", *key, "start"])
        still = written(large_anchors(left), "still-hot-anchors")
        left = left.select("anchor", *key, "start", "words")
        found = found.union(copied_runs(wide)).union(shard_repeats(left.join(still, "anchor", "left_anti"))).union(hot_repeats(left.join(still, "anchor", "left_semi")))
    found = written(found, "found-runs")
    # a segment that its document holds at several places was searched at one of them
    moved_from = own.where("size(places) > 1").select(*key, F.col("start").alias("at"), (F.col("start") + F.col("windows") - 1).alias("to"), F.explode("places").alias("place"))
    moved = found.join(moved_from, key).where("first >= at and last <= to and place <> at")
    moved = moved.select(*key, (F.col("first") + F.col("place") - F.col("at")).alias("first"), (F.col("last") + F.col("place") - F.col("at")).alias("last"))
    return copied_runs(seen).union(found).union(moved)


MADE = ["n_words", "n_removed", "kept"]


def kept_words(docs: DataFrame, text: str = "text", digest: bool = True) -> DataFrame:
    """docs with n_words, n_removed and kept: the kept words joined by a space (its SHA-256 if digest).

    A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. Null and empty texts have no words. Rows with one doc_id, of equal
    or different texts, take nothing from each other; each gets its own result. Rows without doc_id keep
    all and take nothing from others. Words are compared as 64-bit hashes. Input columns named like an
    output give way to it.
    """
    names, at, list_ = beside(docs, MADE), free_name(docs, "_version"), free_name(docs, "_runs")
    with scratch() as keep:
        runs = repeated_windows(docs.select("doc_id", version(text).alias("version"), column(text).alias("text")))
        runs = keep(written(runs.groupBy("doc_id", "version").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs"))
    runs = runs.toDF("doc_id", at, list_)
    joined = docs.withColumn(at, version(text)).join(runs, ["doc_id", at], "left").select(*map(column, [*names, *([text] if text not in names else []), list_]))

    def run(batches):
        for batch in batches:
            for rows, part in slices(batch, text, LEAN_SLICE_BYTES):
                words = words_of(part)
                lists = rows.column(list_).fill_null([])
                owner = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                begin, last = (flat.field(k).to_numpy() + words.first[owner] for k in range(2))
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, last + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
                out = [_joined(part, words, k, gone) for k in range(len(part))]
                out = [hashlib.sha256(x).hexdigest() for x in out] if digest else [x.decode() for x in out]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array(words.counts), pa.array(removed), pa.array(out, pa.string())], [*names, *MADE])

    return joined.mapInArrow(tidy(run), schema_of(docs, names, "n_words long, n_removed long, kept string"))


def _joined(part, words, k: int, gone: np.ndarray) -> bytes:
    a, b = words.first[k], words.first[k + 1]
    raw = part.bytes_of(k)
    if not gone[a:b].any():
        return b" ".join(raw.split())
    stay = np.flatnonzero(~gone[a:b]) + a
    base = part.offsets[k]
    return b" ".join([raw[s:e] for s, e in zip((words.starts[stay] - base).tolist(), (words.ends[stay] - base).tolist(), strict=True)])
