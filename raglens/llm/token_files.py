"""Token ids in patched frame-of-reference files.

A file is a run of blocks of 256 ids. A block subtracts its minimum, packs the
rest at the width that fits a percentile of them, and lists the ids that need
more bits as exceptions. The header indexes where each block starts, and each
document's number of ids, so that a file reads back by itself.

Documents go to ranges of doc_id; a task encodes a range in order and closes a
file every so many ids. Files are rows of a Parquet table in the shared folder
(a name and the file's bytes), so that Spark's commit protects them from lost
executors and any store works.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raglens.llm.shared import partitions, range_bounds, range_of, written
from raglens.llm.units import UnitCache
from raglens.llm.words import U64, Text, ragged, slices

BLOCK = 256
PERCENTILE = 95
FILE_IDS = 1 << 21
#: Units go to the tokenizer in runs of about so many bytes.
RUN_BYTES = 1 << 12
MAGIC = 0x31464F50


# --- the format -------------------------------------------------------------


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of little-endian bits, 32-bit words."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2, bitorder="little")[:, :, :width]
    return np.packbits(bits.reshape(len(values), BLOCK * width), axis=1, bitorder="little")


def unpack(rows: np.ndarray, width: int) -> np.ndarray:
    """The values of rows that pack() made. A value spans at most 5 bytes: it is cut from a 64-bit word."""
    padded = np.zeros((len(rows), rows.shape[1] + 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    at = np.arange(BLOCK) * width
    first, shift = at >> 3, (at & 7).astype(U64)
    out = np.zeros((len(rows), BLOCK), U64)
    for k in range((width + 14) // 8):
        out |= padded[:, first + k].astype(U64) << U64(8 * k)
    return ((out >> shift) & U64((1 << width) - 1)).astype(np.uint32)


def encode_file(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """One file: header, document counts, block index, blocks. ids: unsigned 32-bit; counts: ids of each document."""
    ids = np.asarray(ids, np.uint32)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(blocks, BLOCK)
    least = rows.min(1, initial=2**32 - 1)
    rest = rows - least[:, None]
    bits = np.ceil(np.log2(rest.astype(np.float64) + 1)).astype(np.int64)
    width = np.sort(bits, axis=1)[:, (BLOCK * PERCENTILE) // 100] if blocks else np.zeros(0, np.int64)
    out = bits > width[:, None]
    odd = out.sum(1)
    # a block: minimum (4 bytes), width (1), number of exceptions (2), packed bits, exception places (2 each) and values (4 each)
    packed_size = BLOCK * width // 8
    size = 7 + packed_size + 6 * odd
    start = np.concatenate(([0], np.cumsum(size)))
    body = np.zeros(int(start[-1]), np.uint8)
    at = start[:-1]
    _put(body, at, least.astype("<u4").view(np.uint8).reshape(-1, 4))
    body[at + 4] = width
    _put(body, at + 5, odd.astype("<u2").view(np.uint8).reshape(-1, 2))
    for w in np.unique(width).tolist():
        if w:
            of = np.flatnonzero(width == w)
            low = np.where(out[of], 0, rest[of])
            _put(body, at[of] + 7, pack(low, w))
    row, place = np.nonzero(out)
    if len(row):
        k = np.arange(len(row)) - np.repeat(np.cumsum(odd) - odd, odd)
        places = at[row] + 7 + packed_size[row]
        _put(body, places + 2 * k, place.astype("<u2").view(np.uint8).reshape(-1, 2))
        _put(body, places + 2 * odd[row] + 4 * k, rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4))
    head = np.array([MAGIC, len(counts), n, blocks], "<u8").tobytes()
    return b"".join([head, np.asarray(counts, "<u4").tobytes(), start[:-1].astype("<u8").tobytes(), body.tobytes()])


def _put(body: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    if rows.size:
        body[at[:, None] + np.arange(rows.shape[1])] = rows


def file_index(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Document counts, block starts, number of ids, and where the blocks begin."""
    magic, docs, n, blocks = np.frombuffer(data, "<u8", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a token file")
    counts = np.frombuffer(data, "<u4", docs, 32)
    return counts, np.frombuffer(data, "<u8", blocks, 32 + 4 * docs).astype(np.int64), n, 32 + 4 * docs + 8 * blocks


def decode_blocks(data: bytes, first: int, last: int) -> np.ndarray:
    """The ids of blocks first .. last-1, found by the index alone."""
    _, start, n, base = file_index(data)
    body, at = np.frombuffer(data, np.uint8), start[first:last] + base
    if len(at) == 0:
        return np.zeros(0, np.uint32)
    least = body[at[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    width = body[at + 4].astype(np.int64)
    odd = body[at[:, None] + np.arange(5, 7)].copy().view("<u2").reshape(-1).astype(np.int64)
    out = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            of = np.flatnonzero(width == w)
            out[of] = unpack(body[(at[of] + 7)[:, None] + np.arange(BLOCK * w // 8)], w)
    row = np.repeat(np.arange(len(at)), odd)
    if len(row):
        k, places = ragged(np.zeros(len(odd), np.int64), odd), at[row] + 7 + (BLOCK * width // 8)[row]
        place = body[(places + 2 * k)[:, None] + np.arange(2)].copy().view("<u2").reshape(-1)
        out[row, place] = body[(places + 2 * odd[row] + 4 * k)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    out += least[:, None]
    return out.reshape(-1)[: n - first * BLOCK]


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids and each document's number of ids."""
    counts, start, _, _ = file_index(data)
    return decode_blocks(data, 0, len(start)), counts


# --- encoding texts ---------------------------------------------------------

_VISIBLE = np.ones(256, bool)
_VISIBLE[:0x21] = False
#: First bytes of characters outside ASCII that a tokenizer may treat as white space.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class BpeEncoder:
    """Encodes with a tokenizers model of byte-level BPE.

    Such a model splits before a space that stands between two visible characters, whatever is around
    it, so what lies between such places encodes alone to the same ids. In rows that may hold white
    space outside ASCII only places between ASCII characters count.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model, self.cache = Tokenizer.from_file(path), UnitCache(self._encode)
        # a byte-level piece has a character for each byte; an added token stands for its own text
        added = {i: len(x.content.encode()) for i, x in self.model.get_added_tokens_decoder().items()}
        self.sizes = np.array([added.get(i) or len(self.model.id_to_token(i) or "") for i in range(self.model.get_vocab_size())])

    def _encode(self, units: Text) -> tuple[np.ndarray, np.ndarray]:
        """Units that may stand side by side go as runs of text; the pieces' sizes tell where each one ends."""
        size = np.diff(units.offsets)
        first, last = units.offsets[:-1], units.offsets[1:] - 1
        second = units.data[np.minimum(first + 1, len(units.data) - 1)]
        odd = np.concatenate(([0], np.cumsum(_MAYBE_SPACE[units.data])))
        plain = np.diff(odd[units.offsets]) == 0
        ascii_ends = (second < 0x80) & (units.data[last] < 0x80)
        fits = (size > 1) & (units.data[first] == 0x20) & _VISIBLE[second] & _VISIBLE[units.data[last]] & (plain | ascii_ends)
        joined, alone = np.flatnonzero(fits), np.flatnonzero(~fits)
        ids, counts = [np.zeros(0, np.uint32)] * 2, np.zeros(len(size), np.int64)
        if len(joined):
            data, ends = units.data[ragged(first[joined], size[joined])].tobytes(), np.cumsum(size[joined])
            cuts = [0, *ends[np.flatnonzero(np.diff(ends // RUN_BYTES))].tolist(), len(data)]
            ids[0] = self._ids([data[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])[0]
            places = np.searchsorted(np.cumsum(self.sizes[ids[0]]), ends) + 1
            counts[joined] = np.diff(places, prepend=0)
        if len(alone):
            ids[1], counts[alone] = self._ids([units.bytes_of(k).decode() for k in alone.tolist()])
        start = np.empty(len(size), np.int64)
        start[joined], start[alone] = np.cumsum(counts[joined]) - counts[joined], len(ids[0]) + np.cumsum(counts[alone]) - counts[alone]
        return np.concatenate(ids)[ragged(start, counts)], counts

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(counts.sum())), counts

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows end to end, and each row's number of ids."""
        data, seen = text.data, _VISIBLE[text.data]
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 0x20) & seen[:-2] & seen[2:]
        at = np.flatnonzero(_MAYBE_SPACE[data])
        if len(at):
            near, mixed = np.zeros(len(data), bool), np.zeros(len(text), bool)
            near[1:-1] = (data[:-2] < 0x80) & (data[2:] < 0x80)
            mixed[np.searchsorted(text.offsets, at, side="right") - 1] = True
            cut &= near | ~np.repeat(mixed, np.diff(text.offsets))
        cut[text.offsets[:-1][np.diff(text.offsets) > 0]] = True
        return self.cache.rows(text, np.flatnonzero(cut))


_ENCODERS: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """One for each worker process, kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BpeEncoder(path)
    return _ENCODERS[path]


# --- writing and reading with Spark -----------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", file_ids: int = FILE_IDS, make: Callable[[str], BpeEncoder] = encoder) -> DataFrame:
    """Encodes the documents in ascending doc_id order into files; returns the written table.

    Columns: part and number (the files' order), before (ids in the part's files before), n_ids, doc_ids
    (as they stand in the file), data (the file). Null and empty texts have the end id alone; null doc_ids
    come first; rows with one doc_id are ordered by their text, equal rows stand side by side. `end_id` is
    appended to each document. Units of text are told apart by 64-bit hashes. Other columns are left out.
    """
    bounds = range_bounds(docs, "doc_id", 4 * partitions(docs.sparkSession))
    # consecutive ranges go to one partition each, so ids within a partition ascend too
    dealt = docs.select("doc_id", text, range_of(F.col("doc_id"), bounds).alias("part"))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "doc_id", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = make(tokenizer), Held()
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held.part != parts[a]:
                    yield from held.close()
                    held = Held(int(parts[a]))
                for rows, piece in slices(batch.slice(a, b - a), text, 2 << 20):
                    ids, counts = codes.encode(piece)
                    held.add(rows.column("doc_id"), np.insert(ids, np.cumsum(counts), end_id), counts + 1)
                    if held.size >= file_ids:
                        yield from held.close()
        yield from held.close()

    return written(dealt.mapInArrow(run, "part int, number int, before long, n_ids long, doc_ids array<long>, data binary"), "token-files")


class Held:
    """What goes into the next file of a range."""

    def __init__(self, part: int = -1):
        self.part, self.number, self.before = part, 0, 0
        self._empty()

    def _empty(self) -> None:
        self.docs, self.ids, self.counts, self.size = [], [], [], 0

    def add(self, docs: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(docs)
        self.ids.append(ids)
        self.counts.append(counts)
        self.size += len(ids)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.docs:
            docs = pa.concat_arrays(self.docs)
            data = encode_file(np.concatenate(self.ids), np.concatenate(self.counts))
            longs = [pa.array([x], pa.int64()) for x in (self.before, self.size)]
            made = [pa.array([self.part], pa.int32()), pa.array([self.number], pa.int32()), *longs, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["part", "number", "before", "n_ids", "doc_ids", "data"])
            self.number, self.before = self.number + 1, self.before + self.size
            self._empty()


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files alone."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    # a row a part, of which there are four for each shuffle partition
    placed = files.join(F.broadcast(before), "part").select((F.col("part_start") + F.col("before")).alias("base"), "doc_ids", "data")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, counts = decode_file(batch.column("data")[k].as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                docs = batch.column("doc_ids").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([docs, pa.array(ends - counts + batch.column("base")[k].as_py()), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


