"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The best segmentation of a text is the one whose pieces' scores sum highest, as
in SentencePiece's unigram decoding; the pieces and scores come from a model
file. No piece holds a space mark after another character, so a text splits
before each run of spaces and the parts decode alone. Different words of equal
length advance together: at each end place, substring hashes of every length
probe the sorted piece keys, and vectorised maxima store score and backpointer.
Of equal sums the longest last piece wins. A character without a piece becomes
its bytes. Long words would advance alone: their pieces are probed for many end
places at once, and only the maxima are taken place by place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from raglens.llm.shared import beside, schema_of
from raglens.llm.units import UnitCache
from raglens.llm.words import LEAN_SLICE_BYTES, U64, Text, mix, powers, ragged, slices, tidy

MARK = "▁"
#: Stands for a mark that the text itself holds; no piece has it, so it becomes bytes and comes back.
_OWN_MARK = 0x110000
_P = 0xD1342543DE82EF95
_FILTER_BITS = 22
_CELLS = 1 << 20
#: Words of more characters go alone, so many end places at once.
LONG, PLACES = 128, 1 << 17


class Pieces:
    """A model's pieces: sorted keys to probe, scores, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kinds = [(model.is_control(i) or model.is_unknown(i) or model.is_unused(i), model.is_byte(i)) for i in range(n)]
        texts = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        raw, normal = [], []
        for i, (text, (other, byte)) in enumerate(zip(texts, kinds, strict=True)):
            if byte:
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                raw.append(bytes([value]))
            elif other:
                raw.append(b"")
            else:
                if MARK in text.lstrip(MARK):
                    raise ValueError(f"piece {text!r} crosses words")
                normal.append(i)
                raw.append(text.replace(MARK, " ").encode())
        keys = np.array([self._key(texts[i]) for i in normal], U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        score = np.array([model.get_score(i) for i in range(n)])
        self.score = score[self.ids]
        self.unknown = float(self.score.min()) - 10
        self.longest = max(len(texts[i]) for i in normal)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> U64(64 - _FILTER_BITS)] = True
        self.powers = powers(_P, self.longest + 1)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, n)
        self.raw_start = np.concatenate(([0], np.cumsum(self.raw_size)[:-1]))
        self.cache = UnitCache(self._encode)

    def _key(self, text: str) -> int:
        h = np.zeros(1, U64)
        for c in text:
            h = h * U64(_P) + mix(np.array([ord(c)], U64) + U64(1))
        return int(h[0])

    # --- encoding

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows end to end, and each row's number of ids; an empty row has none."""
        filled = np.flatnonzero(np.diff(text.offsets) > 0)
        data = np.insert(text.data, text.offsets[filled], 0x20)
        shift = np.zeros(len(text) + 1, np.int64)
        shift[filled + 1] = 1
        offsets = text.offsets + np.cumsum(shift)
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[filled]] = True
        return self.cache.rows(Text(data, offsets), np.flatnonzero(start))

    def _encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        units = [text.bytes_of(k).decode() for k in range(len(text))]
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        found: list = [None] * len(units)
        at = 0
        while at < len(order):
            length = int(lengths[order[at]])
            end = min(int(np.searchsorted(lengths[order], length, side="right")), at + max(1, _CELLS // length))
            rows = order[at:end]
            if length > LONG:
                found[order[at]] = self.segment_long(np.frombuffer(units[order[at]].encode("utf-32-le"), np.uint32))
                at += 1
                continue
            codes = np.frombuffer("".join([units[i] for i in rows]).encode("utf-32-le"), np.uint32).reshape(len(rows), length)
            ids, counts = self.segment(codes)
            for i, piece in zip(rows.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                found[i] = piece
            at = end
        return np.concatenate(found).astype(np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over a matrix of code points, a row a word; spaces count as marks."""
        n, length = codes.shape
        shown = np.where(codes == 0x20, 0x2581, np.where(codes == 0x2581, _OWN_MARK, codes)).T
        coded = mix(shown.astype(U64) + U64(1))
        prefix = np.zeros((length + 1, n), U64)
        for k in range(length):
            prefix[k + 1] = prefix[k] * U64(_P) + coded[k]
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.ones((length + 1, n), np.int32), np.full((length + 1, n), -1, np.int64)
        for end in range(1, length + 1):
            single = np.zeros(n, bool)
            for size in range(min(self.longest, end), 0, -1):
                key = prefix[end] - prefix[end - size] * self.powers[size]
                rows = np.flatnonzero(self.filter[key >> U64(64 - _FILTER_BITS)])
                if len(rows) == 0:
                    continue
                key = key[rows]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                rows, at = rows[hit], at[hit]
                if size == 1:
                    single[rows] = True
                total = best[end - size, rows] + self.score[at]
                more = total > best[end, rows]
                rows, at = rows[more], at[more]
                best[end, rows], back[end, rows], piece[end, rows] = total[more], size, self.ids[at]
            rows = np.flatnonzero(~single)
            if len(rows):
                total = best[end - 1, rows] + self.unknown
                more = total > best[end, rows]
                rows = rows[more]
                best[end, rows], back[end, rows], piece[end, rows] = total[more], 1, -1
        return self._trace(codes, back, piece)

    def segment_long(self, codes: np.ndarray) -> np.ndarray:
        """The same for one word of any length: ids of its pieces."""
        n, back, piece = len(codes), np.ones(len(codes) + 1, np.int8), np.full(len(codes) + 1, -1, np.int32)
        best = [0.0]  # of the last `longest` places
        for first in range(0, n, PLACES):
            last, lead = min(first + PLACES, n), max(0, first - self.longest)
            own = codes[lead:last]
            coded = mix(np.where(own == 0x20, 0x2581, np.where(own == 0x2581, _OWN_MARK, own)).astype(U64) + U64(1))
            ends, sizes, found = [], [], []
            key = np.zeros(len(own), U64)
            for size in range(1, min(self.longest, last) + 1):
                # the key of the `size` characters that end at each place: one more before those of size-1
                key[size - 1 :] += coded[: len(own) - size + 1] * self.powers[size - 1]
                places = np.arange(max(size - 1, first - lead), len(own))
                places = places[self.filter[key[places] >> U64(64 - _FILTER_BITS)]]
                at = np.minimum(np.searchsorted(self.keys, key[places]), len(self.keys) - 1)
                hit = self.keys[at] == key[places]
                ends.append(places[hit] + lead + 1)
                sizes.append(np.full(len(ends[-1]), size))
                found.append(at[hit])
            end, size, at = (np.concatenate(x) for x in (ends, sizes, found))
            order = np.lexsort((-size, end))
            size, at = size[order], at[order]
            bounds = np.searchsorted(end[order], np.arange(first + 1, last + 2)).tolist()
            size_, score, ids = size.tolist(), self.score[at].tolist(), self.ids[at].tolist()
            for k in range(last - first):
                top, width, which, single = -np.inf, 1, -1, False
                for j in range(bounds[k], bounds[k + 1]):
                    total = best[-size_[j]] + score[j]
                    single = single or size_[j] == 1
                    if total > top:
                        top, width, which = total, size_[j], ids[j]
                if not single and best[-1] + self.unknown > top:
                    top, width, which = best[-1] + self.unknown, 1, -1
                best.append(top)
                back[first + k + 1], piece[first + k + 1] = width, which
            best = best[-self.longest :]
        out, at, back, piece = [], n, memoryview(back), memoryview(piece)
        while at:
            out += [piece[at]] if piece[at] >= 0 else self.byte_ids[np.frombuffer(chr(codes[at - 1]).encode(), np.uint8)].tolist()[::-1]
            at -= back[at]
        return np.array(out[::-1], np.int64)

    def _trace(self, codes: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = codes.shape
        at, row, out = np.full(n, length), np.arange(n), []
        while len(row):
            out.append((row, at, piece[at, row]))
            at = at - back[at, row]
            row, at = row[at > 0], at[at > 0]
        row, at, ids = (np.concatenate([x[k] for x in out]) for k in range(3))
        order = np.lexsort((at, row))
        row, at, ids = row[order], at[order], ids[order]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            raw = [chr(codes[r, e - 1]).encode() for r, e in zip(row[unknown].tolist(), at[unknown].tolist(), strict=True)]
            size = np.ones(len(ids), np.int64)
            size[unknown] = [len(x) for x in raw]
            places = np.repeat(ids < 0, size)
            ids, row = np.repeat(ids, size), np.repeat(row, size)
            ids[places] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.bincount(row, minlength=n)

    # --- decoding

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Text:
        """The rows' bytes: pieces end to end, without the space put before each row."""
        size = self.raw_size[ids]
        data = self.raw[ragged(self.raw_start[ids], size)]
        total = np.concatenate(([0], np.cumsum(size)))
        offsets = total[np.concatenate(([0], np.cumsum(counts)))]
        filled = np.diff(offsets) > 0
        data = np.delete(data, offsets[:-1][filled])
        return Text(data, offsets - np.concatenate(([0], np.cumsum(filled))))


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One for each worker process, kept over tasks."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode_ids(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with token_ids; null and empty texts have none. An input column of that name gives way."""
    names = beside(docs, ["token_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch, text, LEAN_SLICE_BYTES):
                ids, counts = pieces(model).encode(part)
                bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))], [*names, "token_ids"])

    return docs.mapInArrow(tidy(run), schema_of(docs, names, "token_ids array<int>"))


def decode_ids(rows: DataFrame, model: str, ids: str = "token_ids") -> DataFrame:
    """rows with decoded: the texts that the ids spell; bytes that are no UTF-8 become replacement characters."""
    names = beside(rows, ["decoded"])

    def run(batches):
        for batch in batches:
            lists = batch.column(ids)
            out = pieces(model).decode(lists.flatten().to_numpy(), lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([out.bytes_of(k).decode(errors="replace") for k in range(len(out))], pa.string())], [*names, "decoded"])

    return rows.mapInArrow(tidy(run), schema_of(rows, names, "decoded string"))


def round_trip(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs without text, with n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_chars, decoded_sha256, exact.

    Null and empty texts have no ids and decode to nothing. Each row has its own text's result. Words are told
    apart by 64-bit hashes. Input columns named like an output give way to it.
    """
    names = [c for c in beside(docs, ROUND_TRIP) if c != text]

    def run(batches):
        for batch in batches:
            for rows, part in slices(batch, text, LEAN_SLICE_BYTES):
                ids, counts = pieces(model).encode(part)
                back = pieces(model).decode(ids, counts)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                texts = [back.bytes_of(k) for k in range(len(back))]
                made = [
                    pa.array(counts),
                    pa.array(crc, pa.int64()),
                    pa.array([len(x) if x.isascii() else len(x.decode(errors="replace")) for x in texts], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    pa.array([x == part.bytes_of(k) for k, x in enumerate(texts)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *made], [*names, *ROUND_TRIP])

    return docs.mapInArrow(tidy(run), schema_of(docs, names, "n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string, exact boolean"))


ROUND_TRIP = ["n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256", "exact"]
