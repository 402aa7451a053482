"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every hash of the text's 16-byte shingles that lies below a fixed
fraction of all hashes, so long and short documents are sampled alike and the
sketch of a union is the union of sketches. A text with few hashes there keeps
its smallest ones up to a floor, with the bound under which it is complete; two
sketches compare under the smaller of their bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.shared import partitions, range_bounds, range_of
from raglens.llm.words import SLICE_BYTES, U64, Text, mix, slices

SHINGLE = 16
FRACTION = 32
FLOOR = 16
#: Hashes have 40 bits: 10 hex digits each in a fingerprint.
BITS = 40
ALL = 1 << BITS


def sketches(text: Text, fraction: int = FRACTION, floor: int = FLOOR) -> list[tuple[int, np.ndarray]]:
    """(bound, sorted distinct hashes below it) of each row. Empty texts have no hashes and the bound ALL."""
    lengths = np.diff(text.offsets)
    padded = np.concatenate((text.data, np.zeros(SHINGLE, np.uint8)))
    n = len(text.data)
    head = np.ndarray(n, "<u8", padded, 0, (1,)).astype(U64)
    tail = np.ndarray(n, "<u8", padded, 8, (1,)).astype(U64)
    hashes = mix(mix(head) + tail) >> U64(64 - BITS)
    places = np.maximum(lengths - SHINGLE + 1, 0)
    bound = ALL // fraction
    small = np.flatnonzero(hashes < U64(bound))
    row = np.searchsorted(text.offsets, small, side="right") - 1
    small, row = (x[small - text.offsets[row] < places[row]] for x in (small, row))
    value = hashes[small]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    first = np.searchsorted(row, np.arange(len(lengths) + 1)).tolist()
    out = []
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b - a >= floor:
            out.append((bound, value[a:b]))
        elif places[k]:
            own = np.unique(hashes[text.offsets[k] : text.offsets[k] + places[k]])
            out.append((int(own[floor]), own[:floor]) if len(own) > floor else (ALL, own))
        elif lengths[k]:
            whole = int.from_bytes(hashlib.blake2b(text.bytes_of(k), digest_size=8).digest(), "big") >> (64 - BITS)
            out.append((ALL, np.array([whole], U64)))
        else:
            out.append((ALL, np.zeros(0, U64)))
    return out


def to_string(sketch: tuple[int, np.ndarray]) -> str:
    """11 hex digits of the bound, then 10 for each hash."""
    bound, values = sketch
    return f"{bound:011x}" + values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :].tobytes().hex()


def from_string(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint[11:]), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = raw
    return int(fingerprint[:11], 16), wide.reshape(-1).view(">u8").astype(U64)


def merge(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both texts' shingles."""
    bound = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return bound, both[both < U64(bound)] if bound < ALL else both


def overlap(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, int, int]:
    """Hashes of a, of b, and of both, under the smaller bound."""
    bound = min(a[0], b[0])
    x, y = a[1], b[1]
    if a[0] > bound:
        x = x[: np.searchsorted(x, U64(bound))]
    if b[0] > bound:
        y = y[: np.searchsorted(y, U64(bound))]
    if len(x) == 0 or len(y) == 0:
        return len(x), len(y), 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return len(x), len(y), int((y[at] == x).sum())


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The share of a's shingles that b has, as estimated."""
    n, _, shared = overlap(a, b)
    return shared / n if n else float(len(a[1]) == 0 and len(b[1]) == 0)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """The share of the smaller sketch that the larger has; two texts without shingles are alike."""
    n, m, shared = overlap(a, b)
    return shared / min(n, m) if n and m else float(len(a[1]) == 0 and len(b[1]) == 0)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row; null and empty texts have one without hashes."""

    def run(batches):
        for batch in batches:
            for rows, part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(list(map(to_string, sketches(part))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, fingerprint string")


def _text(parts: list[bytes]) -> Text:
    return Text(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64))


def edited(own: bytes, follower: bytes) -> tuple[int, bytes]:
    """Code points of own, and own with its last third replaced by the follower's first as many."""
    if own.isascii() and follower.isascii():
        n = len(own)
        return n, own[: n - n // 3] + follower[: n // 3]
    own, follower = own.decode(), follower.decode()
    n = len(own)
    return n, (own[: n - n // 3] + follower[: n // 3]).encode()


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document.

    The next document is the one of the next smaller doc_id; after the smallest comes the largest. Rows
    with one doc_id follow each other by text, descending; rows without doc_id come last. Rows go to
    ranges of doc_id; each range also gets a copy of the row that follows its last one.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, "doc_id", 4 * partitions(spark))
    ranged = docs.select("doc_id", text, range_of(F.col("doc_id"), bounds).alias("part"))
    # one row for each range: bounded by the number of partitions
    tops = sorted((r["part"], r["top"]) for r in ranged.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    follows = [(tops[k - 1][1], tops[k][0]) for k in range(len(tops))]
    halo = F.broadcast(spark.createDataFrame(follows, "top long, target int"))
    both = ranged.join(halo, F.col("doc_id").eqNullSafe(F.col("top")), "left")
    none = F.lit(None).cast("struct<part:int,halo:boolean>")
    copy = F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("part"), F.lit(True).alias("halo"))).otherwise(none)
    places = F.filter(F.array(F.struct("part", F.lit(False).alias("halo")), copy), lambda x: x.isNotNull())
    dealt = both.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), F.explode(places).alias("at")).select("doc_id", "text", "at.part", "at.halo")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for rows, part in slices(batch):
                columns = (rows.column(c).to_pylist() for c in ("doc_id", "part", "halo"))
                for k, (doc, place, is_copy) in enumerate(zip(*columns, strict=True)):
                    if is_copy and held and held[-1][2] and held[-1][1] == place:
                        continue  # of several rows with the largest doc_id the first one follows
                    held.append((doc, place, is_copy, part.bytes_of(k)))
                    size += len(held[-1][3])
                if size >= SLICE_BYTES:
                    yield _compared(held)
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield _compared(held)

    return dealt.mapInArrow(run, EDITED)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but copies and the last one, each held against the row after it."""
    at = [k for k in range(len(rows) - 1) if not rows[k][2]]
    made = [edited(rows[k][3], rows[k + 1][3]) for k in at]
    own, other = sketches(_text([r[3] for r in rows])), sketches(_text([x for _, x in made]))
    columns = [
        pa.array([rows[k][0] for k in at], pa.int64()),
        pa.array([n for n, _ in made], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for _, x in made], pa.string()),
        pa.array([to_string(own[k]) for k in at], pa.string()),
        pa.array(list(map(to_string, other)), pa.string()),
        pa.array([likeness(own[k], x) for k, x in zip(at, other, strict=True)], pa.float64()),
        pa.array([likeness(own[k], own[k + 1]) for k in at], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in EDITED.split(", ")])
