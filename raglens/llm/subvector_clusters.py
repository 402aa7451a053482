"""Exact k-means over integer vectors, by dictionaries of their subvectors.

Vectors are written once as chunks: each block of dimensions holds its distinct subvectors (lossless)
and one code a vector. A round computes the distance of each distinct subvector to each centroid once,
sums these parts by code to the distances of the vectors, and sums what moves the centroids by counting
codes. Chunks are bounded, so is the memory of a task; only centroids and their sums meet the driver.

Edge cases: vectors that are null, of another length, or with a null or non-finite component are left
out, so no rows come of an empty table. A null id is kept, but starts no centroid. Repeated ids are
rows of their own. With fewer vectors than centroids there are as many centroids as vectors. A vector
with a component beyond LARGEST has no distance that fits a long: it comes back with null in all
columns but its id and takes no part. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.shared import scratch, written
from raglens.llm.words import tidy

#: Largest absolute value of an integer component: 64 squared differences of twice that fit a long.
LARGEST = 1 << 27
#: Dimensions of a block, and vectors of a chunk.
WIDTH, CHUNK = 2, 1 << 15


@dataclass
class Encoded:
    """Vectors as codes: a dictionary (entries x width) and the codes of all vectors for each block."""

    dictionaries: list[np.ndarray]
    codes: list[np.ndarray]

    @classmethod
    def of(cls, vectors: np.ndarray, width: int) -> Encoded:
        parts = [_distinct(vectors[:, at : at + width]) for at in range(0, vectors.shape[1], width)]
        return cls([d for d, _ in parts], [c for _, c in parts])

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances, vectors x centroids: parts of distinct subvectors, summed by code."""
        out, at = np.zeros((len(self.codes[0]), len(centroids)), np.int64), 0
        for entries, codes in zip(self.dictionaries, self.codes, strict=True):
            own = centroids[:, at : at + entries.shape[1]]
            part = ((entries[:, None, :] - own[None]) ** 2).sum(2)
            out += part[codes]
            at += entries.shape[1]
        return out

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """The vectors' sum in each cluster, by counts of codes."""
        out = []
        for entries, codes in zip(self.dictionaries, self.codes, strict=True):
            times = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
            out.append(times @ entries)
        return np.concatenate(out, axis=1)

    def vectors(self) -> np.ndarray:
        return np.concatenate([d[c] for d, c in zip(self.dictionaries, self.codes, strict=True)], axis=1)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and each row's number among them; rows become one integer where their ranges allow it."""
    low = rows.min(0)
    spans = rows.max(0) - low + 1
    if float(np.prod(spans.astype(float))) < 2.0**62:
        key = np.zeros(len(rows), np.int64)
        for column, first, span in zip(rows.T, low.tolist(), spans.tolist(), strict=True):
            key = key * span + (column - first)
        _, first, codes = np.unique(key, return_index=True, return_inverse=True)
        return rows[first], codes
    found, codes = np.unique(rows, axis=0, return_inverse=True)
    return found, codes.reshape(-1)


_CODED = "ids array<{id}>, widths array<int>, entries array<int>, sizes array<int>, codes binary"


def _encode(size: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, CHUNK - n)
                batch, n = batch.slice(part.num_rows), n + part.num_rows
                held.append(part)
                if n == CHUNK:
                    yield _coded(held, size, width)
                    held, n = [], 0
        if n:
            yield _coded(held, size, width)

    return tidy(run)


def _coded(held: list[pa.RecordBatch], size: int, width: int) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    vectors = whole.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
    made = Encoded.of(vectors, width)
    ids = whole.column("id").combine_chunks()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
    for values in ([d.shape[1] for d in made.dictionaries], np.concatenate([d.reshape(-1) for d in made.dictionaries]), [len(d) for d in made.dictionaries]):
        lists.append(pa.array([np.asarray(values, np.int32)], pa.list_(pa.int32())))
    codes = b"".join(c.astype(np.uint16 if len(d) <= 1 << 16 else np.uint32).tobytes() for d, c in zip(made.dictionaries, made.codes, strict=True))
    return pa.RecordBatch.from_arrays([*lists, pa.array([codes], pa.binary())], ["ids", "widths", "entries", "sizes", "codes"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Encoded]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            widths, sizes = (batch.column(c)[i].values.to_numpy() for c in ("widths", "sizes"))
            entries, codes = batch.column("entries")[i].values.to_numpy().astype(np.int64), batch.column("codes")[i].as_py()
            dictionaries, own, at, byte = [], [], 0, 0
            for w, n in zip(widths.tolist(), sizes.tolist(), strict=True):
                kind = np.dtype(np.uint16 if n <= 1 << 16 else np.uint32)
                dictionaries.append(entries[at : at + w * n].reshape(n, w))
                own.append(np.frombuffer(codes, kind, len(ids), byte).astype(np.int64))
                at, byte = at + w * n, byte + kind.itemsize * len(ids)
            yield ids, Encoded(dictionaries, own)


def _moved(centroids: np.ndarray):
    """cluster, dim, count, total, distance of a task's chunks: what a round sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, far, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for _, own in _decoded(batches):
            d = own.distances(centroids)
            cluster = d.argmin(1)
            count += np.bincount(cluster, minlength=k)
            total += own.sums(cluster, k)
            best = d[np.arange(len(d)), cluster]
            for j in np.unique(cluster).tolist():
                far[j] += sum(best[cluster == j].tolist())  # Python's integers: it may pass a long
        made = {"cluster": np.repeat(np.arange(k, dtype=np.int32), dims), "dim": np.tile(np.arange(dims, dtype=np.int32), k), "count": np.repeat(count, dims), "total": total.reshape(-1)}
        distance = pa.array([str(x) for x in np.repeat(np.array(far, object), dims)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, made.values()), distance], [*made, "distance"])

    return tidy(run)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in _decoded(batches):
            d = own.distances(centroids)
            cluster = d.argmin(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(d[np.arange(len(d)), cluster])], ["vec_id", "cluster", "distance"])

    return tidy(run)


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, width: int = WIDTH, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of all whole vectors of `size` components."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    x = F.col("embedding")
    whole = vectors.select(F.col("vec_id").alias("id"), F.transform(x, lambda e: e.cast("double")).alias("x")).where((F.size("x") == size) & F.forall("x", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    scaled = whole.withColumn("_fits", F.forall("x", lambda e: F.abs(e * scale) < LARGEST))
    kept = scaled.where("_fits").select("id", F.transform("x", lambda e: F.floor(e * scale).cast("int")).alias("v"))
    wide = scaled.where("not _fits").select(F.col("id").alias("vec_id"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.where("id is not null").orderBy(order, "v").limit(k).select("v").repartition(1).collect()  # the tasks' candidates meet in a task, k rows come here
    out = "vec_id {0}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(kind)
    nothing = wide.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in out.split(", ")[1:]])
    if not first:
        return nothing
    centroids = np.array([r["v"] for r in first], np.int64)
    with scratch() as keep:
        coded = keep(written(kept.mapInArrow(_encode(size, width), _CODED.format(id=kind)), "subvectors"))
        for _ in range(rounds):
            sums = _round(coded, centroids)
            for (j, i), (n, total, _far) in sums.items():
                if n:
                    centroids[j, i] = int(total) // int(n)
        far = {j: int(x[2]) for (j, i), x in _round(coded, centroids).items() if i == 0}
        named = [(j, far.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
        fits = lambda n: n if n < 1 << 63 else None
        known = spark.createDataFrame([(j, fits(n), fits(sum(far.values())), s) for j, n, s in named], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        rows = coded.mapInArrow(_assigned(centroids), f"vec_id {kind}, cluster int, distance long").join(F.broadcast(known), "cluster")  # k rows
        return rows.select(nothing.columns).union(nothing)


def _round(coded: DataFrame, centroids: np.ndarray) -> dict:
    """(cluster, dim) -> (count, total, distance): k x dims rows come back, whatever the number of vectors."""
    parts = coded.mapInArrow(_moved(centroids), "cluster int, dim int, count long, total long, distance string")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return {(r["cluster"], r["dim"]): (r["count"], r["total"], r["distance"]) for r in parts.groupBy("cluster", "dim").agg(big("count"), big("total"), big("distance")).collect()}
