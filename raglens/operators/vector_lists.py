"""Vector search by a trained coarse quantiser: vectors in lists around centroids, of which a question probes a few.

The centroids come of k-means over a bounded sample; every vector is in the list of its nearest centroid. A question
meets the vectors of its nearest lists only, by exact cosine. What lies in other lists is missed: recall() measures how
much, against retrieval.vector_top_k, which stays the exact way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raglens.operators.retrieval import CELLS, QUESTION_BLOCK, _unit, vector_top_k

#: Vectors of the sample at most, and turns of k-means over it.
SAMPLE, TURNS = 20_000, 12
#: Vectors of the sample that stand for questions.
CALIBRATED = 300


@dataclass
class Lists:
    """Unit centroids, lists x dimensions, and how many of them a question has to probe."""

    centroids: np.ndarray
    probes: int


def train_lists(vectors: DataFrame, lists: int = 64, sample: int = SAMPLE, target: float = 0.95, seed: int = 5) -> Lists:
    """From the vectors of smallest hash; fewer lists if there are fewer vectors. Probes are the fewest that find the
    `target` share of the ten nearest within the sample, of CALIBRATED vectors of it.

    A bound on the hash, by the vectors' count, keeps all but about twice the sample in their tasks.
    """
    own = vectors.where("embedding is not null").select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("key"))
    n = own.count()
    bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 2 * sample // max(n, 1))
    rows = own.where(F.col("key") <= bound).orderBy("key").limit(sample).toArrow()
    if rows.num_rows == 0:
        return Lists(np.zeros((0, 1)), 1)
    x, rng = _unit(rows.column("embedding").combine_chunks()), np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(TURNS):
        near = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = norm[:, 0] == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]  # a list that lost its vectors starts anew
        norm[empty] = 1
        centroids = sums / norm
    return Lists(centroids, _probes(x, centroids, target, rng))


def _probes(x: np.ndarray, centroids: np.ndarray, target: float, rng: np.random.Generator) -> int:
    questions = x[rng.choice(len(x), min(CALIBRATED, len(x)), replace=False)]
    nearest = np.argpartition(-(questions @ x.T), min(10, len(x) - 1), axis=1)[:, :10]
    place = np.argsort(np.argsort(-(questions @ centroids.T), axis=1, kind="stable"), axis=1)
    # in which place of its question's lists each near vector's list stands
    where = np.take_along_axis(place, (x @ centroids.T).argmax(1)[nearest], 1)
    return int(next((p for p in range(1, len(centroids)) if (where < p).mean() >= target), len(centroids)))


def with_list(vectors: DataFrame, lists: Lists) -> DataFrame:
    """vec_id, embedding, list of every vector: written partitioned by list, a search reads the probed ones alone."""

    centroids = lists.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_unit(batch.column("embedding")) @ centroids.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(near.astype(np.int32))], ["vec_id", "embedding", "list"])

    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "embedding"))
    return vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, f"{kinds}, list int")


def probed_top_k(questions: DataFrame, listed: DataFrame, lists: Lists, k: int, probes: int | None = None) -> DataFrame:
    """question_id, vec_id, similarity, rank: the k nearest of each question in its `probes` nearest lists, by default as calibrated.

    Questions go to the vectors in blocks of QUESTION_BLOCK; a task compares each list with the questions that probe it.
    """
    spark, found = questions.sparkSession, None
    blocks = max(1, -(-questions.count() // QUESTION_BLOCK))
    part = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, vec_id {listed.schema['vec_id'].dataType.simpleString()}, similarity double"
    for n in range(blocks):
        own = questions.where((part == n) & F.col("embedding").isNotNull()).select("question_id", "embedding").toArrow()
        if own.num_rows == 0 or len(lists.centroids) == 0:
            continue
        unit = _unit(own.column("embedding").combine_chunks())
        near = np.argsort(-(unit @ lists.centroids.T), axis=1, kind="stable")[:, : probes or lists.probes]
        asked = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((own.column("question_id").combine_chunks(), unit, asked))
        best = listed.where(F.col("list").isin(list(asked))).mapInArrow(_within_lists(sent, k), schema)
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("question_id").orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def _within_lists(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, asked = sent.value
        for batch in batches:
            lists, vectors = batch.column("list").to_numpy(), _unit(batch.column("embedding")) if batch.num_rows else None
            for c in np.unique(lists).tolist():
                own = np.flatnonzero(lists == c)
                names = np.array(batch.column("vec_id").take(pa.array(own)).to_pylist())
                order = np.argsort(names, kind="stable")  # of equal similarities the smaller id wins
                own, names = own[order], names[order]
                step = max(1, CELLS // len(own))
                for some in (asked[c][at : at + step] for at in range(0, len(asked[c]), step)):
                    sims = np.round(unit[some] @ vectors[own].T, 9)
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    questions = ids.take(pa.array(np.repeat(some, top.shape[1])))
                    yield pa.RecordBatch.from_arrays([questions, pa.array(names[top].reshape(-1).tolist()), pa.array(np.take_along_axis(sims, top, 1).reshape(-1))], ["question_id", "vec_id", "similarity"])

    return run


def recall(questions: DataFrame, vectors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """question_id, recall: the share of each question's exact k nearest that were found."""
    exact = vector_top_k(questions, vectors, k).select("question_id", "vec_id")
    hits = exact.join(found.select("question_id", "vec_id", F.lit(1).alias("hit")), ["question_id", "vec_id"], "left")
    return hits.groupBy("question_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
