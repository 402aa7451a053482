"""Chunking: elements and texts to chunks with offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import is_blank
from raglens.functions.scorers import DIM
from raglens.operators import splitting

SIZE, OVERLAP = 512, 64


def chunk_fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of `size` characters at every size-overlap, from each start below the length; blank ones dropped."""
    step = max(1, size - overlap)
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)))
    out = docs.select("doc_id", "text", F.explode(starts).alias("start_index"))
    out = out.select("doc_id", "start_index", F.substring(F.col("text"), F.col("start_index") + 1, F.lit(size)).alias("content"))
    return out.where(~is_blank("content")).withColumn("end_index", F.col("start_index") + F.length("content"))


def _by_text(docs: DataFrame, made: str, rows_of: Callable[[list[str]], Iterable[list[tuple]]]) -> DataFrame:
    """doc_id and new columns: some rows for each text, a batch of texts at a time; a null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                found = list(rows_of([t or "" for t in batch.column("text").to_pylist()]))
                sizes = [len(rows) for rows in found]
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                columns = list(zip(*(r for rows in found for r in rows), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, _KINDS[n.split()[1]]) for c, n in zip(columns, made.split(", "), strict=True))], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {made}")


#: Texts whose chunks are held at a time.
TEXTS = 256
_KINDS = {"int": pa.int32(), "string": pa.string()}


def chunk_recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_idx, start_index, content; offsets come from searching on from a cursor that never moves back."""
    rows = lambda text: [(k, start, chunk) for k, (start, chunk) in enumerate(splitting.recursive_chunks(text, size, overlap))]
    return _by_text(docs, "chunk_idx int, start_index int, content string", lambda texts: map(rows, texts))


def chunk_semantic(docs: DataFrame, threshold: float = 0.85, vectors: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """doc_id, chunk_idx, start_index, end_index, content, sentence_count: sentences joined while neighbours are alike;
    texts of up to three sentences stay whole. `vectors` embeds a list of sentences, by default as embed() does."""
    embedder = vectors or (lambda texts: splitting.hashed_counts(texts, DIM))

    def rows(texts: list[str]) -> Iterator[list[tuple]]:
        for own in splitting.semantic_chunks(texts, threshold, embedder):
            yield [(k, *r) for k, r in enumerate(own)]

    return _by_text(docs, "chunk_idx int, start_index int, end_index int, content string, sentence_count int", rows)


def chunk_structure(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, section, section_title, chunk_idx, start_index, content: sections from heading to heading, each chunked by
    chunk_recursive; text before the first heading is a section without title; offsets count from the text's start."""

    def rows(text: str) -> list[tuple]:
        return [(n, title, k, base + start, chunk) for n, title, base, own in splitting.sections(text) for k, (start, chunk) in enumerate(splitting.recursive_chunks(own, size, overlap))]

    return _by_text(docs, "section int, section_title string, chunk_idx int, start_index int, content string", lambda texts: map(rows, texts))


def heading_flag() -> Column:
    m = F.col("metadata")
    return F.coalesce(m["element_type"] == "Title", F.lit(False)) | F.coalesce(m["heading_level"].startswith("Heading"), F.lit(False))


def text_units(elements: DataFrame) -> DataFrame:
    """doc_id, unit, content: runs of text elements of one page, headings marked; other or blank elements start anew."""
    order = Window.partitionBy("doc_id").orderBy("elem_idx")
    text = (F.col("chunk_type") == "text") & ~is_blank("content")
    own = elements.withColumn("is_text", text)
    new = ~F.coalesce(F.lag("is_text").over(order), F.lit(False)) | ~F.lag("page").over(order).eqNullSafe(F.col("page"))
    own = own.withColumn("unit", F.sum(new.cast("int")).over(order)).where("is_text")
    shown = F.when(F.col("is_heading"), F.concat(F.lit("## "), F.col("content"))).otherwise(F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("elem_idx", shown.alias("c"))))
    return own.groupBy("doc_id", "unit").agg(F.first("page").alias("page"), F.array_join(F.transform(rows, lambda x: x["c"]), "\n\n").alias("content"))


#: What names a chunk's place in its document, by strategy.
PLACES = {"fixed": ["start_index"], "recursive": ["chunk_idx"], "semantic": ["chunk_idx"], "structure_aware": ["section", "chunk_idx"]}


def build_index_chunks(texts: DataFrame, others: DataFrame, strategies: list[str], documents: DataFrame) -> DataFrame:
    """Text chunked by every strategy; tables, images and sheet rows (doc_id, elem_idx, content, chunk_type) once, tagged atomic.

    chunk_id is a hash of document, strategy and place, so a repeated ingest gives the same ids. Every chunk
    has its document's filename, version and dates.
    """
    made = {"fixed": chunk_fixed, "recursive": chunk_recursive, "semantic": chunk_semantic, "structure_aware": chunk_structure}
    tagged = lambda df, strategy, kind, place: df.select("doc_id", "content", F.lit(strategy).alias("chunk_strategy"), kind.alias("chunk_type"), F.concat_ws(".", *[F.col(c).cast("string") for c in place]).alias("place"))
    parts = [tagged(made[s](texts), s, F.lit("text"), PLACES[s]) for s in strategies]
    parts.append(tagged(others.where(~is_blank("content")), "atomic", F.col("chunk_type"), ["elem_idx"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("chunk_id", F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "chunk_strategy", "place"), 256)).drop("place")
    return out.join(documents.select("doc_id", "filename", "doc_version", "effective_from", "effective_to"), "doc_id", "left")


def chunk_counts(chunks: DataFrame, strategies: list[str]) -> DataFrame:
    """Chunks of each configured strategy and of atomic, zero-filled; document_counts has the documents' own."""
    names = chunks.sparkSession.createDataFrame([(s,) for s in [*strategies, "atomic"]], "chunk_strategy string")
    counts = chunks.groupBy("chunk_strategy").agg(F.count("*").alias("n"))
    return names.join(counts, "chunk_strategy", "left").na.fill(0, ["n"])


def document_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunks_indexed of every document; 0 without chunks."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks_indexed"))
    return documents.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["chunks_indexed"])
