"""Cleans `documents` in five stages: language, near copies, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns the next one's documents; run() writes each result
as Parquet in the shared folder and reads it again. The last stage returns token digests. A document is
a row: rows are told apart by doc_id and text. Columns beyond doc_id and text travel in one struct, so
that their names can't clash with an operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raglens.llm import decontaminate, language_id, near_dedup, sentencepiece_viterbi, substring_dedup
from raglens.llm.queries import PIECES
from raglens.llm.shared import column, free_name, version, written
from raglens.session import table

#: A document stays if one language has at least this share of its words.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null, without letters or without a leading language go."""
    found = language_id.predict(_packed(docs), language_id.train(docs))
    return _unpacked(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE)), docs, cut=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of its smallest doc_id, and of equal rows any one.

    Texts without words and rows without doc_id stay, each of them.
    """
    groups, at = near_dedup.near_groups(docs), free_name(docs, "_version")
    own = docs.withColumn(at, version("text"))
    key = lambda df: df.select("doc_id", F.col("version").alias(at))
    gone = key(groups.where("not first")).distinct()
    again = key(groups.where("first and n_shingles > 0 and doc_id is not null")).groupBy("doc_id", at).count().where("count > 1").drop("count")
    if again.isEmpty():
        return own.join(gone, ["doc_id", at], "left_anti").select(*map(column, docs.columns))
    single = own.join(gone.union(again), ["doc_id", at], "left_anti")
    return single.union(own.join(again, ["doc_id", at], "left_semi").dropDuplicates(["doc_id", at]).select(single.columns)).select(*map(column, docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that an earlier document has; documents that lose all words go.

    A changed text is its kept words, joined by a space.
    """
    found = substring_dedup.kept_words(_packed(docs), digest=False).where("n_removed = 0 or n_removed < n_words")
    return _unpacked(found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark items cover; documents that lose all words go."""
    return _unpacked(decontaminate.without_spans(_packed(docs), table(spark, sf_dir, "benchmark")), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the digests of each text's token ids and of what they decode to, and the other columns but text.

    A column named like a digest gives way to it.
    """
    found = sentencepiece_viterbi.round_trip(_packed(docs), PIECES)
    made = [c for c in found.columns if c != "_rest"]
    rest = [c for c in docs.columns if c.lower() not in {"text", *map(str.lower, made)}]
    return found.select(*made, *[F.col("_rest").getField(c).alias(c) for c in rest])


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*map(column, rest)) if rest else F.lit(None).cast("struct<n:int>")).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame, cut: bool = True) -> DataFrame:
    """The columns of docs again; where the texts are new, n_chars is counted anew."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | ({"n_chars": F.length("text").cast("long")} if cut else {})
    return rows.select(*[own[c].alias(c) if c in own else F.col("_rest").getField(c).alias(c) for c in docs.columns])


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("token_ids", token_ids)]

#: Language proportions come from an iterative fit, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
