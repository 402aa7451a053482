"""Retrieval: which chunks a question may see under a configuration, and their ranks.

Filters run before ranking. Which chunks a configuration sees depends only on the
corpus key (parsing, chunking, freshness and question date) and on a chunk's type,
tag and validity: chunks alike in these form a group, and keys meet groups, not
chunks; dates meet validities in a tree over time. Rankings are computed once for each key and question that are asked
together, and shared by all configurations.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.functions.scalars import to_epoch
from raglens.functions.scorers import embed, score_pairs

#: The chunk types each parsing strategy sees.
CHUNK_TYPES = {"text_only": ["text"], "text_table": ["text", "table"], "text_table_vision": ["text", "table", "image"], "spreadsheet_aware": ["spreadsheet_cell", "text"]}
DATED_POLICIES = ("effective_date_filter", "version_aware")
K1, B, FLOOR = 1.5, 0.75, 0.25
RRF_C, RRF_WEIGHTS = 60, (0.6, 0.4)
#: Questions of one matrix product; their vectors go to every task.
QUESTION_BLOCK = 4096
#: Similarities that a task holds at a time.
CELLS = 1 << 21


def filter_scope(chunks: DataFrame, doc_ids: DataFrame | None) -> DataFrame:
    """The chunks of the documents; None: all; a chunk without doc_id never fits a scope."""
    return chunks if doc_ids is None else chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def drop_null_content(chunks: DataFrame, lexical: bool = False) -> DataFrame:
    """Chunks with content; a lexical corpus leaves out empty content too."""
    return chunks.where("content is not null and content <> ''" if lexical else "content is not null")


def type_fits(parsing: str | Column, kind: str | Column) -> Column:
    parsing, kind = (F.col(x) if isinstance(x, str) else x for x in (parsing, kind))
    out = F.lit(True)
    for name, kinds in CHUNK_TYPES.items():
        out = F.when(parsing == name, F.coalesce(kind.isin(*kinds), F.lit(False))).otherwise(out)
    return out


def chunking_fits(strategy: str | Column, tag: str | Column, kind: str | Column) -> Column:
    """The tag is the strategy or atomic; untagged text counts as recursive, other untagged chunks always fit."""
    strategy, tag, kind = (F.col(x) if isinstance(x, str) else x for x in (strategy, tag, kind))
    untagged = F.when(F.coalesce(kind, F.lit("text")) == "text", strategy == "recursive").otherwise(True)
    return F.when(strategy.isNull(), True).when(tag.isNull(), untagged).otherwise((tag == strategy) | (tag == "atomic"))


def freshness_fits(policy: str | Column, at: str | Column) -> Column:
    """Closed interval at the question's date; other policies and undated questions see all."""
    policy, at = (F.col(x) if isinstance(x, str) else x for x in (policy, at))
    start, end = F.col("effective_from"), F.col("effective_to")
    valid = start.isNotNull() & (start <= at) & (end.isNull() | (end >= at))
    return F.when(policy.isin(*DATED_POLICIES) & at.isNotNull(), F.coalesce(valid, F.lit(False))).otherwise(True)


def corpus_keys(runs: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct (parsing, chunking, freshness, at): a few rows for any number of runs and questions."""
    dates = items.select(to_epoch("valid_from").alias("at")).distinct()
    every = runs.select("parsing_strategy", "chunking_strategy", "freshness_policy").distinct().crossJoin(F.broadcast(dates))
    return every.withColumn("at", key_date("freshness_policy", "at")).distinct()


def key_date(policy: str, at: str) -> Column:
    """The date counts only under a dated policy."""
    return F.when(F.col(policy).isin(*DATED_POLICIES), F.col(at))


GROUPED_BY = ["chunk_type", "chunk_strategy", "effective_from", "effective_to"]
#: Seconds lie in 0 .. 2**LEVELS once moved by half of that; what is farther away counts as the end.
LEVELS = 42


def _moment(at: Column) -> Column:
    half = 1 << (LEVELS - 1)
    return F.least(F.greatest(at.cast("long"), F.lit(-half)), F.lit(half - 1)) + F.lit(half)


def time_nodes(at: str) -> Column:
    """The nodes of the tree over all seconds that hold a moment: one on each level, from the second up to all time."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: _node(level, F.call_function("shiftright", _moment(F.col(at)), level)))


def interval_nodes(start: str, end: str) -> Column:
    """The fewest nodes that make up a closed interval, two a level at most; a missing end is the end of time.

    Any moment within it has exactly one of them in time_nodes().
    """
    first, stop = _moment(F.col(start)), _moment(F.coalesce(F.col(end).cast("long"), F.lit(1 << (LEVELS - 1)))) + 1
    state = F.struct(first.alias("a"), stop.alias("b"), F.array().cast("array<long>").alias("nodes"))
    odd = lambda x: x % 2 == 1

    def step(s, level):
        a, b = s["a"], s["b"]
        left, right = (a < b) & odd(a), (a < b) & odd(b)
        nodes = F.concat(s["nodes"], F.when(left, F.array(_node(level, a))).otherwise(F.array().cast("array<long>")), F.when(right & (b - 1 > a), F.array(_node(level, b - 1))).when(right & ~left, F.array(_node(level, b - 1))).otherwise(F.array().cast("array<long>")))
        up = lambda x: F.call_function("shiftright", x, F.lit(1))
        return F.struct(up(a + left.cast("long")).alias("a"), up(b).alias("b"), nodes.alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), state, step)["nodes"]


def _node(level: Column, place: Column) -> Column:
    return level.cast("long") * F.lit(1 << (LEVELS + 1)) + place


def with_group(chunks: DataFrame) -> DataFrame:
    """chunks with `group`: a number for all that keys look at (a 64-bit hash of it)."""
    return chunks.withColumn("group", F.xxhash64(F.to_json(F.struct(*GROUPED_BY))))


def eligible_groups(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """keys with each `group` of chunks that they see.

    A dated key meets groups by the nodes of the time tree: its date lies in one node a level, a validity is made
    up of a few, and they have one in common where they fit. Dates are matched once, whatever the settings; keys
    without a date, no more than there are settings, see groups of any validity.
    """
    groups = with_group(chunks).select("group", *GROUPED_BY).distinct()
    dated = F.coalesce(F.col("freshness_policy").isin(*DATED_POLICIES) & F.col("at").isNotNull(), F.lit(False))
    dates = keys.where(dated).select("at").distinct().select("at", F.explode(time_nodes("at")).alias("_node"))
    nodes = groups.where("effective_from is not null").select("*", F.explode(interval_nodes("effective_from", "effective_to")).alias("_node"))
    fits = type_fits("parsing_strategy", "chunk_type") & chunking_fits("chunking_strategy", "chunk_strategy", "chunk_type")
    valid = dates.join(nodes, "_node").select("at", "group", "chunk_type", "chunk_strategy")
    seen = keys.where(dated).join(valid, "at").where(fits).select(*keys.columns, "group")
    free = groups.join(F.broadcast(keys.where(~dated)), fits).select(*keys.columns, "group")  # as many keys as settings
    return seen.unionByName(free)


def eligible_chunks(keys: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each key's chunks."""
    return with_group(chunks).join(eligible_groups(keys, chunks), "group").drop("group")


def strategy_not_indexed(chunks: DataFrame, strategies: DataFrame) -> DataFrame:
    """strategy, reason: text is there but none of it fits the strategy; untagged text counts as recursive."""
    text = chunks.where(F.coalesce("chunk_type", F.lit("text")) == "text").groupBy("chunk_strategy").agg(F.count("*").alias("n"))
    joined = strategies.join(text, F.lit(True), "left")  # a row a tag
    found = joined.groupBy("strategy").agg(F.sum("n").alias("n"), F.bool_or((F.col("n") > 0) & chunking_fits("strategy", "chunk_strategy", F.lit("text"))).alias("fits"))
    return found.select("strategy", F.when((F.col("n") > 0) & ~F.col("fits"), F.lit("not indexed")).alias("reason"))


def vector_top_k(questions: DataFrame, vectors: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """question_id, vec_id, similarity, rank: exact cosine top k; given a group column, of each group (and the group).

    The vectors stay where they are; question blocks go to them, each task multiplies its batches with the
    block and keeps the k best of each question, and the tasks' candidates meet for the last ranking.
    Questions go in blocks of QUESTION_BLOCK, so what is sent has a fixed size.
    """
    spark = questions.sparkSession
    blocks = max(1, -(-questions.count() // QUESTION_BLOCK))
    part = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    kinds = ", ".join(f"{name} {df.schema[c].dataType.simpleString()}" for name, df, c in (("question_id", questions, "question_id"), ("vec_id", vectors, "vec_id"), *([("group", vectors, group)] if group else [])))
    schema = f"{kinds}, similarity double"
    found, own_vectors = None, vectors.select("vec_id", "embedding", *([F.col(group).alias("group")] if group else []))
    for n in range(blocks):
        own = questions.where(part == n).select("question_id", "embedding").toArrow() if blocks > 1 else questions.select("question_id", "embedding").toArrow()
        if own.num_rows == 0:
            continue
        sent = spark.sparkContext.broadcast((own.column("question_id").combine_chunks(), _unit(own.column("embedding").combine_chunks())))
        best = own_vectors.mapInArrow(_nearest(sent, k, group is not None), schema)
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("question_id", *(["group"] if group else [])).orderBy(F.col("similarity").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def _unit(lists) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)


def _nearest(sent, k: int, grouped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        held: dict = {}
        step = max(1, CELLS // max(1, len(ids)))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            batch = batch.take(pc.sort_indices(batch.column("vec_id")))  # of equal similarities the smaller id wins
            sims, names = q @ _unit(batch.column("embedding")).T, batch.column("vec_id").to_pylist()
            sims[np.isnan(sims)] = NOWHERE
            groups = batch.column("group").to_numpy(zero_copy_only=False) if grouped else np.zeros(len(names), np.int64)
            for g in np.unique(groups).tolist():
                _keep_best(held, g, sims[:, groups == g] if grouped else sims, np.flatnonzero(groups == g), names, k, 9)
        for g, (value, which) in held.items():
            made = value.reshape(-1) > -np.inf
            value = np.where(value == NOWHERE, np.nan, value).reshape(-1)[made]
            own = {"question_id": ids.take(pa.array(np.repeat(np.arange(len(ids)), k)[made])), "vec_id": pa.array(which.reshape(-1)[made].tolist()), **({"group": pa.array([g] * len(value))} if grouped else {}), "similarity": pa.array(value)}
            yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    return run


#: Below any similarity: stands for one that is not a number.
NOWHERE = -2.0


def bm25_top_k(questions: DataFrame, chunks: DataFrame, groups: DataFrame, keys: list[str], k: int, asked: DataFrame | None = None) -> DataFrame:
    """keys, question_id, chunk_id, score, rank: Okapi BM25 over each key's own chunks; k chunks even at score 0.

    chunks (chunk_id, content, group) are seen by the keys that `groups` (keys, group) gives; asked (keys,
    question_id) says which questions each key is asked, all by default. Tokens are split at white space, case
    kept. An idf below zero becomes FLOOR times the mean idf of the key's vocabulary. The chunks are read twice: one
    pass counts frequencies by group, so that a row is shuffled for each term of a task's groups and not for each
    word (terms meet as 64-bit hashes); then blocks of TERM_BLOCK questions and KEY_BLOCK keys go to the chunks with their terms' idf, one
    after the other, so that no more than a block is ever at the driver; each task adds up its chunks' postings and
    keeps the k best for each key and question, and the tasks' candidates meet for the last ranking.
    """
    spark = questions.sparkSession
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    own, tasks = chunks.select("chunk_id", F.col("group").cast("long").alias("group"), "content"), spark.sparkContext.defaultParallelism  # tasks leave out chunks without content: a filter here would cut each text out of its document once more
    if own.rdd.getNumPartitions() < tasks:  # a table of few splits would keep most of the cores idle
        own = own.repartition(tasks)
    key = F.xxhash64(F.to_json(F.struct(*keys))).alias("_key")
    seen = groups.select(key, F.col("group").cast("long").alias("group")).localCheckpoint()
    # frequencies by group: all that is needed of the texts, however many keys there are
    counted = own.select("group", "content").mapInArrow(_count_terms, "group long, term string, df long, words long")
    hashed = F.when(F.col("term").isNull(), F.col("group")).otherwise(F.xxhash64("term"))
    spread = counted.select(hashed.alias("hash"), "group", "df", "words").repartition("hash").sortWithinPartitions("hash").persist(StorageLevel.DISK_ONLY)
    counts = spread.where("words is not null").groupBy("group").agg(F.sum("df").alias("n"), F.sum("words").alias("words")).join(seen, "group")
    size = counts.groupBy("_key").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg_length"))
    terms = questions.select("question_id", F.explode(words(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("times"))
    pairs = (groups.select(*keys).distinct().crossJoin(questions.select("question_id")) if asked is None else asked).select(key, *keys, "question_id").distinct()
    parts = max(1, -(-questions.count() // TERM_BLOCK))
    part = F.pmod(F.xxhash64("question_id"), F.lit(parts)) if parts > 1 else F.lit(0)
    kinds = f"_key long, question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, score double"
    key_parts = max(1, -(-pairs.select("_key").distinct().count() // KEY_BLOCK))
    found = None
    try:
        for i in range(key_parts):
            sizes = {r["_key"]: (r["n"], r["avg_length"]) for r in (size.where(F.pmod(F.xxhash64("_key"), F.lit(key_parts)) == i) if key_parts > 1 else size).collect()}  # about KEY_BLOCK rows
            scopes = seen.where(F.col("_key").isin(list(sizes)))
            scope = scopes.toArrow()
            sums = spread.where("words is null").select("hash", "group", "df").mapInArrow(_sum_idf(spark.sparkContext.broadcast((sizes, scope))), "_key long, total double, n long")
            means = dict(sums.groupBy("_key").agg(F.sum("total") / F.sum("n")).collect())  # as many rows as sizes
            for j in range(parts):
                own_pairs = pairs.where((part == j) & F.col("_key").isin(list(sizes))).select("_key", "question_id").toArrow()
                if own_pairs.num_rows == 0:
                    continue
                own_terms = terms.where(part == j)
                wanted = spread.where("words is null").join(F.broadcast(own_terms.select("term").distinct().withColumn("hash", F.xxhash64("term"))), "hash")  # the terms of a block of questions
                df = wanted.groupBy("group", "term").agg(F.sum("df").alias("df")).join(scopes, "group").groupBy("_key", "term").agg(F.sum("df").alias("df"))
                block = TermBlock.of(own_terms.toArrow(), own_pairs, scope, sizes, means, df.toArrow())
                best = own.mapInArrow(_best_terms(spark.sparkContext.broadcast(block), k), kinds)
                found = best if found is None else found.union(best)
    finally:
        spread.unpersist()
    if found is None:
        found = spark.createDataFrame([], kinds)
    order = Window.partitionBy("_key", "question_id").orderBy(F.col("score").desc(), "chunk_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
    return ranked.join(pairs, ["_key", "question_id"]).select(*keys, "question_id", "chunk_id", "score", "rank")


#: Questions, and keys, whose terms go to every task at a time.
TERM_BLOCK, KEY_BLOCK = 512, 128
#: Chunks whose scores a task holds at a time.
CHUNK_BLOCK = 4096
#: A term in more than this share of the questions is multiplied densely, others follow their postings.
COMMON = 1 / 16
#: Terms that a task counts before it hands their counts on.
HELD_TERMS = 1 << 19


def _with_content(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pc.greater(pc.binary_length(batch.column("content")), 0))  # nulls go too


def _tokens(content: pa.Array) -> list[list[bytes]]:
    """Each text's tokens; bytes are split at the same six characters as \\s in Spark."""
    return [text.split() for text in content.cast(pa.binary()).to_pylist()]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many chunks of a group a term is; a row without a term has the group's chunks and words."""
    held: dict[int, Counter] = {}
    sizes: dict[int, list[int]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for g, counter in held.items():
            names, (n, total) = pa.array([*counter, None], pa.binary()).cast(pa.string()), sizes[g]
            made = [pa.array(np.full(len(names), g)), names, pa.array([*counter.values(), n], pa.int64()), pa.array([None] * len(counter) + [total], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["group", "term", "df", "words"])
        held.clear()
        sizes.clear()

    for batch in batches:
        batch = _with_content(batch)
        for g, words in zip(batch.column("group").to_pylist(), _tokens(batch.column("content")), strict=True):
            if g not in held:
                held[g], sizes[g] = Counter(), [0, 0]
            held[g].update(set(words))
            sizes[g][0] += 1
            sizes[g][1] += len(words)
        if sum(map(len, held.values())) > HELD_TERMS:
            yield from rows()
    yield from rows()


def _sum_idf(sent):
    """Over counts in the order of their terms' hashes: each key's sum of the idf of its vocabulary, and how many terms that has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, scope = sent.value
        names, groups = list(sizes), pc.unique(scope.column("group").combine_chunks())
        sees = np.zeros((len(names), len(groups) + 1), bool)  # the last for groups that no key here sees
        sees[_place(scope, "_key", pa.array(names, pa.int64())), _place(scope, "group", groups)] = True
        totals, terms, rest = np.zeros(len(names)), np.zeros(len(names), np.int64), None

        def add(rows: pa.Table, first: np.ndarray) -> None:
            term, group, df = np.cumsum(first) - 1, _place(rows, "group", groups), rows.column("df").to_numpy()
            for i, name in enumerate(names):
                own = sees[i, group]
                d = np.bincount(term[own], df[own])
                d = d[d > 0]
                totals[i] += _idf(sizes[name][0], d).sum()
                terms[i] += len(d)

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rows.num_rows == 0:
                continue
            first = np.diff(rows.column("hash").to_numpy(), prepend=0) != 0
            first[0] = True
            last = int(np.flatnonzero(first)[-1])  # the last term may go on in the next batch
            add(rows.slice(0, last), first[:last])
            rest = rows.slice(last)
        if rest is not None:
            add(rest, np.arange(rest.num_rows) == 0)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(totals), pa.array(terms)], ["_key", "total", "n"])

    return run


def _idf(n, df: np.ndarray) -> np.ndarray:
    return np.log(n - df + 0.5) - np.log(df + 0.5)


def _place(table: pa.Table, name: str, values: pa.Array) -> np.ndarray:
    """Where each row's value is among values, or -1."""
    return pc.index_in(table.column(name).combine_chunks(), value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)


@dataclass
class TermBlock:
    """Some keys' questions: which terms they have how often, densely for common terms, as postings for the others;
    for each key the idf of the terms, mean length, groups and questions."""

    ids: pa.Array
    vocabulary: pa.Array
    dense: np.ndarray  # each term's row in times, or -1
    times: np.ndarray
    starts: np.ndarray
    questions: np.ndarray
    counts: np.ndarray
    names: list[int]
    idf: np.ndarray
    length: list[float]
    asked: list[np.ndarray]
    seen_by: dict

    @classmethod
    def of(cls, terms: pa.Table, pairs: pa.Table, scopes: pa.Table, sizes: dict[int, tuple[int, float]], means: dict[int, float], df: pa.Table) -> TermBlock:
        ids, vocabulary = pc.unique(pairs.column("question_id").combine_chunks()), pc.unique(terms.column("term").combine_chunks())
        term, question, n = _place(terms, "term", vocabulary), _place(terms, "question_id", ids), terms.column("times").to_numpy()
        term, question, n = term[question >= 0], question[question >= 0], n[question >= 0]
        order = np.lexsort((question, term))
        term, question, n = term[order], question[order], n[order]
        starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        common = np.flatnonzero(np.diff(starts) > COMMON * len(ids))
        dense = np.full(len(vocabulary), -1)
        dense[common] = np.arange(len(common))
        times, held = np.zeros((len(common), len(ids))), dense[term] >= 0
        times[dense[term[held]], question[held]] = n[held]
        names = list(sizes)
        known = pa.array(names, pa.int64())
        weight, of = np.zeros((len(names), len(vocabulary))), _place(df, "_key", known)
        value = _idf(np.array([sizes[x][0] for x in names])[of], df.column("df").to_numpy())
        weight[of, _place(df, "term", vocabulary)] = np.where(value < 0, FLOOR * np.array([means.get(x) or 0.0 for x in names])[of], value)
        own, asked_for = _place(pairs, "_key", known), _place(pairs, "question_id", ids)
        asked = [np.unique(asked_for[own == i]) for i in range(len(names))]
        seen_by: dict = {}
        for i, g in zip(_place(scopes, "_key", known).tolist(), scopes.column("group").to_pylist(), strict=True):
            if i >= 0 and len(asked[i]):
                seen_by.setdefault(g, []).append(i)
        return cls(ids, vocabulary, dense, times, starts, question, n.astype(float), names, weight, [sizes[x][1] for x in names], asked, seen_by)

    def postings(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the terms that are not common, the asked questions: where each term's begin, their places in asked, how often."""
        place = np.full(len(self.ids), -1)
        place[asked] = np.arange(len(asked))
        term, column = np.repeat(np.arange(len(self.dense)), np.diff(self.starts)), place[self.questions]
        held = (column >= 0) & (self.dense[term] < 0)
        return np.searchsorted(term[held], np.arange(len(self.dense) + 1)), column[held], self.counts[held]

    def scores(self, key: int, postings: tuple, row: np.ndarray, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """asked questions x chunks, not rounded; the chunks' terms as entries: row, term, how often."""
        weight = tf * (K1 + 1) / (tf + (K1 * (1 - B + B / self.length[key] * size))[row]) * self.idf[key, term]
        at, asked = self.dense[term], self.asked[key]
        common = at >= 0
        own = np.zeros((len(self.times), len(size)))
        own[at[common], row[common]] = weight[common]
        out = self.times[:, asked].T @ own
        starts, columns, counts = postings
        n = starts[term + 1] - starts[term]
        row, term, weight, n = row[n > 0], term[n > 0], weight[n > 0], n[n > 0]
        ends = np.cumsum(n)
        entry = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - starts[term], n)
        out += np.bincount(columns[entry] * len(size) + np.repeat(row, n), np.repeat(weight, n) * counts[entry], out.size).reshape(out.shape)
        return out


def _best_terms(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = sent.value, {}
        number = {term.encode(): i for i, term in enumerate(block.vocabulary.to_pylist())}
        known, postings = pa.array(list(block.seen_by), pa.int64()), {}
        for whole in map(_with_content, batches):
            for start in range(0, whole.num_rows, CHUNK_BLOCK):
                batch = whole.slice(start, CHUNK_BLOCK)
                batch = batch.filter(pc.is_in(batch.column("group"), value_set=known))
                if batch.num_rows == 0:
                    continue
                batch = batch.take(pc.sort_indices(batch.column("chunk_id")))  # of equal scores the smaller id wins
                _score_chunks(block, number, postings, held, batch, k)
        for key, (value, which) in held.items():
            made = value.reshape(-1) > -np.inf
            ids = block.ids.take(pa.array(np.repeat(block.asked[key], value.shape[1])[made]))
            yield pa.RecordBatch.from_arrays([pa.array([block.names[key]] * int(made.sum()), pa.int64()), ids, pa.array(which.reshape(-1)[made].tolist()), pa.array(value.reshape(-1)[made])], ["_key", "question_id", "chunk_id", "score"])

    return run


def _score_chunks(block: TermBlock, number: dict, postings: dict, held: dict, batch: pa.RecordBatch, k: int) -> None:
    """Scores chunks, in order of their ids, for the keys that see them, and keeps the k best of each question."""
    lists, names = _tokens(batch.column("content")), batch.column("chunk_id").to_pylist()
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    at = np.fromiter(map(number.get, chain.from_iterable(lists), repeat(-1)), np.int64, int(size.sum()))
    entry, tf = np.unique((np.repeat(np.arange(len(size)), size) * len(number) + at)[at >= 0], return_counts=True)
    row, term = np.divmod(entry, max(len(number), 1))
    groups, group = np.unique(batch.column("group").to_numpy(), return_inverse=True)
    for key in sorted({x for g in groups.tolist() for x in block.seen_by[g]}):
        seen = np.array([key in block.seen_by[g] for g in groups.tolist()])[group]
        of, own, mine = np.cumsum(seen) - 1, seen[row], np.flatnonzero(seen)
        if (same := block.asked[key].tobytes()) not in postings:
            postings[same] = block.postings(block.asked[key])
        scores = block.scores(key, postings[same], of[row[own]], term[own], tf[own], size[mine])
        _keep_best(held, key, scores, mine, names, k, 6)


def _keep_best(held: dict, key, scores: np.ndarray, mine: np.ndarray, names: list, k: int, digits: int) -> None:
    """Puts each question's k best of these chunks, names[mine] in ascending order, among what held has of the key."""
    if key not in held:
        held[key] = np.full((len(scores), k), -np.inf), np.full((len(scores), k), None, object)
    value, which = held[key]
    for q, rows in _open_rows(scores, value[:, -1], which[:, -1], names[mine[0]], k, digits):
        old = [(-x, n) for x, n in zip(value[q].tolist(), which[q].tolist(), strict=True) if n is not None]
        new = zip((-np.round(scores[q, rows], digits)).tolist(), (names[i] for i in mine[rows].tolist()), strict=True)
        pool = sorted([*old, *new])[:k]
        value[q, : len(pool)] = [-x for x, _ in pool]
        which[q, : len(pool)] = [n for _, n in pool]


def _open_rows(scores: np.ndarray, bar: np.ndarray, last: np.ndarray, first: str | int, k: int, digits: int) -> Iterator[tuple[int, np.ndarray]]:
    """The questions whose k-th place (its score and id) a chunk here can take, each with its k best chunks; ids ascend from first."""
    best, margin = np.round(scores.max(1), digits), 10.0**-digits
    for q in np.flatnonzero(best >= bar).tolist():
        if best[q] == bar[q] and not first < last[q]:  # a tie goes to the smaller id
            continue
        own = scores[q]
        rows = np.flatnonzero(own >= max(bar[q], np.partition(own, -k)[-k] if len(own) > k else -np.inf) - margin)
        yield q, rows[np.argsort(-np.round(own[rows], digits), kind="stable")[:k]]


def rrf_fuse(vector: DataFrame, lexical: DataFrame, keys: list[str], content: str, limit: int, weights=RRF_WEIGHTS, c: int = RRF_C, carry: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion; equal contents merge and add up, the first seen stands for them, with its `carry` columns."""
    part = lambda df, w, source: df.select(*keys, content, "rank", (F.lit(w) / (F.col("rank") + c)).alias("part"), F.lit(source).alias("source"), *carry)
    both = part(vector, weights[0], 0).unionByName(part(lexical, weights[1], 1))
    merged = both.groupBy(*keys, content).agg(F.round(F.sum("part"), 9).alias("score"), F.min(F.struct("source", "rank", *carry)).alias("seen"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "seen.source", "seen.rank", content)
    merged = merged.withColumn("rank", F.row_number().over(order)).where(f"rank <= {limit}")
    return merged.select(*keys, content, "score", *[F.col(f"seen.{x}").alias(x) for x in carry], "rank")


def rerank(candidates: DataFrame, keys: list[str], k: int, score: Column) -> DataFrame:
    """The k best by a pair score; where it fails (NULL) for any candidate, the old order stays uncut, with rerank_error."""
    scored = candidates.withColumn("rerank_score", score)
    failed = F.max(F.col("rerank_score").isNull()).over(Window.partitionBy(*keys))
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("_failed"), F.lit(0.0)).otherwise(-F.col("rerank_score")), "rank")
    out = scored.withColumn("_failed", failed).withColumn("new_rank", F.row_number().over(order))
    return out.where(F.col("_failed") | (F.col("new_rank") <= k)).withColumns({"reranked": ~F.col("_failed"), "rerank_error": F.when(F.col("_failed"), "a candidate has no score"), "rank": F.col("new_rank")}).drop("_failed", "new_rank")


def recency_sort(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Newest first, undated as 0; equal dates keep their order."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("effective_from", F.lit(0)).desc(), "rank")
    return candidates.withColumn("rank", F.row_number().over(order))


def assemble_context(candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k contents joined for the prompt, beside all chunks in order; chunks without content go first."""
    kept = drop_null_content(candidates)
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content")))
    out = kept.groupBy(*keys).agg(rows.alias("chunks"))
    return out.withColumn("context", F.array_join(F.transform(F.slice("chunks", 1, k), lambda c: c["content"]), "\n\n---\n\n"))


#: So many ids of chunks go to every task.
FEW = 1 << 18
STRATEGIES = ("vector_only", "bm25", "hybrid", "hybrid_reranker")


def retrieve(runs: DataFrame, items: DataFrame, chunks: DataFrame, k: int = 5, embedding: Callable[[str], Column] = embed) -> DataFrame:
    """run_id, query_id, chunk_id, rank, reranked: each run's chunks for each question, by its retrieval strategy.

    vector_only and unknown strategies rank by cosine, bm25 lexically, hybrid fuses both, hybrid_reranker
    reranks the fusion and cuts it to k; under recency_biased the newest come first. Each ranking is computed
    once for a corpus key and question, then handed to all runs of the key. chunks have chunk_id, content and
    what keys look at.
    """
    keys = ["parsing_strategy", "chunking_strategy", "freshness_policy", "at"]
    by = [*keys, "question_id"]
    own = with_group(chunks)
    cut = drop_null_content(own.select("chunk_id", "group", F.explode(F.array("content")).alias("content")))  # a text is made once a row, not once for each use in filters and embeddings
    strategy = F.when(F.col("retrieval_strategy").isin(*STRATEGIES), F.col("retrieval_strategy")).otherwise("vector_only")
    settings = runs.select(*keys[:3], strategy.alias("strategy")).distinct()
    dated = items.select(F.col("id").alias("question_id"), to_epoch("valid_from").alias("date"))

    def asked(*names: str) -> DataFrame:
        """The keys and questions of runs with these strategies."""
        some = settings.where(F.col("strategy").isin(*names)).select(*keys[:3]).distinct()  # at most 64 settings
        return dated.crossJoin(F.broadcast(some)).select(*keys[:3], F.coalesce(key_date("freshness_policy", "date"), F.lit(-1)).alias("at"), "question_id")

    groups = eligible_groups(corpus_keys(runs, items), chunks).withColumn("at", F.coalesce("at", F.lit(-1))).localCheckpoint()
    questions = items.select(F.col("id").alias("question_id"), "question")

    lexical = bm25_top_k(questions, own.select("chunk_id", "content", "group"), groups, keys, k, asked("bm25", "hybrid", "hybrid_reranker")).localCheckpoint()
    vectors = vector_top_k(questions.withColumn("embedding", embedding("question")), cut.select(F.col("chunk_id").alias("vec_id"), embedding("content").alias("embedding"), "group"), k, "group")
    near = vectors.drop("rank").join(groups, "group").join(asked("vector_only", "hybrid", "hybrid_reranker"), by, "left_semi")
    best = Window.partitionBy(*by).orderBy(F.col("similarity").desc(), "vec_id")
    vector = near.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select(*by, F.col("vec_id").alias("chunk_id"), "rank").localCheckpoint()

    # rankings are computed once and hold ids; only the texts they name are shuffled
    ranked = vector.select("chunk_id").union(lexical.select("chunk_id")).distinct().localCheckpoint()
    few = F.broadcast(ranked) if ranked.count() <= FEW else ranked
    texts = own.select("chunk_id", "content", "effective_from").join(few, "chunk_id", "left_semi").localCheckpoint()
    named = lambda df: df.select(*by, "chunk_id", "rank").join(texts, "chunk_id")
    vector, lexical = named(vector), named(lexical)
    both = lambda df: df.join(asked("hybrid", "hybrid_reranker"), by, "left_semi")
    hybrid = rrf_fuse(both(vector), both(lexical), by, "content", 2 * k, carry=("chunk_id", "effective_from"))
    reranked = rerank(hybrid.join(asked("hybrid_reranker"), by, "left_semi").join(questions, "question_id"), by, k, score_pairs("question", "content"))
    lists = [(vector, F.lit(False)), (lexical, F.lit(False)), (hybrid, F.lit(False)), (reranked, F.col("reranked"))]
    every = None
    for name, (rows, flag) in zip(STRATEGIES, lists, strict=True):
        part = rows.select(*by, F.lit(name).alias("strategy"), "chunk_id", "effective_from", "rank", flag.alias("reranked"))
        every = part if every is None else every.unionByName(part)
    newest = recency_sort(every.where("freshness_policy = 'recency_biased'"), [*by, "strategy"])
    every = every.where("coalesce(freshness_policy, '') <> 'recency_biased'").unionByName(newest)
    wanted = runs.select("run_id", *keys[:3], strategy.alias("strategy"))
    return every.join(wanted, [*keys[:3], "strategy"]).select("run_id", F.col("question_id").alias("query_id"), "chunk_id", "rank", "reranked")
