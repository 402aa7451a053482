"""Language-model scores from a log-frequency Bloom filter.

Training counts every token and every pair of neighbours exactly: tasks
pre-aggregate their own pairs, and ranges of the hash space meet in one task
each. A count c is held as its level, 1 + floor(log_1.5 c): the filter gets an
entry for each level up to it, so reading a count means probing level after
level until one is missing. Each hash range fills its own block of the filter,
twelve bits an entry, so the filter grows with the entries and no count is dropped.
The blocks stay in a table: each slice of the texts sends its distinct keys to
the blocks, and their levels come back to it. Probabilities discount each pair
by one occurrence and give what that frees, as measured for each level of the
context, to the token's own share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.shared import beside, column, partitions, schema_of, scratch, written
from raglens.llm.words import SLICE_BYTES, SPACED, U64, mix, ragged, slices, text_of, words_of

LOG_BASE = 1.5
LEVELS = 64
PROBES = 5
BITS_AN_ENTRY = 12
#: The largest number of tokens whose exact counts are sent along.
MOST_EXACT = 1 << 20
RANGE_TOKENS = 1 << 21
#: Text bytes of a shuffle partition of slices, about.
PART_BYTES = 64 << 20
_HELD = 1 << 20
_END = mix(np.array([11], U64))[0]
_BEGIN = mix(np.array([12], U64))[0]
_LOW = U64(0xFFFFFFFF)
_PAIR, _SINGLE = U64(0xB5AD4ECEDA1CE2A9), U64(0x00000000F39CC060)


def sequences(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows with an end after each, the token before each, and where each row starts."""
    counts = words.counts
    first = words.first + np.arange(len(words.first))
    tokens = np.full(int(first[-1]), _END, U64)
    tokens[ragged(first[:-1], counts)] = words.hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _BEGIN
    return tokens, before, first


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The low half is the context's, so that pairs can be summed by context; the high half deals them to ranges."""
    return (mix(before * _PAIR + tokens) & ~_LOW) | (before & _LOW)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for 1, then one more for each factor of LOG_BASE; 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LOG_BASE) + 1e-9), 0).astype(np.int64)


def _typical() -> np.ndarray:
    """The middle of the counts of each level."""
    low = np.ceil(LOG_BASE ** np.arange(LEVELS) - 1e-9)
    return np.concatenate(([0.0], (low[:-1] + np.maximum(low[1:] - 1, low[:-1])) / 2))


TYPICAL = _typical()


@dataclass
class BloomCounts:
    """blocks: a row of bits for each hash range; floor: the level at which each block's entries start."""

    blocks: np.ndarray
    floor: np.ndarray

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level as the probes say: 0, or the last level that all probes find."""
        block = (keys >> U64(64 - _bits(len(self.blocks)))).astype(np.int64) if len(self.blocks) > 1 else np.zeros(len(keys), np.int64)
        level = np.zeros(len(keys), np.int64)
        todo, at = np.arange(len(keys)), self.floor[block]
        while len(todo):
            found = np.ones(len(todo), bool)
            for place in places(keys[todo], at, self.blocks.shape[1] * 8):
                found &= (self.blocks[block[todo], place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            todo, at = todo[found], at[found]
            level[todo] = at
            at = at + 1
            on = at < LEVELS
            todo, at = todo[on], at[on]
        return level


def places(keys: np.ndarray, level: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = mix(keys + level.astype(U64) * U64(0x9E3779B97F4A7C15))
    step = (h >> U64(32)) | U64(1)
    for k in range(PROBES):
        yield ((h + U64(k) * step) % U64(bits)).astype(np.int64)


def _bits(n: int) -> int:
    return int(n - 1).bit_length()


class Tally:
    """Counts of keys in one task; a full tally is handed on, cut by hash range."""

    def __init__(self, kind: int, ranges: int):
        self.kind, self.ranges, self.parts, self.size = kind, ranges, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.unique(keys, return_counts=True))
        self.size += len(self.parts[-1][0])
        if self.size > _HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, counts = _summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
        self.parts, self.size = [], 0
        cuts = np.searchsorted(keys, np.arange(1, self.ranges, dtype=U64) << U64(64 - _bits(self.ranges))) if self.ranges > 1 else []
        rows = [(k, planes(a), b.astype("<u4").tobytes()) for k, (a, b) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)) if len(a)]
        at, a, b = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([self.kind] * len(at), pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["part", "kind", "keys", "counts"])


def planes(keys: np.ndarray) -> bytes:
    """Keys byte by byte, the highest of all first: what sorted keys share compresses away."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").reshape(-1).astype(U64)


def short_keys(keys: np.ndarray) -> np.ndarray:
    """40 bits of each key: what the filter of its hash range holds, and what is sent to ask it."""
    return mix(keys) >> U64(24)


def short_planes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].T).tobytes()


def from_short_planes(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(5, -1)
    whole = np.zeros((rows.shape[1], 8), np.uint8)
    whole[:, 3:] = rows.T
    return whole.view(">u8").reshape(-1).astype(U64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Model:
    #: part, block: the filter, a row for each of the hash ranges.
    blocks: DataFrame | None
    ranges: int
    #: Bytes and rows of the training texts.
    size: int
    tokens: int
    types: int
    #: Exact counts of the most frequent tokens, by hash.
    keys: np.ndarray
    counts: np.ndarray
    #: For each level of the context: the share that goes to the token's own probability.
    backoff: np.ndarray

    def log10(self, single: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 P(token | token before) of each place, from the levels of the token, the token before and both."""
        alone = (TYPICAL[single] + 1) / (self.tokens + self.types + 1)
        pair = TYPICAL[pair]
        seen = np.minimum(np.maximum(pair - 1, 0) / np.maximum(TYPICAL[context], np.maximum(pair, 1)), 1)
        share = self.backoff[context]
        return np.log10(np.where(context > 0, np.minimum(seen, 1 - share) + share * alone, alone))


def _size(rows: DataFrame, text: str) -> int:
    return rows.agg((F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + F.count("*")).alias("n")).first()["n"]


@dataclass
class Probes:
    """A slice's distinct keys, short, their hash ranges, their order by range and key, and where places find their levels."""

    keys: np.ndarray
    part: np.ndarray
    order: np.ndarray
    token: np.ndarray
    before: np.ndarray
    pair: np.ndarray


def probes_of(tokens: np.ndarray, before: np.ndarray, first: np.ndarray, ranges: int) -> Probes:
    single, which = np.unique(np.concatenate((np.array([_BEGIN]), tokens)), return_inverse=True)
    token = which[1:]
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[first[:-1]] = which[0]
    pairs, pair = np.unique(pair_keys(before, tokens), return_inverse=True)
    keys = np.concatenate((single ^ _SINGLE, pairs))
    part = (keys >> U64(64 - _bits(ranges))).astype(np.int32) if ranges > 1 else np.zeros(len(keys), np.int32)
    keys = short_keys(keys)
    order = np.lexsort((keys, part))
    return Probes(keys, part, order, token, context, pair + len(single))


def train(rows: DataFrame, text: str = "text", most_exact: int = MOST_EXACT) -> tuple[Model, DataFrame]:
    """The model, and a table (key, n) of all tokens whose exact counts it doesn't hold."""
    size = _size(rows, text)
    guess = size // 4 + 1
    ranges = 1 << _bits(max(1, -(-guess // RANGE_TOKENS)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pair = Tally(0, ranges), Tally(1, ranges)
        for batch in batches:
            for _, part in slices(batch, text):
                tokens, before, _ = sequences(words_of(part, SPACED, lower=True))
                yield from single.add(tokens)
                yield from pair.add(pair_keys(before, tokens))
        yield from single.flush()
        yield from pair.flush()

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for kind in (0, 1):
            own = pdf[pdf["kind"] == kind]
            found.append(_summed(np.concatenate([np.zeros(0, U64), *map(from_planes, own["keys"])]), np.frombuffer(b"".join(own["counts"]), "<u4")))
        (keys, counts), (pairs, pair_counts) = found
        every, count = np.concatenate((keys ^ _SINGLE, pairs)), np.concatenate((counts, pair_counts))
        block, _ = _filled(short_keys(every), count, max(1 << 10, -(-int(level_of(count).sum()) * BITS_AN_ENTRY // 8) * 8))
        levels = np.bincount(level_of(counts), minlength=LEVELS)[:LEVELS]
        context, which = np.unique(pairs & _LOW, return_inverse=True)
        mass = np.bincount(which, pair_counts / TYPICAL[level_of(pair_counts)], len(context))
        times = np.bincount(which, pair_counts, len(context)).astype("<i8")
        made = {"contexts": context.astype("<u4"), "mass": mass.astype("<f8"), "times": times, "keys": keys.astype("<u8"), "counts": counts.astype("<i8")}
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "block": [block.tobytes()], "tokens": [int(counts.sum())], "types": [len(keys)], "levels": [levels], **{k: [v.tobytes()] for k, v in made.items()}})

    # a token's key in the filter differs from its key here in low bits only, so both have one range
    counted = rows.select(text).mapInArrow(tally, "part int, kind int, keys binary, counts binary")
    schema = "part int, block binary, tokens long, types long, levels array<long>, contexts binary, mass binary, times binary, keys binary, counts binary"
    counted = counted.repartition(max(partitions(rows.sparkSession), ranges), "part")
    with scratch() as keep:
        whole = written(counted.groupBy("part").applyInPandas(gather, schema), "token-sums")
        backoff = _backoff(whole)
        table = keep(written(whole.drop("contexts", "mass", "times"), "token-counts"))
    tokens = types = 0
    levels = np.zeros(LEVELS, np.int64)
    for r in table.select("tokens", "types", "levels").toLocalIterator():
        tokens, types, levels = tokens + r["tokens"], types + r["types"], levels + np.array(r["levels"])
    above = np.cumsum(levels[::-1])[::-1]
    least = int(np.argmax(above <= most_exact))

    def cut(frequent: bool):
        def run(batches):
            for batch in batches:
                for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    keys, counts = np.frombuffer(k, "<i8"), np.frombuffer(c, "<i8")
                    on = (level_of(counts) >= least) == frequent
                    yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(counts[on])], ["key", "n"])

        return table.select("keys", "counts").mapInArrow(run, "key long, n long")

    exact = cut(True).toArrow()
    keys = exact.column("key").to_numpy().view(U64)
    order = np.argsort(keys)
    model = Model(table.select("part", "block"), ranges, size, tokens, types, keys[order], exact.column("n").to_numpy()[order], backoff)
    return model, cut(False)


def _filled(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """A block's bits, and the level from which it holds entries: the first."""
    level = level_of(counts)
    floor = 1
    block = np.zeros(bits, bool)
    for k in range(floor, int(level.max(initial=0)) + 1):
        own = keys[level >= k]
        for place in places(own, np.full(len(own), k), bits):
            block[place] = True
    return np.packbits(block, bitorder="little"), floor


def _backoff(table: DataFrame) -> np.ndarray:
    """For each level of the context, the sum of 1/count of all pairs there over their number."""

    def contexts(batches):
        for batch in batches:
            for c, m, t in zip(*(batch.column(x).to_pylist() for x in ("contexts", "mass", "times")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, "<u4").astype(np.int64)), pa.array(np.frombuffer(m, "<f8")), pa.array(np.frombuffer(t, "<i8"))], ["context", "mass", "times"])

    def singles(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array((np.frombuffer(k, "<u8") & _LOW).astype(np.int64)), pa.array(np.frombuffer(c, "<i8"))], ["context", "n"])

    mass = table.select("contexts", "mass", "times").mapInArrow(contexts, "context long, mass double, times long").groupBy("context").agg(F.sum("mass").alias("mass"), F.sum("times").alias("times"))
    own = table.select("keys", "counts").mapInArrow(singles, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    level = F.when(F.col("n") > 0, 1 + F.floor(F.log(F.col("n")) / F.lit(float(np.log(LOG_BASE))) + 1e-9)).otherwise(0)
    sums = mass.join(own, "context", "left").groupBy(level.alias("level")).agg(F.sum("mass").alias("mass"), F.sum("times").alias("n")).collect()
    out = np.ones(LEVELS)
    found = {r["level"]: np.clip((r["mass"] + 1) / (r["n"] + 1), 1e-3, 1) for r in sums}
    # the filter may read a level above the true one: a level without contexts has the share of the one below
    for k in range(LEVELS):
        out[k] = found.get(k, out[k - 1] if k > 1 else 1.0)
    return out


def score(docs: DataFrame, model: Model, rest: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts are one end. Tokens outside the model's exact counts are looked up in `rest`. Each
    row, repeated or not, gets its own text's score. Input columns named like an output give way to it.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    given = [c for c in beside(docs, made) if c != text]
    docs = docs.select(*[column(c).alias(f"c{k}") for k, c in enumerate(given)], column(text).alias("text"))
    names, text = docs.columns[:-1], "text"
    ranges, least = model.ranges, partitions(docs.sparkSession)
    size = _size(docs, text)
    # a range's probes go to so many cells that each stays as small as the range was in training
    cells = max(1, -(-size // max(1, model.size, ranges * RANGE_TOKENS)))
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, blocks=None))
    # by content, not by place: both uses deal every row alike
    sliced = docs.select(*names, text, F.pmod(F.xxhash64(*docs.columns), F.lit(size // SLICE_BYTES + 1)).alias("_slice"))
    parts = max(least, size // PART_BYTES)
    sliced = sliced.repartition(parts, "_slice")

    def ask(rows: pa.Table) -> pa.Table:
        at = rows.column("_slice")[0].as_py()
        probes = probes_of(*sequences(words_of(text_of(rows.column(text).combine_chunks()), SPACED, lower=True)), ranges)
        part = probes.part[probes.order]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        keys = [short_planes(x) for x in np.split(probes.keys[probes.order], cut[1:])]
        return pa.table({"cell": pa.array(part[cut].astype(np.int64) * cells + at % cells), "slice": pa.array([at] * len(cut), pa.int64()), "keys": pa.array(keys, pa.binary())})

    def answer(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"slice": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "levels": pa.array([], pa.binary())})
        keys = [from_short_planes(x) for x in asked.column("keys").to_pylist()]
        levels = np.zeros(sum(map(len, keys)), np.uint8)
        if block.num_rows:
            bits = np.frombuffer(block.column("block")[0].as_py(), np.uint8)
            levels = BloomCounts(bits[None, :], np.ones(1, np.int64)).levels(np.concatenate(keys)).astype(np.uint8)
        found = np.split(levels, np.cumsum([len(x) for x in keys])[:-1])
        return pa.table({"slice": asked.column("slice"), "cell": asked.column("cell"), "levels": pa.array([x.tobytes() for x in found], pa.binary())})

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        model = sent.value
        tokens, before, first = sequences(words_of(text_of(rows.column(text).combine_chunks()), SPACED, lower=True))
        probes = probes_of(tokens, before, first, ranges)
        levels = np.empty(len(probes.keys), np.int64)
        levels[probes.order] = np.frombuffer(b"".join(answers.sort_by("cell").column("levels").to_pylist()), np.uint8)
        scores = model.log10(levels[probes.token], levels[probes.before], levels[probes.pair])
        at = np.minimum(np.searchsorted(model.keys, tokens), max(len(model.keys) - 1, 0))
        held = model.keys[at] == tokens if len(model.keys) else np.zeros(len(tokens), bool)
        base = np.zeros(len(tokens))
        base[held] = np.log10((model.counts[at[held]] + 1) / (model.tokens + model.types + 1))
        other = np.concatenate(([0], np.cumsum(~held)))[first].astype(np.int32)
        made = [
            pa.array(np.diff(first)),
            pa.array(np.add.reduceat(held.astype(np.int64), first[:-1])),
            pa.array(np.add.reduceat(base, first[:-1])),
            pa.array(np.add.reduceat(scores, first[:-1])),
            pa.ListArray.from_arrays(other, pa.array(tokens[~held].view(np.int64))),
        ]
        return pa.Table.from_arrays([*(rows.column(c) for c in names), *made], [*names, "n_tokens", "_known", "_base", "score", "_other"])

    asked = sliced.groupBy("_slice").applyInArrow(ask, "cell long, slice long, keys binary").repartition(max(least, ranges * cells), "cell")
    blocks = model.blocks.select(F.explode(F.sequence(F.col("part").cast("long") * cells, F.col("part").cast("long") * cells + cells - 1)).alias("cell"), "block").repartition(max(least, ranges * cells), "cell")
    answers = asked.groupBy("cell").cogroup(blocks.groupBy("cell")).applyInArrow(answer, "slice long, cell long, levels binary")
    first = sliced.groupBy("_slice").cogroup(answers.withColumnRenamed("slice", "_slice").repartition(parts, "_slice").groupBy("_slice")).applyInArrow(finish, schema_of(docs, names, "n_tokens long, _known long, _base double, score double, _other array<long>"))
    first = written(first.withColumn("_row", F.monotonically_increasing_id()), "scores")
    other = first.select("_row", F.explode("_other").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("times"))
    found = other.join(rest, "key", "left").select("_row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    whole = model.tokens + model.types + 1
    more = found.groupBy("_row").agg(F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(whole)))).alias("_more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_seen"))
    out = first.join(more, "_row", "left")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, given, strict=True)], "n_tokens", (F.col("_known") + F.coalesce("_seen", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score")
