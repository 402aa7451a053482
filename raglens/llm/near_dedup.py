"""Near-duplicate documents by SetSketch registers.

Each document's set of distinct word shingles becomes `registers` truncated
minima: arrival times of a Poisson process per shingle, on an exponential scale
of base `base`. Registers of a union are the maxima of registers, and equal
registers grow likelier with the sets' overlap, so runs of registers serve as
band keys. Documents that share a band are candidates; a joint maximum
likelihood estimate over both register lists drops hopeless candidates, and the
full sets confirm each link.

Groups of any size are safe: documents with equal sets count as one before any
join; a band's documents meet its smallest document first, then others drawn for
each band; what still has a label of its own is compared in blocks with the
rest of its bands.

A document is a row: rows are told apart by doc_id and a hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.shared import column, scratch, version, written
from raglens.llm.words import LEAN_SLICE_BYTES, SPACED, U64, mix, powers, shingle_sets, slices, tidy, words_of

#: Registers of base 1.001 and rate 20 hold sets of 1 to 10**18 shingles in 16 bits.
REGISTERS, BASE, RATE, TOP = 128, 1.001, 20.0, 65535
ROWS_A_BAND = 4
#: Standard errors under the threshold up to which an estimate still goes to the exact check.
SLACK = 5.0
#: Open bands up to this size give their pairs to the exact check; larger ones go through stars, then cells.
SMALL, BLOCK, TOP_BLOCK = 16, 512, 1024
#: A block of a cell holds about so many shingles at most.
BLOCK_SHINGLES = 1 << 19
STAR_TURNS = 2


def set_sketches(shingles: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """uint16 registers, a row for each set. Each shingle's arrivals come at rate m, each at one random
    register, which makes each register's first arrival an independent exponential; a shingle stops once
    its next arrival is past all of its set's minima."""
    n = len(first) - 1
    sets = np.repeat(np.arange(n), np.diff(first))
    least = np.full((n, m), np.inf)
    flat = least.reshape(-1)
    state, time = mix(shingles), np.zeros(len(shingles))
    while len(state):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        time -= np.log(((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        register = (mix(state ^ U64(0x632BE59BD9B4E019)) % U64(m)).astype(np.int64)
        np.minimum.at(flat, sets * m + register, time)
        here = np.unique(sets)
        bound = np.zeros(n)
        bound[here] = least[here].max(1)
        on = time < bound[sets]
        state, time, sets = state[on], time[on], sets[on]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray, rows: int = ROWS_A_BAND) -> np.ndarray:
    """A 64-bit key for each band of `rows` registers; the band's number is part of it."""
    n, m = registers.shape
    parts = registers.reshape(n, m // rows, rows).astype(U64)
    keys = (parts * powers(0xC2B2AE3D27D4EB4F, rows)).sum(2, dtype=U64)
    return mix(keys + mix(np.arange(m // rows, dtype=U64) + U64(1)))


def joint_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """The Jaccard similarity that makes the register comparisons likeliest, given both sizes.

    Counts of registers above, below and equal have probabilities p(u-vJ), p(v-uJ) and the rest,
    with p(x) = -log_base(1 - x(base-1)/base); the likelihood is concave in J.
    """
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - up - down
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j):
        x, y = p(u - v * j), p(v - u * j)
        return up * np.log(x) + down * np.log(y) + same * np.log(np.clip(1 - x - y, 1e-12, 1))

    lo, hi, g = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(steps):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(x) > likelihood(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    return (lo + hi) / 2


def sketches(docs: DataFrame, size: int = 5, m: int = REGISTERS) -> DataFrame:
    """doc_id, version, n_shingles, two hashes of the whole set, registers (binary). docs: doc_id, version, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch, "text", LEAN_SLICE_BYTES):
                sets, first = shingle_sets(words_of(part, SPACED, lower=True), size)
                made = [np.diff(first), _sums(mix(sets), first).view(np.int64), _sums(mix(sets ^ U64(0x5851F42D4C957F2D)), first).view(np.int64)]
                registers = pa.array([r.tobytes() for r in set_sketches(sets, first, m)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("version"), *map(pa.array, made), registers], ["doc_id", "version", "n_shingles", "set_a", "set_b", "registers"])

    return docs.mapInArrow(tidy(run), "doc_id long, version long, n_shingles long, set_a long, set_b long, registers binary")


def bands_of(sets: DataFrame) -> DataFrame:
    """id, band: each set's band keys."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_registers(batch.column("registers"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))), pa.array(keys.reshape(-1))], ["id", "band"])

    return sets.select("id", "registers").mapInArrow(tidy(run), "id long, band long")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return total[first[1:]] - total[first[:-1]]


def shingle_table(docs: DataFrame, size: int = 5) -> DataFrame:
    """id and its distinct shingles as sorted longs. docs: id, text."""

    def run(batches):
        for batch in batches:
            for rows, part in slices(batch, "text", LEAN_SLICE_BYTES):
                sets, first = shingle_sets(words_of(part, SPACED, lower=True), size)
                values = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("id"), values], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, shingles array<long>")


def likely(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose joint estimate is not far under the threshold."""
    own = sketch.select("id", "n_shingles", "registers")
    both = pairs.join(own.toDF("a", "n_a", "r_a"), "a").join(own.toDF("b", "n_b", "r_b"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            r_a, r_b = (_registers(batch.column(c)) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = joint_estimate(r_a, r_b, n_a, n_b) >= floor_of(threshold, r_a.shape[1])
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(tidy(run), "a long, b long, n_a long, n_b long")


def floor_of(threshold: float, m: int) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / m) ** 0.5


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    x = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return x.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id and the smallest id that its links reach: least labels of neighbours, then of labels, until all stand."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    now = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(now.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        own = now.join(near, "a").select("a", F.least("label", "near").alias("next"), "label")
        jump = now.select(F.col("a").alias("next"), F.col("label").alias("far"))
        after = written(own.join(jump, "next").select("a", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")), f"{name}-{turn}")
        if after.where("moved").isEmpty():
            return after.select(F.col("a").alias("id"), F.col("label").alias("component"))
        now = after.select("a", "label")


def open_members(members: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """band, id, label, n: the members of bands that still have several labels, and the number of them."""
    labelled = members.join(labels, "id")
    spread = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"))
    return written(labelled.join(spread.where("x <> y").select("band", "n"), "band").select("band", "id", "label", "n"), name)


def star_pairs(opened: DataFrame, seed: int) -> DataFrame:
    """(a, b): each document of a larger open band with one document of another label, drawn anew for each band and seed."""
    rows = opened.where(f"n > {SMALL}").select("band", "id", "label")
    lead = rows.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", "band", F.lit(seed)).alias("order"), "id", "label")).alias("lead"))
    pairs = rows.join(lead, "band").where("label <> lead.label")
    return pairs.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()


def small_pairs(opened: DataFrame) -> DataFrame:
    """(a, b) with different labels in an open band of at most SMALL documents."""
    dealt = opened.where(f"n <= {SMALL}").select("band", "id", "label").repartition("band").sortWithinPartitions("band", "id")

    def run(batches):
        for table in whole_groups(batches, ["band"]):
            band, ids, label = (table.column(c).to_numpy() for c in ("band", "id", "label"))
            starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
            sizes = np.diff(np.append(starts, len(band)))
            for size in np.unique(sizes[sizes > 1]).tolist():
                x, y = np.triu_indices(size, 1)
                at = starts[sizes == size][:, None]
                x, y = (at + x).reshape(-1), (at + y).reshape(-1)
                on = label[x] != label[y]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[on]]), pa.array(ids[y[on]])], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def cell_links(opened: DataFrame, own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): what the stars have left of open bands with more than SMALL documents, compared in full.

    Only documents outside a band's most frequent label can bring links. They come in blocks, bounded by
    documents and by shingles; a block meets each block of that label, and each other block, in a cell of
    its own, where the full sets are compared at once. Of the links between two labels a cell returns one.
    """
    rows = opened.where(f"n > {SMALL}").drop("n").join(own.select("id", "n_shingles"), "id")
    counts = rows.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    most = counts.groupBy("band").agg(F.max(F.struct("n", "label", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    parts = lambda n, s, most: F.ceil(F.greatest(n / most, s / BLOCK_SHINGLES)).cast("int")
    rest = parts(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s"), BLOCK)
    most = most.select("band", F.col("top.label").alias("top"), rest.alias("rest"), parts(F.col("top.n"), F.col("top.s"), TOP_BLOCK).alias("tops"))
    held = rows.join(most, "band").withColumn("main", F.col("label") == F.col("top"))
    held = held.withColumn("block", F.pmod(F.xxhash64("id", "band"), F.when(F.col("main"), F.col("tops")).otherwise(F.col("rest"))).cast("int"))
    blocks = F.sequence(F.lit(0), F.col("rest") - 1)
    with_top = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda j: F.struct(F.col("block").alias("i"), (-1 - j).alias("j")))
    with_rest = F.transform(blocks, lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    of_top = F.transform(blocks, lambda k: F.struct(k.alias("i"), (-1 - F.col("block")).alias("j")))
    cells = F.when(F.col("main"), of_top).otherwise(F.concat(with_top, with_rest))
    dealt = held.select("band", "id", "label", F.explode(cells).alias("cell")).select("band", "cell.i", "cell.j", "id", "label")
    dealt = dealt.join(sets, "id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "id")

    def run(batches):
        for table in whole_groups(batches, ["band", "i", "j"]):
            keys = [table.column(c).to_numpy() for c in ("band", "i", "j")]
            new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
            starts = np.flatnonzero(new).tolist()
            for s, e in zip(starts, [*starts[1:], len(new)], strict=True):
                a, b = _compared(table.slice(s, e - s), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _compared(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """One link for every two labels of the cell that have any; shared shingles are counted by a matrix product."""
    ids, label = cell.column("id").to_numpy(), cell.column("label").to_numpy()
    lists = cell.column("shingles").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    _, which, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    row, which = row[shared], (np.cumsum(times > 1) - 1)[which[shared]]
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    both, width = np.zeros((len(ids), len(ids)), np.float32), 4096
    for k in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        a, b = np.searchsorted(which, (k, k + width))
        has = np.zeros((len(ids), width), np.float32)
        has[row[a:b], which[a:b] - k] = 1
        both += has @ has.T
    union = sizes[:, None] + sizes[None, :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (label[:, None] < label[None, :]))
    _, first = np.unique(np.stack([label[x], label[y]], 1), axis=0, return_index=True)
    x, y = ids[x[first]], ids[y[first]]
    return np.minimum(x, y), np.maximum(x, y)


def relabelled(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """id, label after the links have joined the labels of their ends."""
    ends = links.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").where("x <> y")
    found = components(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), name)
    joined = labels.join(found.toDF("label", "component"), "label", "left")
    return written(joined.select("id", F.coalesce("component", "label").alias("label")), f"{name}-labels")


def whole_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches again, cut so that no run of equal keys is split; a table may hold many runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last, strict=True):
            same &= batch.column(k).to_numpy() == v.as_py()
        cut = int(np.argmax(same))
        if cut == 0 and not (held and _differs(held[-1], batch, keys)):
            held.append(batch)
            continue
        if cut or held:
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _differs(before: pa.RecordBatch, after: pa.RecordBatch, keys: list[str]) -> bool:
    return any(before.column(k)[before.num_rows - 1] != after.column(k)[0] for k in keys)


def near_groups(docs: DataFrame, percent: int = 75, size: int = 5, text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, version (of its text), n_shingles, component_id, first.

    component_id is the smallest doc_id that links reach; first marks the rows of the smallest (doc_id,
    version) of their component, of which equal rows are all marked. The rest as in near_duplicates.
    """
    rows = docs.select("doc_id", version(text).alias("version"), column(text).alias("text"))
    with scratch() as keep:
        sketch = written(sketches(rows, size), "sketches")
        known = sketch.where("doc_id is not null and n_shingles > 0")
        kinds = known.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "version")).alias("least"), F.first("registers").alias("registers"))
        equal = written(kinds.withColumn("id", F.monotonically_increasing_id()), "equal-sets")
        found = linked(rows, equal, percent, size, known.groupBy("doc_id", "version").count().where("count > 1").isEmpty())
        classes = equal.select("set_a", "set_b", "n_shingles", "id", "least").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).drop("id")
        least = classes.groupBy("component").agg(F.min("least").alias("chosen"))
        classes = classes.join(least, "component").select("set_a", "set_b", "n_shingles", "chosen")
        own = sketch.drop("registers").where("doc_id is not null").join(classes, ["set_a", "set_b", "n_shingles"], "left")
        own = own.select("doc_id", "version", "n_shingles", F.coalesce("chosen.doc_id", "doc_id").alias("component_id"), F.coalesce(F.col("chosen") == F.struct("doc_id", "version"), F.lit(True)).alias("first"))
        lone = sketch.where("doc_id is null").select("doc_id", "version", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
        return keep(written(own.union(lone), "near-groups"))


def linked(rows: DataFrame, equal: DataFrame, percent: int, size: int, once: bool) -> DataFrame:
    """id, component (the smallest id that links reach) of the different sets that have any link. once: no row is repeated."""
    bands = bands_of(equal)
    shared = bands.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = written(bands.join(shared.select("band", "lead"), "band"), "band-members")

    in_bands = members.select("id").distinct()
    own = written(equal.join(in_bands, "id", "left_semi").select("id", "n_shingles", "registers", "least.*"), "band-sketches")
    sets = shingle_table(rows.join(own.select("id", "doc_id", "version"), ["doc_id", "version"]), size)
    sets = written(sets if once else sets.dropDuplicates(["id"]), "shingle-sets")

    def checked(pairs: DataFrame) -> DataFrame:
        fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        return confirmed(likely(pairs, own, percent / 100).where(fits), sets, percent)

    links = written(checked(members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()), "links-0")
    label = links.groupBy("b").agg(F.min("a").alias("label")).withColumnRenamed("b", "id")
    labels = written(own.select("id").join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label")), "labels")
    placed = members.select("band", "id")
    opened = open_members(placed, labels, "open-0")
    for turn in range(1, STAR_TURNS + 1):
        if opened.where(f"n > {SMALL}").isEmpty():
            break
        more = written(checked(star_pairs(opened, turn).join(links, ["a", "b"], "left_anti")), f"links-{turn}")
        labels, links = relabelled(labels, more, f"turn-{turn}"), links.union(more)
        opened = open_members(placed, labels, f"open-{turn}")
    links = links.union(checked(small_pairs(opened).join(links, ["a", "b"], "left_anti"))).union(cell_links(opened, own, sets, percent))
    return components(links, "near")


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Two documents are linked if 100 * shared >= percent * all of their distinct `size`-word shingles.
    Null and empty texts have no shingles and no links; texts of fewer words are one shingle; equal
    sets are linked; a repeated doc_id has each of its rows in the result, with its own text's links;
    rows without doc_id have no component and are kept. Shingles are 64-bit hashes, equal sets equal
    128-bit sums of them. Other columns are left out.
    """
    groups = near_groups(docs, percent, size)
    return groups.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
