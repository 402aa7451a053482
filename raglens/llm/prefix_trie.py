"""Trie of conversation prefixes: Spark SQL ROLLUP over positional turn-id columns.

A conversation is a row for each block of WIDTH turns: the node before the block, then one turn-id column
a position. One ROLLUP over node and columns makes the nodes of all prefixes at once; a long conversation
goes on in further blocks, whose node column is the prefix before them. Prefixes are told apart by sums of
hashes of (position, turn id), 2 x 64 bits, which windows can sum for any length; turn ids are 128-bit
digests of role and text, and the text's length.

A node is owned by its smallest conversation. The nodes that one conversation owns are the tail of its
path, so the sum over a subtree is the sum over members of what each owns, less what the owner has above
the node: a second ROLLUP, no walk from level to level.

Conversations that hold many of the rows are numbered and summed in ranges, so no task sees one whole.
The digests of members that end in a node are taken in one pass over ascending ids, 4096 at a time.

Edge cases: rows without conv_id belong to no conversation and are left out; null role and text count as
empty; a null turn comes first; rows of one turn number follow each other by digest;
repeated rows stay, each a turn; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raglens.llm.shared import partitions, scratch, written
from raglens.llm.words import tidy

#: Turn-id columns of a block, and blocks (or nodes of one owner) of a range.
WIDTH, RANGE = 8, 512
#: Conversations of one digest piece: so many ids in a row at most.
PIECE = 4096


def running(rows: DataFrame, key: str, part: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with sums over all rows of the key that come before, by (part, order): within parts, then over parts.

    `order` is total within a part of a key, parts are ascending ranges of it.
    """
    names = list(values)
    before = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({n: F.coalesce(F.sum(v).over(before), F.lit(0)) for n, v in values.items()})
    over = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(key, part).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    parts = parts.select(key, part, *[F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in names])
    return own.join(parts, [key, part]).withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in names}).drop(*[f"_b_{n}" for n in names])


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_id of every turn; only digests are dealt out, not texts."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))).alias("turn_id"))
    order = ["conv_id", "turn", "turn_id"]
    ranged = turns.repartitionByRange(max(partitions(rows.sparkSession), 1), *order).sortWithinPartitions(*order)
    placed = ranged.select("conv_id", "turn_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    return running(written(placed, "turns"), "conv_id", "part", ["at"], {"pos": F.lit(1)}).select("conv_id", F.col("pos").cast("long").alias("pos"), "turn_id")


def _chars(turn_id: Column) -> Column:
    """The code points of a turn's text: the last four bytes of its id."""
    return F.conv(F.hex(F.substring(turn_id, 17, 4)), 16, 10).cast("long")


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns with the start that each conversation takes from the first of its hundred, and all conversations."""
    head = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(most))
    first = lambda c: F.col(c) - F.col(c) % group
    convs = turns.select("conv_id").distinct().withColumns({"donor": first("conv_id"), "h": head("conv_id")})
    given = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "donor")  # 5 turns a donor
    taken = convs.join(given, "donor").where("pos < h").select("conv_id", "pos", "turn_id")
    # what a donor lacks shifts the conversation's own turns to the left: one row a donor, joined only where a turn stands in reach
    lack = given.groupBy("donor").agg(F.count("*").alias("held"))
    shift = convs.join(lack, "donor", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("held", F.lit(0)))).alias("shift")).where("shift > 0")
    own = turns.where(F.col("pos") >= head("conv_id")).join(shift, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "turn_id")
    return taken.unionByName(own), convs.select("conv_id")


def _marks(pos: Column, turn_id: Column) -> list[Column]:
    """Two hashes of a turn at its place, as decimals, whose sums tell prefixes apart."""
    return [F.xxhash64(pos, turn_id).cast("decimal(38,0)"), F.xxhash64(turn_id, F.lit(7), pos).cast("decimal(38,0)")]


def blocks_of(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, block, x, y (the node before the block), its turns' ids, n of them, and sx, sy, what they add to x, y."""
    x, y = _marks(F.col("pos"), F.col("turn_id"))
    at = (F.col("pos") % width).cast("int")
    own = turns.withColumns({"block": F.floor(F.col("pos") / width), "x": x, "y": y})
    ids = [F.max(F.when(at == k, F.col("turn_id"))).alias(f"t{k}") for k in range(width)]
    made = own.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), *ids)
    # conversations without turns still are members of the root
    every = convs.withColumn("block", F.lit(0).cast("long")).join(made, ["conv_id", "block"], "full_outer").withColumns({c: F.coalesce(c, F.lit(0).cast("decimal(38,0)")) for c in ("sx", "sy")}).withColumn("n", F.coalesce("n", F.lit(0)))
    return running(every.withColumn("part", F.floor(F.col("block") / RANGE)), "conv_id", "part", ["block"], {"x": F.col("sx"), "y": F.col("sy")}).drop("part")


def _rollup(blocks: DataFrame, width: int, *sums: Column) -> DataFrame:
    """A row for each prefix that a block holds: node, t0.. (null after the level), level, sums."""
    ids = [f"t{k}" for k in range(width)]
    level = (F.lit(width) - F.bit_count(F.grouping_id())).alias("level")  # -1: the grand total
    rolled = blocks.withColumn("node", F.struct("block", "x", "y")).rollup("node", *ids).agg(level, *sums)
    # a column that is null at its own level belongs to a shorter conversation; level 0 counts for the root alone
    held = F.when(F.col("level") == 0, F.col("node.block") == 0).otherwise(F.get(F.array(*ids), F.col("level") - 1).isNotNull())
    return rolled.where((F.col("level") >= 0) & held)


def _named(rolled: DataFrame, width: int) -> DataFrame:
    """depth, x, y of each node, px, py of its parent, chars of its last text, in place of the columns."""
    zero = F.lit(0).cast("decimal(38,0)")
    out = {c: F.col(f"node.{c[-1]}") for c in ("x", "y", "px", "py")}
    for k in range(width):
        marks = _marks(F.col("node.block") * width + k, F.col(f"t{k}"))
        for c, mark in zip("xy", marks, strict=True):
            out[c] = out[c] + F.when(F.col("level") > k, mark).otherwise(zero)
            out["p" + c] = out["p" + c] + F.when(F.col("level") > k + 1, mark).otherwise(zero)
    ids = [f"t{k}" for k in range(width)]
    made = [(F.col("node.block") * width + F.col("level")).cast("long").alias("depth"), *[v.cast("decimal(38,0)").alias(c) for c, v in out.items()]]
    chars = F.when(F.col("level") > 0, _chars(F.get(F.array(*ids), F.col("level") - 1))).otherwise(0).alias("chars")
    return rolled.select(*made, chars, *[c for c in rolled.columns if c not in ("node", "level", *ids)])


ID = ["depth", "x", "y"]


def _ends(blocks: DataFrame, width: int) -> DataFrame:
    """Each node's digest of the conversations that end there: pieces of ids, then one pass over them in order."""
    last = F.max(F.struct((F.col("block") * width + F.col("n")).alias("depth"), (F.col("x") + F.col("sx")).cast("decimal(38,0)").alias("x"), (F.col("y") + F.col("sy")).cast("decimal(38,0)").alias("y")))
    ends = blocks.groupBy("conv_id").agg(last.alias("end")).select("end.*", "conv_id", F.floor(F.col("conv_id") / PIECE).alias("piece"))
    pieces = ends.groupBy(*ID, "piece").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    kinds = "depth long, x decimal(38,0), y decimal(38,0), ends_sha256 string"
    return pieces.repartition(*ID).sortWithinPartitions(*ID, "piece").mapInArrow(tidy(_digests), kinds)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of runs of rows of one node; what a run holds so far is one hash state."""
    held, digest = None, None
    for batch in batches:
        out = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*ID, "ids")), strict=True):
            if node == held:
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                out.append((*held, digest.hexdigest()))
            held, digest = node, hashlib.sha256(ids.encode())
        if out:
            yield _digest_rows(out)
    if held is not None:
        yield _digest_rows([(*held, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*ID, "ends_sha256"])


def trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the rebuilt conversations."""
    with scratch() as keep:
        turns, convs = rebuilt_turns(written(ordered_turns(conversations), "places"))
        blocks = written(blocks_of(turns, convs, width), "blocks")
        nodes = written(_named(_rollup(blocks, width, F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), width), "nodes")
        parent = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
        children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
        counted = nodes.join(children, ID, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        counted = counted.withColumns({"saves": (F.col("n_convs") - 1) * F.col("chars"), "leaf": (F.col("n_children") == 0).cast("long"), "part": F.floor(F.col("depth") / RANGE)})
        # what its owner owns above each node
        above = written(running(counted, "conv_id", "part", ["depth"], {"saved_above": F.col("saves"), "leaves_above": F.col("leaf"), "owned_above": F.lit(1)}), "above")
        owned = above.groupBy("conv_id").agg(F.sum("saves").alias("owned_saves"), F.sum("leaf").alias("owned_leaves"))
        sums = [F.sum(c).alias(c) for c in ("owned_saves", "owned_leaves")]
        totals = _named(_rollup(blocks.join(owned, "conv_id", "left"), width, *sums), width).select(*ID, "owned_saves", "owned_leaves")
        # the topmost node that a conversation owns has a parent of another's
        tops = above.where("owned_above = 0 and depth > 0").select(*parent, F.struct(*ID).alias("top"))
        parents = tops.join(above.select(*ID, "conv_id"), ID).select("top.*", F.col("conv_id").alias("parent"))
        found = above.join(totals, ID).join(_ends(blocks, width), ID, "left").join(parents, ID, "left")
        own = found.select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            (F.col("owned_leaves") - F.col("leaves_above")).cast("long").alias("n_leaves"),
            (F.col("owned_saves") - F.col("saved_above")).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        return keep(written(own, "trie"))
