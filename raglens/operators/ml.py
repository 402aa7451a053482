"""The learned failure classifier: training, evaluation, prediction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raglens.functions.forests import Forest

LEAST_ROWS, TREES, DEPTH, HELD_OUT, STRATIFIED = 10, 200, 4, 0.2, 20


#: Hashes are cut into 2^12 slices; rows are ordered within a stratum's one slice only.
SLICE_BITS = 12


def quotas(training: DataFrame) -> DataFrame:
    """stratum, n, held: how many rows of each stratum are held out, a fifth of all together, rounded up.

    Strata are the labels; what rounding down leaves goes to the largest remainders, of equal ones to the first label.
    With fewer than STRATIFIED rows, or a label of one row, every label can't be on both sides: all are one stratum.
    """
    whole = Window.partitionBy()  # over a row a label
    labels = training.groupBy(F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("n"))
    apart = (F.min("n").over(whole) >= 2) & (F.sum("n").over(whole) >= STRATIFIED)
    strata = labels.select(F.when(apart, F.col("label")).alias("stratum"), "n").groupBy("stratum").agg(F.sum("n").alias("n"))
    share = round(1 / HELD_OUT)
    sized = strata.withColumn("all", F.sum("n").over(whole)).withColumn("want", F.expr(f"(all + {share - 1}) div {share}"))
    parts = sized.withColumns({"least": F.expr("n * want div all"), "rest": F.expr("n * want % all")})
    order = Window.orderBy(F.desc("rest"), "stratum")
    extra = F.row_number().over(order) <= F.col("want") - F.sum("least").over(whole)
    return parts.select("stratum", "n", (F.col("least") + extra.cast("int")).alias("held"))


def split(training: DataFrame) -> DataFrame:
    """training with held_out: quotas() of rows, by the order of a hash of run_id and query_id.

    Counts of slices of the hash say in which slice a stratum's quota ends; only that slice's hashes are ordered. The
    last hash of each quota is found at once, in one pass over training, and comes back as a row a stratum.
    """
    hashed, stratum = F.xxhash64("run_id", "query_id"), F.coalesce("label", F.lit(""))
    keys = training.select(stratum.alias("label"), hashed.alias("_hash"), F.shiftright(hashed, 64 - SLICE_BITS).alias("_slice")).persist(StorageLevel.DISK_ONLY)
    try:
        wanted = [tuple(r) for r in quotas(keys).collect()]  # a row a label
        apart = any(r[0] is not None for r in wanted)
        held = training.sparkSession.createDataFrame([(r[0] or "", r[2]) for r in wanted], "_stratum string, held long")
        own = keys.withColumn("_stratum", F.col("label") if apart else F.lit(""))
        cells = own.groupBy("_stratum", "_slice").agg(F.count("*").alias("n"))
        upto = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("_stratum").orderBy("_slice")))  # 2^SLICE_BITS rows a stratum
        ends = upto.join(held, "_stratum").where("upto >= held and upto - n < held").select("_stratum", "_slice", F.expr("held - upto + n").alias("take"))
        place = F.row_number().over(Window.partitionBy("_stratum").orderBy("_hash"))
        last = own.join(F.broadcast(ends), ["_stratum", "_slice"]).withColumn("_n", place).where("_n = take")
        cuts = [tuple(r) for r in last.select("_stratum", "_hash").collect()]  # a row a label
    finally:
        keys.unpersist()
    known = training.sparkSession.createDataFrame(cuts, "_stratum string, _cut long")
    out = training.withColumn("_stratum", stratum if apart else F.lit("")).join(F.broadcast(known), "_stratum", "left")  # rows stay where they are: strata are few and of unlike sizes
    return out.withColumn("held_out", F.coalesce(hashed <= F.col("_cut"), F.lit(False))).select(*training.columns, "held_out")


def prepared(training: DataFrame) -> DataFrame:
    """run_id, query_id, label, the f_ columns and held_out, for all that follows on one training set.

    The rows are computed once and stay on the executors' disks: the split, the fit and the judgement read them there.
    Spark frees them when nothing refers to them any more.
    """
    names = ["run_id", "query_id", "label", *(c for c in training.columns if c.startswith("f_"))]
    return split(training.select(*names).localCheckpoint(storageLevel=StorageLevel.DISK_ONLY))


def _parted(training: DataFrame) -> DataFrame:
    """training with held_out; what prepared() gave has it."""
    return training if "held_out" in training.columns else split(training)


def train_classifier(training: DataFrame, trees: int = TREES) -> PipelineModel:
    """A forest over the f_ columns; fewer than LEAST_ROWS rows are an error."""
    own = _parted(training).where("not held_out").persist()  # read by each pass of the fit
    if own.limit(LEAST_ROWS).count() < LEAST_ROWS:
        own.unpersist()
        raise ValueError(f"fewer than {LEAST_ROWS} training rows")
    names = sorted(c for c in training.columns if c.startswith("f_"))
    labels = StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(own)
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=trees, maxDepth=DEPTH, seed=7)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*labels.labels, "unknown"])
    model = Pipeline(stages=[labels, VectorAssembler(inputCols=names, outputCol="x"), forest, back]).fit(own)
    own.unpersist()
    return model


def predict(model: PipelineModel, rows: DataFrame, *also: str) -> DataFrame:
    """run_id, query_id and the columns `also` of rows, with label and its probability."""
    out = model.transform(rows)
    return out.withColumn("p", F.array_max(vector_to_array("probability"))).select("run_id", "query_id", *also, F.col("predicted").alias("label"), F.round("p", 6).alias("probability"))


def judged(model: PipelineModel, training: DataFrame) -> DataFrame:
    """The held-out rows with their label as truth, and predict()'s label and probability."""
    own = _parted(training).where("held_out")
    return predict(model, own.withColumn("truth", F.col("label")), "truth")


def accuracy(model: PipelineModel, training: DataFrame) -> DataFrame:
    """accuracy and rows of the held-out rows."""
    pairs = judged(model, training)
    return pairs.agg(F.round(F.avg((F.col("truth") == F.col("label")).cast("double")), 4).alias("accuracy"), F.count("*").alias("n"))


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """feature, importance: the forest's, from the highest on."""
    names, forest = model.stages[1].getInputCols(), model.stages[2]
    return spark.createDataFrame([(n, round(float(v), 9)) for n, v in zip(names, forest.featureImportances.toArray(), strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


#: Rows among which values change places.
PERMUTED = 1000
#: Tasks of the prediction for each core, so that blocks even out.
TASKS_A_CORE = 4


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows with _hash and _block: blocks of about `block` rows by a hash, in whose order a block's rows stand."""
    blocks = max(1, -(-rows.count() // block))
    hashed = F.xxhash64("run_id", "query_id", F.lit("permuted"))
    return rows.withColumns({"_hash": hashed, "_block": F.pmod(hashed, F.lit(blocks))})


def permuted(rows: DataFrame, names: list[str], repeats: int, block: int = PERMUTED) -> DataFrame:
    """rows for each feature and repetition, with the feature's values of other rows; once as they are, feature NULL.

    Rows are dealt to blocks of about `block` by a hash. Within a block in the hash's order, a row takes the value of
    the row some places on, a number of places that differs by repetition: nothing is ordered over all rows.
    """
    own = F.struct("_hash", "run_id", "query_id", "label", *names)
    dealt = _dealt(rows, block).groupBy("_block").agg(F.array_sort(F.collect_list(own)).alias("r"))
    size = F.size("r")

    def shifted(repeat):
        by = F.when(size > 1, 1 + F.pmod(F.xxhash64("_block", repeat), size - 1)).otherwise(0).cast("int")
        return F.transform("r", lambda x, i: F.struct(repeat.alias("repeat"), x.alias("own"), F.get("r", F.pmod(i + by, size)).alias("other")))

    each = dealt.select("r", "_block", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("k"))
    # few bytes become many rows to predict: as many tasks as there are cores, whatever the size of the blocks
    each = each.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, "_block", "k")
    pairs = each.select(F.inline(shifted(F.col("k"))))
    taken = lambda name: F.struct(F.lit(name).alias("feature"), *[F.col(f"{'other' if c == name else 'own'}.{c}").alias(c) for c in names])
    moved = pairs.select("repeat", "own.run_id", "own.query_id", "own.label", F.inline(F.array(*map(taken, names))))
    return moved.unionByName(rows.select(F.lit(0).alias("repeat"), "run_id", "query_id", "label", F.lit(None).cast("string").alias("feature"), *names))


def permutation_importances(model: PipelineModel, training: DataFrame, repeats: int = 5) -> DataFrame:
    """feature, importance, spread: how much accuracy on the held-out rows is lost, on average of the repetitions and
    as their standard deviation, where a feature's values change places. One job for all features and repetitions.

    The rows are those of permuted(), but they are never made: a block's rows come to the forest's tables as they are.
    """
    rows, names = _parted(training).where("held_out"), model.stages[1].getInputCols()
    forest, said = Forest(model.stages[2]), model.stages[3].getLabels()

    def counted(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("_hash", "run_id", "query_id")])
        columns = [block.column(c).to_numpy().astype(float) for c in names]
        for name, values in zip(names, columns, strict=True):
            if np.isnan(values).any():  # as Spark's assembler has it
                raise ValueError(f"{name} has no value in some row")
        n, shifts = len(block), [block.column(f"_by{k}")[0].as_py() for k in range(repeats)]
        labels = np.array([said.index(x) if x in said else -1 for x in block.column("label").to_pylist()])
        first, known = np.array([said.index(x) for x in said]), n - block.column("label").null_count
        right = [(f, k, (first[c] == labels).sum()) for f, k, c in forest.moved(columns, [1 + s % (n - 1) if n > 1 else 0 for s in shifts])]
        return pa.table({"feature": pa.array([None if f is None else names[f] for f, _, _ in right], pa.string()), "repeat": pa.array([k for _, k, _ in right], pa.int32()), "right": pa.array([int(r) for *_, r in right], pa.int64()), "n": pa.array([known] * len(right), pa.int64())})

    places = {f"_by{k}": F.xxhash64("_block", F.lit(k + 1)) for k in range(repeats)}
    dealt = _dealt(rows, PERMUTED).select("_block", "_hash", "run_id", "query_id", "label", *names, *[c.alias(n) for n, c in places.items()])
    # few bytes become many predictions: as many tasks as there are cores, whatever the size of the blocks
    spread = dealt.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, "_block")
    counts = spread.groupBy("_block").applyInArrow(counted, "feature string, repeat int, right long, n long")
    each = counts.groupBy("feature", "repeat").agg(F.try_divide(F.sum("right"), F.sum("n")).alias("accuracy"))
    whole = F.max(F.when(F.col("feature").isNull(), F.col("accuracy"))).over(Window.partitionBy())  # a row a feature and repetition
    lost = each.withColumn("lost", whole - F.col("accuracy")).where("feature is not null").groupBy("feature")
    return lost.agg(F.round(F.avg("lost"), 9).alias("importance"), F.round(F.stddev_pop("lost"), 9).alias("spread"))


def report(model: PipelineModel, training: DataFrame) -> DataFrame:
    """label, precision, recall, f1 and support on the held-out rows."""
    pairs = judged(model, training)
    counts = pairs.groupBy("truth", "label").agg(F.count("*").alias("n"))
    hit = counts.where("truth = label").select("truth", F.col("n").alias("hits"))
    support = counts.groupBy("truth").agg(F.sum("n").alias("support"))
    said = counts.groupBy("label").agg(F.sum("n").alias("said")).withColumnRenamed("label", "truth")
    joined = support.join(hit, "truth", "left").join(said, "truth", "left").na.fill(0)
    f1 = F.round(2 * F.col("hits") / (F.col("said") + F.col("support")), 4)
    return joined.select(F.col("truth").alias("label"), F.coalesce(F.round(F.try_divide("hits", "said"), 4), F.lit(0.0)).alias("precision"), F.round(F.col("hits") / F.col("support"), 4).alias("recall"), f1.alias("f1"), "support")


def reliability(model: PipelineModel, training: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, probability, share: the held-out rows by predicted probability, and how many of them are right."""
    pairs = judged(model, training)
    place = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    right = F.avg((F.col("truth") == F.col("label")).cast("double"))
    return pairs.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 4).alias("probability"), F.round(right, 4).alias("share"))
