"""Streaming twins of the batch operators, with the same column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from raglens.functions.scalars import is_blank, is_ok
from raglens.operators.chunking import chunk_fixed
from raglens.operators.diagnosis import diagnose


def run_health(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """For each run (`by`) and window: queries, errors, cost and latency of the answers; batch and stream alike.

    events: ts, status, cost_usd, latency_ms and the columns of `by`.
    """
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if own.isStreaming else own
    ok, keys = is_ok(), by or []
    agg = own.groupBy(*keys, F.window("ts", window, slide or window)).agg(F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.round(F.sum(F.when(ok, F.col("cost_usd"))), 9).alias("cost_usd"), F.round(F.avg(F.when(ok, F.col("latency_ms"))), 9).alias("latency_ms"))
    return agg.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "errors", "cost_usd", "latency_ms")


def run_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end, events."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if own.isStreaming else own
    agg = own.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


BUCKETS = 64


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def stream_ingest(documents: DataFrame, store: str, checkpoint: str):
    """New documents to chunks: batch n writes the folder `gen`=2n and nothing else, however large the store is.

    A repeated batch writes its folder anew. A document without chunks is a row without start_index, which hides its
    older chunks; rows without doc_id are left out. current_chunks() reads the store, compact_chunks() keeps that cheap.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        docs = batch.where("doc_id is not null").dropDuplicates(["doc_id"])
        empty = docs.where(is_blank("text")).select("doc_id")
        chunk_fixed(docs).unionByName(empty, allowMissingColumns=True).write.mode("overwrite").parquet(f"{store}/gen={2 * batch_id}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def _generations(spark: SparkSession, store: str) -> list[int]:
    """The numbers of the store's whole folders, ascending; one without its mark is still being written."""
    target, files = _path(spark, store)
    if not files.exists(target):
        raise FileNotFoundError(store)
    found = [f.getPath().getName() for f in files.listStatus(target)]
    return sorted(int(name[4:]) for name in found if name.startswith("gen=") and _exists(spark, f"{store}/{name}/_SUCCESS"))


def current_chunks(spark: SparkSession, store: str) -> DataFrame:
    """Each document's chunks as its last batch wrote them. A compacted generation holds each document once, so only the
    documents written since meet: they replace its rows, and a store with none since is read as it stands."""
    whole = _generations(spark, store)
    base = max((g for g in whole if g % 2), default=-1)
    later = [f"{store}/gen={g}" for g in whole if g > base]
    read = lambda *paths: spark.read.option("basePath", store).parquet(*paths)
    if not later:
        return read(f"{store}/gen={base}").drop("gen")
    rows = read(*later)
    last = rows.groupBy("doc_id").agg(F.max("gen").alias("gen"))
    found = rows.join(last, ["doc_id", "gen"], "left_semi")
    if base >= 0:
        found = read(f"{store}/gen={base}").join(last, "doc_id", "left_anti").unionByName(found)
    return found.where("start_index is not null").drop("gen")


def compact_chunks(spark: SparkSession, store: str) -> None:
    """Writes the current chunks as the odd generation after the last batch, then deletes what went into it.

    To be called between batches, by one caller at a time. Ended halfway it loses nothing: an unfinished generation
    isn't read, and older ones left over are hidden; the next call deletes them.
    """
    whole = _generations(spark, store)
    if whole and whole[-1] % 2 == 0:
        current_chunks(spark, store).write.mode("overwrite").parquet(f"{store}/gen={whole[-1] + 1}")
        whole.append(whole[-1] + 1)
    for g in whole[:-1]:
        _delete(spark, f"{store}/gen={g}")


def stream_evaluate(results: DataFrame, items: DataFrame, out: str, checkpoint: str):
    """New results to diagnoses in `out`, each (run_id, query_id) once, however much later it comes again.

    What `out` holds is the memory: a batch leaves out the keys that earlier batches have written, of which it
    reads the buckets of its own runs only; a repeated batch writes its rows anew. Items are read in each batch.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, ["run_id", "query_id"]
        new = batch.dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)))
        if _exists(spark, out):
            touched = F.broadcast(new.select("bucket").distinct())  # BUCKETS rows at most
            held = spark.read.schema("run_id string, query_id string, bucket long, batch long").parquet(out).where(F.col("batch") < batch_id)
            new = new.join(held.join(touched, "bucket", "left_semi").select(*key), key, "left_anti")
        found = diagnose(new, items).select(*key, "failure_category", "confidence")
        named = found.withColumns({"bucket": F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)), "batch": F.lit(batch_id).cast("long")})
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(out)

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def latest_runs(rows: DataFrame) -> DataFrame:
    """Each run's latest row by ts; of equal times any further state goes before an earlier one."""
    state = F.struct("ts", F.col("diagnosed_at").isNotNull(), F.col("evaluated_at").isNotNull(), "status", "evaluated_at", "diagnosed_at")
    return rows.groupBy("experiment_id", "run_id").agg(F.max(state).alias("r")).select("experiment_id", "run_id", "r.ts", "r.status", "r.evaluated_at", "r.diagnosed_at")


#: How an experiment's runs stand, as counts: open ones, done ones, and of these the evaluated and the diagnosed.
COUNTS = ["open", "done", "evaluated", "diagnosed"]


def next_status(open: int, done: int, evaluated: int, diagnosed: int) -> str | None:
    """experiment_status() of an experiment whose runs are counted."""
    if open:
        return None
    if not done:
        return "failed"
    return "done" if diagnosed == done else "diagnosing" if evaluated == done else "evaluating"


def _share(row: tuple | None) -> tuple[int, int, int, int]:
    """What a run's latest row (ts, diagnosed, evaluated, status) adds to the counts."""
    if row is None:
        return 0, 0, 0, 0
    done = row[3] == "done"
    return int(row[3] in ("pending", "running")), int(done), int(done and row[2]), int(done and row[1])


class LatestRows(StatefulProcessor):
    """A run's latest row is its state; gives the change of the counts where there is one, and for a new run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "ts double, diagnosed boolean, evaluated boolean, status string")

    def handleInputRows(self, key, rows, timerValues):
        old = new = tuple(self.row.get()) if self.row.exists() else None
        for frame in rows:
            own = zip(frame["ts"].fillna(-np.inf), frame["diagnosed"], frame["evaluated"], frame["status"].fillna(""), strict=True)
            best = max((float(ts), bool(diagnosed), bool(evaluated), status) for ts, diagnosed, evaluated, status in own)
            new = best if new is None else max(new, best)
        if new != old:
            self.row.update(new)
        change = [after - before for before, after in zip(_share(old), _share(new), strict=True)]
        if old is None or any(change):
            yield pd.DataFrame([[key[0], *change]], columns=["experiment_id", *COUNTS])


class Counted(StatefulProcessor):
    """An experiment's counts and the status emitted last are its state; gives its status where that is new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in COUNTS))
        self.emitted = handle.getValueState("emitted", "status string")

    def handleInputRows(self, key, rows, timerValues):
        known = self.counts.exists()
        held = list(self.counts.get()) if known else [0] * len(COUNTS)
        for frame in rows:
            held = [int(n) + int(m) for n, m in zip(held, frame[COUNTS].sum(), strict=True)]
        found = next_status(*held)
        self.counts.update(tuple(held))
        if not known or found != self.emitted.get()[0]:
            self.emitted.update((found,))
            yield pd.DataFrame({"experiment_id": [key[0]], "next_status": pd.Series([found], dtype=object)})


#: The state store that keyed states of several values need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_changes(run_events: DataFrame) -> DataFrame:
    """Run events to (experiment_id, next_status), a row whenever an experiment's state is new; each state is emitted once.

    Two keyed states of a few values each: a run's latest row (as latest_runs() picks it), and an experiment's counts
    of its runs. A batch loads the runs and experiments it has events of, and an experiment of any size is spread by
    its runs: to its own key go only the runs whose standing changes. Sets the session's state store to STATE_STORE,
    which a query takes when it first starts; earlier queries keep the one of their checkpoint.
    """
    run_events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = run_events.select(F.col("experiment_id").cast("string").alias("experiment_id"), F.col("run_id").cast("string").alias("run_id"), F.col("ts").cast("double").alias("ts"), F.col("diagnosed_at").isNotNull().alias("diagnosed"), F.col("evaluated_at").isNotNull().alias("evaluated"), "status")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    changes = rows.groupBy("experiment_id", "run_id").transformWithStateInPandas(LatestRows(), f"experiment_id string, {counts}", "Append", "None")
    return changes.groupBy("experiment_id").transformWithStateInPandas(Counted(), "experiment_id string, next_status string", "Append", "None")


def stream_experiment_status(run_events: DataFrame, out: str, checkpoint: str):
    """Run events (experiment_id, run_id, ts, status, evaluated_at, diagnosed_at) to changes of experiment states, a folder
    `out`/changes/batch=n a batch; a repeated batch writes its folder anew."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={batch_id}")

    return status_changes(run_events).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
