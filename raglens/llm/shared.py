"""Tables in the folder that driver and executors share, and order by ranges of a key."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOLDERS: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()
_SCOPES = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset and all runs on this machine, a folder of our own."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given:
        return given
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark not in _FOLDERS:
        _FOLDERS[spark] = "file://" + tempfile.mkdtemp(prefix="raglens-")
    return _FOLDERS[spark]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    Inside scratch() the table goes when that ends, else when the program does. Shuffle files that made
    it are deleted at once: what follows reads the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/raglens-{name}-{uuid.uuid4().hex}"
    cleanup = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleanup)
    scopes = getattr(_SCOPES, "held", [])
    (scopes[-1] if scopes else _KEPT).append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


_KEPT: list[tuple[SparkSession, str]] = []
#: Spark's setting to delete an execution's shuffle files once it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch() -> Iterator:
    """Drops the tables that are written inside it, but those handed to what it yields."""
    held: list[tuple[SparkSession, str]] = []
    if not hasattr(_SCOPES, "held"):
        _SCOPES.held = []
    _SCOPES.held.append(held)

    def keep(df: DataFrame) -> DataFrame:
        own = [x for x in held if x[1] == df._table]
        held[:] = [x for x in held if x[1] != df._table]
        (_SCOPES.held[-2] if len(_SCOPES.held) > 1 else _KEPT).extend(own)
        return df

    try:
        yield keep
    finally:
        _SCOPES.held.remove(held)
        for spark, path in held:
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_jsc", None) is None:
        return
    try:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone by now
        pass


@atexit.register
def _drop_kept() -> None:
    for spark, path in _KEPT:
        _drop(spark, path)


def beside(df: DataFrame, made: list[str]) -> list[str]:
    """The columns that stay beside new ones: one of the same name, in any case, gives way."""
    taken = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in taken]


def schema_of(df: DataFrame, names: list[str], made: str) -> T.StructType:
    """The columns of these names, then new ones given as text."""
    return T.StructType([*(T.StructField(n, df.schema[n].dataType) for n in names), *T.StructType.fromDDL(made).fields])


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many more underscores as no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def version(text: str) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(column(text), F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, n: int) -> list:
    """Up to n-1 ascending bounds that cut the rows into ranges of about equal size."""
    if n < 2:
        return []
    found = df.stat.approxQuantile(key, [i / n for i in range(1, n)], 1 / (8 * n))
    return sorted({int(x) for x in found})


def range_of(key: Column, bounds: list) -> Column:
    """The number of bounds that are not above the key; null keys come first, in range 0."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def search(at, step):
        return F.when((at + step <= len(bounds)) & (F.get(held, at + step - 1) <= key), at + step).otherwise(at)

    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search))
