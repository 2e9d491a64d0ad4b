"""Helpers that the training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, read through Spark so that any store works."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only where the session names none (tests in local mode) is a temporary folder
    made and set as the context's checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


#: Tables stored since each open :func:`scratch` began, innermost last.
_OPEN: list[list[DataFrame]] = []


#: Removes the shuffle files of an execution when it ends.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Executions inside leave no shuffle files behind; the session's own setting comes back at the end."""
    old = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, old)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    The files are replicated by the store, so the loss of an executor costs nothing, and
    the shuffle files behind them are not needed any more.
    """
    path = f"{shared_dir(df.sparkSession)}/ledgerline/{label}-{uuid.uuid4().hex}"
    with _no_shuffle_left(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    if _OPEN:
        _OPEN[-1].append(made)
    return made


def forget(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`stored` that is not needed any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables stored inside at its end, but those that are handed to what it gives.

    Kept tables pass to the scratch around it, if there is one.
    """
    _OPEN.append([])
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for df in _OPEN.pop():
            if not any(df is k for k in kept):
                forget(df)
        if _OPEN:
            _OPEN[-1].extend(kept)


#: Bits of a bitmap of keys, and of each of its rows; it is what is broadcast (4 MB at most).
BITMAP, CHUNK = 1 << 25, 1 << 15


def bitmap(keys: DataFrame) -> DataFrame:
    """Bitmap (__chunk, __bits) of the hashes of one column of distinct keys, stored, for :func:`split`."""
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(BITMAP))
    chunks = keys.select(F.floor(at / CHUNK).alias("__chunk"), (at % CHUNK).alias("__bit")).repartition("__chunk")
    return stored(chunks.groupBy("__chunk").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "bitmap")


def split(df: DataFrame, key: Column, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key may be among those of a bitmap, and rows whose key is none of them.

    A join with few keys that gives the second part as it is shuffles the first part alone;
    a key that shares its bit with another one costs a shuffle and changes no result.
    """
    marked = df.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(BITMAP)))
    both = marked.join(F.broadcast(bits), F.floor(F.col("__at") / CHUNK) == F.col("__chunk"), "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__at") % CHUNK / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    hit = F.coalesce(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1, F.lit(False))
    return tuple(both.filter(which).drop("__at", "__chunk", "__bits") for which in (hit, ~hit))


def mapped(df: DataFrame, each: Callable, schema: str | StructType) -> DataFrame:
    """``df`` through a function over Arrow batches that are bounded in rows and in bytes.

    The session bounds the bytes of what it hands over (64 MB unless it is told otherwise);
    a function sees slices of that, so that texts of few megabytes are taken apart at once.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(part for batch in batches for part in _slices(batch))
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = BATCH_ROWS
    if batch.num_rows:
        rows = max(1, min(rows, int(BATCH_BYTES * batch.num_rows / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Return a worker's free memory to the system: workers are reused and stay beside later stages that need none of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries know it
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
