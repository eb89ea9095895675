"""What the operators of this subpackage share: shared storage, size checks, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import PurePosixPath
from tempfile import gettempdir

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that an operator sends to all executors.
BROADCAST_LIMIT = 64 << 20
#: Folder of tests and other runs in one process, where spark.checkpoint.dir is unset.
_LOCAL_CHECKPOINTS = f"{gettempdir()}/tagloom-checkpoints"
_tables: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process may it be unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (at or _LOCAL_CHECKPOINTS).rstrip("/")


def materialize(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """Cut the lineage of df: write it as Parquet in the shared folder and read it again.

    The files outlive executors, so a lost executor costs only its running tasks. They go with the scratch() that they
    were written in, or when the driver exits. packed: for whole texts, half the disk for a little time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd" if packed else None)
    _tables[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], None]]:
    """Tables that materialize() writes inside are deleted at the end, but for those that were passed to what this gives."""
    before, kept = set(_tables), []
    try:
        yield kept.append
    finally:
        used = {PurePosixPath(f.replace("://", ":/", 1)).parent.name for df in kept for f in df.inputFiles()}
        for path in [p for p in _tables if p not in before and p.rpartition("/")[2] not in used]:
            _remove(_tables.pop(path), path)


@atexit.register
def _remove_all() -> None:
    for path, spark in _tables.items():
        _remove(spark, path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside sends at most so many rows to Python at once: for rows that hold large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that materialize() returned."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    total = 0
    for name in {str(PurePosixPath(f.replace("://", ":/", 1)).parent) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A table that materialize() returned, marked for broadcast if its files are small; else Spark shuffles it as usual."""
    return F.broadcast(df) if written_bytes(df) * 4 <= limit else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        return


def slim(df: DataFrame, *cols: str) -> DataFrame:
    """Only these columns, the rest (clashing names included) gone."""
    return df.select(*(F.col(f"`{c}`") for c in cols))


#: Rows that go to Python at once.
BATCH = 2000
#: Rows of a batch that become Python objects at once.
SLICE = 1000


def _give_back() -> None:
    """Return what a task has freed to the system: Python workers live on, and many of them share a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = SLICE) -> DataFrame:
    """mapInArrow, a few rows at a time; a task gives its memory back when it ends. Rows hold whole documents, so the session's batches are
    kept at BATCH rows from the first use on: larger ones stay in the buffers of executors."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(sliced(batches, rows))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """Apply f to every Arrow batch: map-side only, one batch in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return arrow(df, run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def blake64(data: bytes) -> int:
    """A stable signed 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A stable bijection of uint64 that scatters its bits (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def picked(texts: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, __hash) of the n different rows whose id's hash is smallest; __hash is one of the text."""
    rows = slim(texts, id_col, "__hash").distinct()
    return rows.orderBy(F.xxhash64(F.col(f"`{id_col}`").cast("string")), id_col, "__hash").limit(n)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n: the fold of a row. A null id is in fold -1, so never held out."""
    return F.coalesce(F.crc32(F.col(f"`{col}`").cast("string").cast("binary")) % F.lit(n), F.lit(-1)).cast("int")
