"""Shared helpers of the training-data operators.

Conventions that every operator in this subpackage keeps:

* Input columns whose names clash with a column the operator adds are renamed
  to ``input_<name>`` (more underscores until unique); nothing is dropped.
* State that must survive lost executors goes through ``DataFrame.checkpoint``
  into the folder that ``spark.checkpoint.dir`` names (``settle``). Spark drops
  checkpoints that nothing refers to where
  ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step handles at a time.
SLICE_BYTES = 1 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Where none is named, a run inside one process gets a temporary one; a cluster must name it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievelight-"))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch: texts are long, and a batch is held by Spark and by Python.
BATCH_ROWS = 1000


def mapped(df: DataFrame, function, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows, which is set on the session if it allows more."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(partial(_released, function=function), schema)


def _released(batches: Iterator[pa.RecordBatch], function) -> Iterator[pa.RecordBatch]:
    """What ``function`` yields; then the worker, which Spark keeps for other tasks, gives free memory back to the system."""
    yield from function(batches)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of keys up to which a side is broadcast.
BROADCAST_KEYS = 500_000


def split_by(docs: DataFrame, key: str, keys: DataFrame, kept: str) -> DataFrame:
    """Rows of ``docs`` whose key is (``left_semi``) or isn't (``left_anti``) among the one column of ``keys``.

    The keys are counted first: up to BROADCAST_KEYS they are broadcast, so
    that long texts needn't be shuffled; beyond that both sides are.
    """
    keys = settle(keys)
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), docs[key] == keys[keys.columns[0]], kept)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, wherever that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, own: list[str]) -> DataFrame:
    """Rename input columns that clash (case-insensitively) with ``own``."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in own}
    mine = {c.lower() for c in own}
    names = []
    for c in df.columns:
        if c.lower() in mine:
            new = f"input_{c}"
            while new.lower() in taken:
                new = f"input_{new}"
            taken.add(new.lower())
            names.append(new)
        else:
            names.append(c)
    return df.toDF(*names)


def given_back(done: DataFrame, df: DataFrame, own: list[str]) -> DataFrame:
    """The columns of ``df`` in ``done``, under their own names where ``free_names`` has renamed them."""
    return done.select(*(F.col(new).alias(old) for old, new in zip(df.columns, free_names(df, own).columns, strict=True)))


def plus(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def text_runs(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive runs of about ``most`` bytes; a larger row is a run alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd bases of two polynomial hashes modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def piece_hash(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int, solid: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each piece of ``data``: of its bytes by their place in it, and of its length.

    A piece ends where the next one starts; with ``solid``, bytes outside it don't count.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = BASES[which]
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))[data[starts[0] :]]
    if solid is not None:
        values[~solid[starts[0] :]] = 0
    begins = starts - starts[0]
    place = np.arange(len(values), dtype=np.int32) - np.repeat(begins.astype(np.int32), np.diff(np.append(begins, len(values))))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), base, np.uint64)]))
    values *= powers[place]
    return mix64(np.add.reduceat(values, begins) + lengths.astype(np.uint64) * np.uint64(BASES[1 - which]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
