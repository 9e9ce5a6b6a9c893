"""Plumbing shared by the corpus operators: shared folders, step tables, packed arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_FILE = 500_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that ``spark.checkpoint.dir`` names.  Only where that is unset
    (tests, a single machine) a temporary folder is set instead; a cluster without
    the setting is refused, because a machine-local folder would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnlight-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended before; the folder's owner cleans up
        pass


def file_count(source: DataFrame) -> int:
    """Files for a table derived from ``source``: two for each split of its input, and at least four a core."""
    spark = source.sparkSession
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return min(max(4 * spark.sparkContext.defaultParallelism, 2 * -(-size // split)), 1 << 30)


class StepTables:
    """Tables written between the steps of one operator, in the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of one step,
    never a recomputation of all steps before it.  Shuffle files of a step are removed
    once its table is written.  The number of a table's files follows the operator's input,
    however many shuffle partitions there are.
    """

    def __init__(self, source: DataFrame, operator: str):
        self.spark = spark = source.sparkSession
        self.parts = file_count(source)
        self.root = f"{shared_dir(spark)}/tarnlight/{operator}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete_at_exit, spark, self.root)

    def write(self, df: DataFrame, rows: int | None = None) -> tuple[DataFrame, str]:
        """The written table and its path; ``rows``, where known about, keeps small tables in few files."""
        parts = self.parts if rows is None else min(self.parts, rows // ROWS_A_FILE + 1)
        path = f"{self.root}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.coalesce(parts).write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def drop(self, path: str) -> None:
        _delete(self.spark, path)


def width(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: what the session gives its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row.

    A one-element explode is a barrier: an alias in a projection would be copied by the
    optimizer into each of its uses, and computed again for every element of a lambda.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The cells of a string or binary Arrow column as bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, budget: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and, by the length of their byte cells, about ``budget`` bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= budget:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


# --- 64-bit mixing on arrays -------------------------------------------------

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair of 64-bit names; order counts."""
    with np.errstate(over="ignore"):
        x = left * _A + (right ^ (right >> _S)) * _B
        x ^= x >> _S
        x *= _C
        x ^= x >> np.uint64(29)
    return x
