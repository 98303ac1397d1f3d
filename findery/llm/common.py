"""Shared plumbing: the folder that all executors see, written tables, clean-up."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all tasks run on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="findery-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """One folder below the shared root for an operator's written tables.

    Tables there cut lineage: a lost executor costs at most the stage that reads
    them, and every reader sees the same rows.  ``drop`` deletes tables that nothing
    reads any more, ``release`` the folder, once the operator's result has been
    written.  What is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_root(spark)}/findery-{uuid.uuid4().hex}"
        self.tables: dict[int, str] = {}
        where, fs = self._at(self.path)
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def sub(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.sub(f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that ``keep`` returned."""
        for df in kept:
            where, fs = self._at(self.tables.pop(id(df)))
            fs.delete(where, True)

    def release(self) -> None:
        where, fs = self._at(self.path)
        fs.delete(where, True)


_SHARED: list[weakref.ref] = []  # not held: what nothing uses any more, Spark cleans up itself


def share(spark: SparkSession, value):
    """Broadcast a value of bounded size to the tasks."""
    shared = spark.sparkContext.broadcast(value)
    _SHARED.append(weakref.ref(shared))
    return shared


def shared_so_far() -> int:
    return len(_SHARED)


def forget_shared(since: int) -> None:
    """Destroy what ``share`` has broadcast since there were so many; nothing that needs it may still have to run."""
    while len(_SHARED) > since:
        if (shared := _SHARED.pop()()) is not None:
            shared.destroy()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most so many rows at once from now on, as texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def id_crc(column: str = "doc_id"):
    """crc32 of an id written as decimal text; NULL ids give NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Bits of a sieve, 64 a row: at most 524,288 rows are broadcast.
SIEVE_BITS = 1 << 25


def sieve(df: DataFrame, keys: DataFrame, key: str, mark: str) -> DataFrame:
    """``df`` with the boolean column ``mark``: true wherever the row's ``key`` is among those of ``keys``, and for few other rows.

    So a join with ``keys``, which is still needed, can do without the rows that are not marked, and those need no shuffle.
    Only bits for hashes are broadcast, however many keys there are; the more keys a bit, the more rows are marked in vain.
    The column has the same type on both sides, and ``df`` no column named ``mark``.
    """
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    word, bit = F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")
    words = keys.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    joined = df.join(F.broadcast(words.select(F.struct("word", "bits").alias(mark))), word == F.col(mark)["word"], "left")
    return joined.withColumn(mark, F.coalesce(F.getbit(F.col(mark)["bits"], bit) == 1, F.lit(False)))


def sample_fraction(df: DataFrame, key: str, rows: int, at_most: int) -> DataFrame:
    """About ``at_most`` of the ``rows`` rows, the same ones on every run, chosen by a hash of ``key``."""
    if rows <= at_most:
        return df
    cut = int(at_most / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < cut)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and, unless one row is larger, about so many bytes.

    Once they end, the worker, which Spark keeps, gives its free memory back.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = -(-n // 2)
            yield batch.slice(at, n)
            at += n
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
