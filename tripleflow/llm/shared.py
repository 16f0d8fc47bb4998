"""Helpers that the operators of this folder share: staged tables, text buffers, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
ARROW_BYTES = 8_000_000
FILTER_BITS = 1 << 27
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one of our own, but only in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tripleflow-"))
    return root.rstrip("/")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, its session set so that rows reach Python workers in batches of ARROW_BYTES at most, long texts or not."""
    conf = df.sparkSession.conf
    if int(conf.get(_ARROW).rstrip("b")) not in range(1, ARROW_BYTES + 1):
        conf.set(_ARROW, ARROW_BYTES)
    return df


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors.

    The shuffle files that the write has left are deleted at once: nothing reads them again.
    """
    spark = bounded(df).sparkSession
    path = f"{shared_root(spark)}/staged/{tag}-{uuid.uuid4().hex}"
    tidy = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, tidy)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete the files of tables that ``stage`` gave, once all that reads them has itself been written."""
    for df in staged:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id's decimal text, mod 4; remainder 2 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def utf8(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte data and n+1 offsets of a string column, nulls as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = array.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def among(keys: DataFrame, key: str, most: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test that is true of every value of the long column ``key`` of ``keys`` and false of most others.

    It keeps rows that can't match out of a join's shuffle. The bit set that is
    broadcast has at most ``most`` bits (16 MB), whatever the number of keys: with
    more keys it lets more rows through, so the join itself still has to decide.
    """
    n = keys.count()
    bits = min(most, 1 << max(16, (16 * n - 1).bit_length()))
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("set")).collect()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[[r["word"] for r in words]] = [r["set"] for r in words]
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def there(places: pa.Array) -> pa.Array:
        x = places.to_numpy()
        return pa.array((shared.value[x >> 6] >> (x & 63)) & 1 == 1)

    return lambda value: there(F.pmod(F.xxhash64(value), F.lit(bits)))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` of texts has at most ``most`` bytes, or one row."""
    for batch in batches:
        _, offs = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def trim() -> None:
    """Give memory that a Python worker has freed back to the machine: workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] numbers, then the same for the next start."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
