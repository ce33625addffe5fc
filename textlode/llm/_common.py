"""What the operators share: the folder for intermediate tables, whole-group ranks, text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of the contracts, as the inside of a regex class.
SPACE = r"\x20\x09-\x0D"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, as in tests, one of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="textlode-"))
    return "file://" + _own_folder[0]


def tidy(run: Callable) -> Callable:
    """A worker's function over batches, which gives freed memory back to the system when it is through: workers stay for later steps."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Actions inside pass at most ``rows`` rows at once to Python: batches of whole texts are the larger part of its memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the actions inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: no lineage, survives lost executors.

    What the writing shuffled is deleted with it: a write plans its own shuffles, which nothing reads again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textlode/{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` whose readers have been written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are over: its cleaner waits for the driver's garbage collection."""
    spark.sparkContext._jvm.System.gc()


def salts_for(rows: int, per_salt: int = 500_000) -> int:
    """Parts into which one key is dealt so that a part of a key that holds everything stays near ``per_salt`` rows."""
    return max(16, -(-rows // per_salt))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, salts: int) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``keys`` (not null), dealt over ``salts`` parts a key.

    A key's rows are hashed into parts, each part is ranked alone and starts
    where the parts before it end, so that a hot key is no single task.
    Rows that are equal in ``order`` are ranked in any order among themselves.
    """
    part = f"__part_{out}"
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n")).select(*keys, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    return dealt.withColumn(out, F.row_number().over(inside).cast("long") - 1).join(starts, [*keys, part]).withColumn(out, F.col(out) + F.col("__start")).drop(part, "__start")


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def blocks(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``limit`` at most; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
