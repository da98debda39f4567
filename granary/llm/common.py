"""Shared helpers: the shared folder, partition counts, and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names, or a folder of the warehouse where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints").rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's tables in the shared folder."""
    return f"{shared_dir(spark)}/granary/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Writes a frame as a table in the shared folder and reads it back, which cuts its lineage.

    The shuffles of the write are deleted when it ends, since nothing reads them after that.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_lock = threading.Lock()
_open: dict[int, tuple[int, str]] = {}  # by session: writes that are running, and what the setting was before the first


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete a query's shuffles when it ends, until the last of the session's writes has ended."""
    with _lock:
        n, before = _open.get(id(spark), (0, spark.conf.get(CLEANUP)))
        _open[id(spark)] = (n + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _open.pop(id(spark))
            if n > 1:
                _open[id(spark)] = (n - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and that nothing reads any more; other files stay."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(own_dir(table.sparkSession))
        system = top.getFileSystem(conf)
        whole = system.makeQualified(top)
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().equals(whole) or path.getParent().equals(top):
                system.delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(spark: SparkSession, size: int, most: int) -> int:
    """Shuffle partitions of the session, or more if ``size`` bytes would make them larger than ``most``."""
    return max(partitions(spark), -(-size // most))


def text_bytes(texts: DataFrame, text_col: str) -> int:
    """Bytes of a text column, null as the empty text: one scan that returns one number."""
    return int(texts.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that start as asked and that no column of ``docs`` has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task whose worker returns large freed blocks to the system at once, and the rest when the task ends."""

    def wrapped(batches: Batches) -> Batches:
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 4 << 20)  # blocks from this size on are mapped one by one, and unmapped when freed; smaller ones are used again
            libc.mallopt(-1, 16 << 20)
        except (OSError, AttributeError):  # another C library: memory is returned when it sees fit
            libc = None
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            gc.collect()
            if libc is not None:
                libc.malloc_trim(0)

    return wrapped


def kept_rows(docs: DataFrame, stay: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are in ``stay``, with the columns of ``docs`` whatever their names.

    ``stay`` has the names of ``keys`` and ``n_rows``, the number of rows that share them; of those
    one is returned. Texts are shuffled once, and a second time only if such rows exist.
    """
    names = list(keys)
    keyed = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])
    out = keyed.join(stay.filter("n_rows = 1").select(names), names, "left_semi").select("row")
    if not stay.filter("n_rows > 1").isEmpty():
        again = keyed.join(stay.filter("n_rows > 1").select(names), names, "left_semi").groupBy(names).agg(F.first("row").alias("row"))
        out = out.unionByName(again.select("row"))
    return out.select("row.*")
