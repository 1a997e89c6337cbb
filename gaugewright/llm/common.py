"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and U+0009 to U+000D. ``bytes.split()`` splits on exactly these.
WORD_BREAKS = " \t\n\r\x0b\x0c"
#: Largest model or dictionary, in bytes, that is sent to every executor; beyond it a shuffled way is taken.
BROADCAST_LIMIT = 48 << 20


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8 (lone surrogates pass through)."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_ascii(data: bytes) -> bytes:
    """A-Z in lower case; ``bytes.lower`` leaves every other byte alone."""
    return data.lower()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters where it is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_gaugewright_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    folder = tempfile.mkdtemp(prefix="gaugewright-")
    (path := Path(folder, "gaugewright_pkg.zip")).write_bytes(held.getvalue())
    sc.addPyFile(str(path))
    sc._gaugewright_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, on one machine only, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="gaugewright-checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _nodes(plan) -> Iterator[str]:
    """Class names of a physical plan's nodes."""
    yield plan.getClass().getSimpleName()
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew where a small table has too few partitions to use the cores; large tables stay as they are, and
    so does what already comes from a shuffle (its partitions are only known once it has run). Results of the operators do
    not depend on it, but for op8's division into sequences."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if any(re.search("Join|Aggregate|Window|Exchange|Repartition|Sort|Limit|Union", c) for c in _nodes(df._jdf.queryExecution().sparkPlan())):
        return df
    return df.repartition(n) if df.rdd.getNumPartitions() * 2 <= n else df


def fold(column: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(parts)


def released() -> None:
    """Give memory that a task has used back to the system: workers outlive their tasks, and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over a task's batches, which leaves the worker as slim as before."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            released()

    return run


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(tidy(f), schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


class Memo(dict):
    """A dictionary that forgets everything once it is full, so a worker's memory stays bounded."""

    def __init__(self, make: Callable, limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        made = self.make(key)
        if len(key) <= 64:  # very long keys are not kept
            self[key] = made
        return made


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer file; ``folder`` overrides the installed one."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
