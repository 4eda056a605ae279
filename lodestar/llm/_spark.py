"""What the operators share on the Spark side: Arrow batch sizes, shared files, picking rows."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import shared_dir

#: Rows in an Arrow batch. Texts reach a hundred kB, so the default of 10,000 would be a gigabyte.
ROWS = 1000
#: Bytes of one; a longer text is a batch of its own.
BYTES = 8 << 20


def over_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches that stay small on long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    # Else a union of equally partitioned inputs fails where adaptive execution coalesces one of them alone.
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again by later stages, beside each other."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column_at(df: DataFrame, name: str) -> int:
    """The place of a column, whose name Spark takes without case."""
    return [c.lower() for c in df.columns].index(name.lower())


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, place: str) -> None:
    """Deletes what an operator wrote for itself, on whichever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What runs inside frees its shuffles' files when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def text_key(text: str) -> tuple[Column, Column]:
    """128 bits that stand for a text; null for a null one. Of 10**12 texts two are the same by chance with a probability below 10**-14."""
    has = F.col(text).isNotNull()
    return F.when(has, F.xxhash64(text)), F.when(has, F.xxhash64(F.lit("second"), text))


def sampled(labels: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``labels``, those of the least hash of ``key``: the same at every run and layout."""
    return labels.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), *by_all(labels)).limit(most)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def by_all(df: DataFrame, *but: str) -> list[Column]:
    """The columns of ``df`` to order by, those that have an order."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in but and not f.dataType.simpleString().startswith("map") and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
