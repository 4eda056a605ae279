"""Vectors in array columns: similarity, sign bits, norms and means.

Whole batches of vectors are matrices (``matrix``); between two columns of a row
the built-in higher-order functions do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double; null if the lengths differ."""
    a, b = _col(a), _col(b)
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _checked(value: Column, lengths: Column) -> Column:
    return F.when(lengths != 0, value / lengths)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector is null or zero, or the lengths differ."""
    return _checked(dot(a, b), norm(a) * norm(b))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """A list column whose rows all have ``dims`` numbers, in double; null numbers are NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def signs_between(packed: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many signs the packed rows differ."""
    return np.bitwise_count((packed ^ other).view(np.uint64)).sum(1)


def packed_signs(v: np.ndarray) -> np.ndarray:
    """Sign bits of the rows (1 where positive), 64 to a long, the first number lowest; the last long is filled up with zeros."""
    bits = np.packbits(v > 0, axis=1, bitorder="little")
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return np.ascontiguousarray(bits).view("<i8")


def with_signs(vectors: DataFrame) -> DataFrame:
    """``vectors`` with packed sign bits in ``signs``, to be stored: a scan of them reads a thirty-second of the vectors. Null vectors have null signs."""
    at = vectors.columns.index("embedding")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out: list = [None] * len(batch)
            for n in np.unique(sizes):
                rows = np.flatnonzero((sizes == n) & np.asarray(lists.is_valid()))
                packed = packed_signs(matrix(lists.take(pa.array(rows)), n)) if n else np.zeros((len(rows), 0), np.int64)
                for i, p in zip(rows, packed, strict=True):
                    out[i] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "signs"])

    return vectors.mapInArrow(run, f"{fields}, signs array<long>")


def signs_apart(signs: Column | str, query: Sequence[float]) -> Column:
    """In how many signs a vector with packed ``signs`` differs from a known one; a term for 64 numbers."""
    total = F.lit(0)
    for k, w in enumerate(packed_signs(np.asarray([query], np.float64))[0].tolist()):
        total = total + F.bit_count(F.get(_col(signs), F.lit(k)).bitwiseXOR(F.lit(w).cast("long")))
    return total


def hamming(a: Column | str, b: Column | str) -> Column:
    """In how many signs two vectors of one length differ."""
    differ = F.zip_with(_col(a), _col(b), lambda x, y: F.when((x > 0) != (y > 0), 1).otherwise(0))
    return F.when(F.size(_col(a)) == F.size(_col(b)), F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def unit(a: Column | str) -> Column:
    """The vector at length 1 as floats; zeros stay zeros."""
    a = _col(a)
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")).cast("float"))


def unit_of(values: Sequence[float]) -> list[float]:
    size = math.sqrt(sum(float(x) * float(x) for x in values))
    return [float(x) / size for x in values] if size > 0 else [float(x) for x in values]


def mean_unit_vectors(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """``keys`` and the mean of each group's vectors at length 1; null where there are none, they are empty or their lengths differ.

    Null vectors aren't counted. Sums combine before the shuffle: one row of
    numbers per key and place leaves a task.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(*keys, F.col(vector).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.min(F.size("_v")).alias("_least"), F.max(F.size("_v")).alias("_most"))
    means = rows.select(*keys, F.posexplode("_v").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    own = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_p")).withColumn("_u", unit(F.transform("_p", lambda p: p["_x"])))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return sizes.alias("s").join(own.alias("o"), same, "left").select(*[F.col(f"s.{k}") for k in keys], F.when((F.col("_least") == F.col("_most")) & (F.col("_most") > 0), F.col("_u")).alias(vector))
