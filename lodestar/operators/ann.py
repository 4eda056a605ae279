"""Approximate vector search: an inverted file of cells.

Centres are fitted by spherical k-means on a bounded sample; every vector, of
whatever rank, is filed under its nearest centre. The file is sorted by cell, so a search, which
looks into the cells nearest to the query, reads only those row groups, and scores what it
reads exactly. How many cells that takes for the wanted recall is measured on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators.common import Scope
from lodestar.operators.semantic import search_all, semantic_search


@dataclass(frozen=True)
class CellParams:
    """``sample`` bounds the vectors that the centres are fitted on; ``cells`` 0 is the square root of all vectors, 4096 at most; ``recall`` at ten is what ``checks`` vectors of the sample must reach."""

    cells: int = 0
    sample: int = 100_000
    rounds: int = 12
    recall: float = 0.95
    checks: int = 300
    seed: int = 5


@dataclass(frozen=True)
class Cells:
    """Centres, a row each, and in how many of the cells nearest to it a query has to look."""

    centres: np.ndarray
    probes: int


def fit_cells(vectors: DataFrame, params: CellParams = CellParams()) -> Cells:
    """Cells of the vectors (one model, one length), from the ``sample`` rows of least key hash. Null, empty and zero vectors aren't used; without any there is no centre."""
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    n = rows.count()
    got = rows.orderBy(F.xxhash64("entity_type", "entity_id", "language"), "entity_type", "entity_id", "language").limit(params.sample).select(F.col("embedding").cast("array<float>").alias("embedding")).toArrow()
    if not got.num_rows:
        return Cells(np.zeros((0, 0)), 0)
    v = V.matrix(got["embedding"].combine_chunks(), len(got["embedding"][0]))
    size = np.linalg.norm(v, axis=1)
    v = v[size > 0] / size[size > 0, None]
    k = min(params.cells or min(4096, max(1, round(n**0.5))), len(v))
    if not k:
        return Cells(np.zeros((0, v.shape[1])), 0)
    rng = np.random.default_rng(params.seed)
    centres = v[rng.choice(len(v), k, replace=False)]
    nearest_of = lambda: np.concatenate([(v[a : a + 8192] @ centres.T).argmax(1) for a in range(0, len(v), 8192)])
    for _ in range(params.rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_of(), v)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    own, needed = nearest_of(), []
    for q in v[rng.choice(len(v), min(params.checks, len(v)), replace=False)]:
        place = np.empty(k, np.int64)
        place[np.argsort(-(centres @ q), kind="stable")] = np.arange(k)
        needed += place[own[np.argsort(-(v @ q), kind="stable")[:10]]].tolist()
    return Cells(centres, int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(params.recall * len(needed))))]) + 1)


def filed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Every row of ``vectors`` with its ``cell``; a null, zero or odd-sized vector, which has no direction to compare, is in cell -1."""
    at = vectors.columns.index("embedding")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    shared = vectors.sparkSession.sparkContext.broadcast(cells.centres.astype(np.float32))  # 4096 rows at most by default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            lists = batch.column(at)
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(sizes == own.shape[1]) if len(own) else np.zeros(0, np.int64)
            cell = np.full(len(batch), -1, np.int32)
            if len(rows):
                v = V.matrix(lists.take(pa.array(rows)), own.shape[1])
                near = np.concatenate([(v[a : a + 1024] @ own.T).argmax(1) for a in range(0, len(v), 1024)])
                cell[rows] = np.where(np.abs(v).sum(1) > 0, near, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, f"{fields}, cell int")


def write_cells(vectors: DataFrame, cells: Cells, place: str) -> DataFrame:
    """Writes the filed vectors sorted by cell, so that the cells of a search are few row groups; large cells are spread over several files by id. Reads them back."""
    filed(vectors, cells).repartitionByRange("cell", "entity_id").sortWithinPartitions("cell").write.parquet(place)
    return vectors.sparkSession.read.parquet(place)


def cell_search(file: DataFrame, cells: Cells, model: str, query: Sequence[float], scope: Scope, limit: int = 20, least: float = 0.0) -> DataFrame:
    """``semantic_search`` in the cells nearest to the query; an empty query, or a file without centres, finds nothing."""
    q = np.asarray(query, np.float64)
    wanted = [] if not len(q) or not len(cells.centres) else np.argsort(-(cells.centres @ q), kind="stable")[: cells.probes].tolist()
    return semantic_search(file.filter(F.col("cell").isin(wanted)), model, query, scope, limit, least)


def cell_search_all(file: DataFrame, cells: Cells, model: str, queries: DataFrame, scope: Scope, limit: int = 20, least: float = -1.0) -> DataFrame:
    """``cell_search`` for every query of a table (query_id, embedding) in one pass over the file, each in the cells nearest to it; as ``semantic.search_all``."""
    return search_all(file, queries, limit, least, model=model, scope=scope, cells=(cells.centres, cells.probes))
