"""Vector search: exact, in two stages, from a stored vector, and for whole tables of queries.

Vectors are rows (entity_type, entity_id, model, language, embedding).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators.common import DIGITS, Scope, Top, best, scoped, small_batches

COLUMNS = ("entity_type", "entity_id", "language", "model")
OVERSAMPLE = 5
EMPTY = pa.schema([*((n, pa.string()) for n in ("query_id", "entity_type", "entity_id", "language", "model")), ("score", pa.float64())])


def _rows(vectors: DataFrame, model: str, scope: Scope, dims: int) -> DataFrame:
    if not model:
        raise ValueError("model is required")
    rows = scoped(vectors, scope, "ev").filter((F.col("model") == model) & F.col("embedding").isNotNull())
    return rows.filter(F.size("embedding") == dims)


def _top(batch: pa.RecordBatch, values: np.ndarray, keep: int) -> np.ndarray:
    """The rows of the ``keep`` greatest values, ties by key, NaN last."""
    rounded = pa.array(np.round(np.where(np.isnan(values), -np.inf, values), DIGITS))
    table = pa.table([rounded, *(batch.column(k) for k in range(3))], ["_value", "a", "b", "c"])
    return pc.select_k_unstable(table, min(keep, len(batch)), [("_value", "descending"), ("a", "ascending"), ("b", "ascending"), ("c", "ascending")]).to_numpy()


def _slices(batch: pa.RecordBatch, dims: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose vectors are a megabyte in double."""
    step = max(1, (1 << 17) // max(1, dims))
    return (batch.slice(a, step) for a in range(0, len(batch), step))


def _cosines(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, v @ q / size, np.nan)


def nearest(rows: DataFrame, query: Sequence[float], keep: int) -> DataFrame:
    """Type, id, language, model and cosine similarity of at least the ``keep`` most similar rows: each batch is a matrix product of which its best rows leave the task.

    All embeddings have the query's length; a zero vector, on either side, has a null score.
    """
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(_cosines(V.matrix(x.column(4), len(q)), q) for x in _slices(batch, len(q)))])
            at = _top(batch, score, keep)
            picked = batch.select([0, 1, 2, 3]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(score[at], mask=np.isnan(score[at]))], [*COLUMNS, "score"])

    return small_batches(rows.select(*COLUMNS, F.col("embedding").cast("array<float>").alias("embedding"))).mapInArrow(run, "entity_type string, entity_id string, language string, model string, score double")


def nearest_by_signs(rows: DataFrame, query: Sequence[float], keep: int) -> DataFrame:
    """The rows (key and embedding) of the ``keep`` vectors whose signs differ least from the query's, ties by key.

    Where ``signs`` are stored the scan reads them alone, and the embeddings of what was found are joined to it;
    else the signs are taken from the vectors, batch by batch.
    """
    order = ["_apart", "entity_type", "entity_id", "language"]
    if "signs" in rows.columns:
        found = rows.select(*COLUMNS, V.signs_apart("signs", query).alias("_apart")).orderBy(*order).limit(keep).select(*COLUMNS)
        return rows.select(*COLUMNS, "embedding").join(F.broadcast(found), list(COLUMNS))  # ``keep`` rows
    own = V.packed_signs(np.asarray([query], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.concatenate([np.zeros(0), *(V.signs_between(V.packed_signs(V.matrix(x.column(4), len(query))), own) for x in _slices(batch, len(query)))])
            at = _top(batch, -apart, keep)
            picked = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(apart[at].astype(np.int64))], [*COLUMNS, "embedding", "_apart"])

    schema = "entity_type string, entity_id string, language string, model string, embedding array<float>, _apart long"
    near = small_batches(rows.select(*COLUMNS, F.col("embedding").cast("array<float>").alias("embedding"))).mapInArrow(run, schema)
    return near.orderBy(*order).limit(keep).drop("_apart")


def semantic_search(vectors: DataFrame, model: str, query: Sequence[float], scope: Scope, limit: int = 20, least: float = 0.0, two_stage: bool = False, oversample: int = OVERSAMPLE) -> DataFrame:
    """The vectors of greatest cosine similarity: entity_type, entity_id, language, model, score.

    In one stage ``least`` > 0 is applied to the hits that were found, so fewer
    than ``limit`` may be left. In two stages the ``limit`` * ``oversample`` (5 if it is 1 or less)
    vectors whose signs differ least are scored and ``least`` is always applied
    before the hits are taken. Vectors of another length aren't searched; a zero
    vector has a null score and comes last. An empty query finds nothing.
    """
    rows = _rows(vectors, model, scope, len(query))
    if not len(query) or limit <= 0:
        return rows.filter(F.lit(False)).select(*COLUMNS, F.lit(0.0).alias("score"))
    if not two_stage:
        found = best(nearest(rows, query, limit), limit)
        return found.filter(F.col("score") >= least) if least > 0 else found
    wide = limit * (oversample if oversample > 1 else OVERSAMPLE)
    return best(nearest(nearest_by_signs(rows, query, wide), query, wide).filter(F.col("score") >= least), limit)


def similar_to(vectors: DataFrame, entity_type: str, entity_id: str, model: str, scope: Scope, limit: int = 20, least: float = 0.0) -> DataFrame:
    """The vectors most similar to a stored one, which itself isn't among them; none if it isn't stored. The stored vector, one row, is fetched first."""
    own = (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)
    source = vectors.filter(own & (F.col("model") == model) & (F.col("language") == scope.language) & F.col("embedding").isNotNull()).select("embedding").first()
    rows = _rows(vectors, model, scope, len(source[0]) if source else 0).filter(~own)
    if source is None or not len(source[0]) or limit <= 0:
        return rows.filter(F.lit(False)).select(*COLUMNS, F.lit(0.0).alias("score"))
    found = best(nearest(rows, list(source[0]), limit), limit)
    return found.filter(F.col("score") >= least) if least > 0 else found


class _Block:
    """Queries of one length against vectors that come batch by batch: each query's best, in bounded memory.

    Products are made in single precision, whose error for vectors of length 1 is known; those that may be among the
    best are made again in double. With ``cells``, a query meets only the vectors of the cells in its row.
    """

    TILE, STEP = 1024, 2048

    def __init__(self, at: np.ndarray, q: np.ndarray, limit: int, least: float, cells: np.ndarray | None = None):
        self.at, self.q, self.low = at, q, q.astype(np.float32)
        self.least, self.cells = least, cells
        self.slack = (q.shape[1] + 8) * 2.0**-23
        self.top = Top(len(q), limit, 12)

    def add(self, keys: pa.RecordBatch, rows: np.ndarray, v: np.ndarray, cell: np.ndarray | None = None) -> None:
        """The rows ``rows`` of ``keys``, with their vectors."""
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            size = np.linalg.norm(v, axis=1)
            live = (size > 0) & np.isfinite(size)
            if self.cells is not None:
                live &= (cell >= 0) & self.cells.any(0)[cell]
            v, rows, cell = v[live] / size[live, None], rows[live], None if cell is None else cell[live]
        for b in range(0, len(v), self.STEP):
            part = v[b : b + self.STEP]
            low = part.astype(np.float32).T
            for a in range(0, len(self.q), self.TILE):
                s = self.low[a : a + self.TILE] @ low
                if self.cells is not None:
                    s[~self.cells[a : a + self.TILE][:, cell[b : b + self.STEP]]] = -np.inf
                edge = self.top.edge[a : a + self.TILE]
                limit = self.top.limit
                if s.shape[1] > limit and np.isinf(edge).any():
                    # The least that the limit-th best can be, from this batch alone.
                    edge = np.maximum(edge, np.partition(s, s.shape[1] - limit, axis=1)[:, s.shape[1] - limit].astype(np.float64) - 2 * self.slack)
                qi, vi = np.nonzero(s >= (np.maximum(edge, self.least) - 2 * self.slack).astype(np.float32)[:, None])
                for k in range(0, len(qi), 1 << 16):
                    x, y = qi[k : k + (1 << 16)] + a, vi[k : k + (1 << 16)]
                    exact = np.einsum("ij,ij->i", self.q[x], part[y])
                    fit = (exact >= self.least) & np.isfinite(exact) & np.isfinite(s[x - a, y])
                    self.top.add(x[fit], exact[fit], keys, rows[b + y[fit]])


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column by length, 0 and null left out: their numbers, and the numbers in them as a matrix."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        yield rows, V.matrix(column if len(rows) == len(column) else column.take(pa.array(rows)), n)


class _Blocks:
    """``_Block`` by length for a table of queries (query_id, embedding); takes batches of vectors (keys, embedding and, with ``cells``, cell)."""

    def __init__(self, ids: pa.Array, embedding: pa.Array, limit: int, least: float, cells: tuple[np.ndarray, int] | None):
        self.ids, self.by = ids, {}
        for rows, q in _lists(embedding):
            with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                size = np.linalg.norm(q, axis=1)
                live = (size > 0) & np.isfinite(size)
                q, own = q[live] / size[live, None], None
            if cells is not None:
                centres, probes = cells
                own = np.zeros((len(q), max(1, len(centres))), bool)
                if len(centres) and centres.shape[1] == q.shape[1]:
                    for a in range(0, len(q), 1024):
                        wanted = np.argsort(-(q[a : a + 1024] @ centres.T), axis=1, kind="stable")[:, :probes]
                        np.put_along_axis(own[a : a + 1024], wanted, True, axis=1)
            if len(q) and limit > 0:
                self.by[q.shape[1]] = _Block(rows[live], q, limit, least, own)

    def add(self, keys: pa.RecordBatch, embedding: pa.Array, cell: np.ndarray | None = None) -> None:
        for a in range(0, len(embedding), 8192):
            for rows, v in _lists(embedding.slice(a, 8192)):
                if v.shape[1] in self.by:
                    self.by[v.shape[1]].add(keys, rows + a, v, None if cell is None else cell[rows + a])

    def rows(self) -> Iterator[pa.RecordBatch]:
        for block in self.by.values():
            best = block.top.rows()
            if best is not None:
                at, score, keys = best
                yield from pa.table([self.ids.take(pa.array(block.at[at])), *keys.columns, pa.array(score)], EMPTY.names).to_batches(max_chunksize=10_000)


def search_all(vectors: DataFrame, queries: DataFrame, limit: int = 20, least: float = -1.0, block_bytes: int = 64 << 20, model: str = "", scope: Scope | None = None, cells: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """The ``limit`` best vectors of every query: query_id, rank, entity_type, entity_id, language, model, score.

    ``queries`` has query_id (a string or a number) and embedding. Queries of up to a sixteenth of ``block_bytes`` are broadcast, and
    each task holds its vectors against all of them. More are cut into blocks of up to a quarter of ``block_bytes``, vectors into blocks of up to four
    times as much; every pair of blocks is a partition of a shuffle, in which the vectors come past the queries batch by batch, so nothing passes the driver.
    Either way a task holds its queries, one batch and ``limit`` rows or so per query, and passes on no more. All pairs are
    computed: time grows with the product of both tables, the shuffle with that product over the size of a block.

    Null, empty and zero vectors match nothing. Ties go by type, id and language.
    ``model`` and ``scope`` narrow what is searched, as in ``semantic_search``. ``cells`` (centres, probes) has a
    query look only at vectors whose column ``cell`` is one of the ``probes`` nearest to it.
    """
    vectors = scoped(vectors, scope, "ev") if scope is not None else vectors
    vectors = vectors.filter(F.col("model") == model) if model else vectors
    asked = queries.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    cell = F.col("cell").cast("int") if cells is not None else F.lit(-1)
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(*COLUMNS, F.col("embedding").cast("array<float>").alias("embedding"), cell.alias("cell"))
    spark = rows.sparkSession
    small_batches(rows)
    amount = lambda df: 4 * (df.agg(F.sum(F.size("embedding"))).first()[0] or 0)
    size = amount(asked)
    shared_cells = spark.sparkContext.broadcast(cells)  # 4096 centres at most by default
    schema = "query_id string, entity_type string, entity_id string, language string, model string, score double"
    where = lambda batch: batch.column("cell").to_numpy() if shared_cells.value is not None else None
    if size <= block_bytes // 16:
        shared = spark.sparkContext.broadcast(asked.toArrow().combine_chunks())  # a sixteenth of ``block_bytes`` at most

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            blocks = _Blocks(q["query_id"].combine_chunks(), q["embedding"].combine_chunks(), limit, least, shared_cells.value)
            for batch in batches:
                blocks.add(batch.select([0, 1, 2, 3]), batch.column(4), where(batch))
            yield from blocks.rows()

        found = rows.mapInArrow(scan, schema)
    else:
        others = max(1, -(-amount(rows) // (4 * block_bytes)))
        n = asked.count()
        # Enough partitions for all cores, if blocks don't get too small by it.
        parts = max(-(-size // max(1, block_bytes // 4)), min(-(-n // 4096), -(-2 * spark.sparkContext.defaultParallelism // others)))
        each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        block = lambda count, *by: F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")
        none = F.lit(None).cast("string")
        left = asked.withColumn("_q", block(parts, "query_id")).withColumn("_v", each(others)).select("query_id", *(none.alias(c) for c in COLUMNS), "embedding", F.lit(-1).alias("cell"), "_q", "_v")
        right = rows.withColumn("_v", block(others, *COLUMNS)).withColumn("_q", each(parts)).select(none.alias("query_id"), *COLUMNS, "embedding", "cell", "_q", "_v")
        # Else a union of equally partitioned inputs fails where adaptive execution coalesces one of them alone.
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        pairs = left.unionByName(right).withColumn("_vector", F.col("query_id").isNull()).repartitionById(parts * others, F.col("_q") * others + F.col("_v")).sortWithinPartitions("_vector").drop("_q", "_v")

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, blocks = [], None
            for batch in batches:
                vector = batch.column("_vector").to_numpy(zero_copy_only=False)
                asks = int((~vector).sum())  # queries come first
                if asks:
                    first.append(batch.slice(0, asks))
                if asks < len(batch):
                    if blocks is None:
                        if not first:
                            return
                        own = pa.Table.from_batches(first).combine_chunks()
                        blocks = _Blocks(own["query_id"].combine_chunks(), own["embedding"].combine_chunks(), limit, least, shared_cells.value)
                        first = [batch.slice(0, 0)]
                    rest = batch.slice(asks)
                    blocks.add(rest.select(list(COLUMNS)), rest.column("embedding"), where(rest))
            if blocks is not None:
                yield from blocks.rows()

        found = pairs.mapInArrow(product, schema)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "entity_type", "entity_id", "language")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "rank", *COLUMNS, "score")
