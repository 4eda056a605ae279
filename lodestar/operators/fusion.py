"""Putting ranked lists together and thinning them out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import matrix

KEY = ("entity_type", "entity_id", "language", "model")


def fuse(lists: DataFrame, k: float = 60.0, weights: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion of rows (list_id from 0, rank from 1, entity_type, entity_id, language, model): the key and score, best first by ``score`` if ordered.

    A hit adds weight / (k + rank); k <= 0 is 60, a weight that is missing or
    not positive is 1, and a key that a list repeats adds twice. Key fields are
    trimmed; a null one is empty. ``by`` names further columns, such as a query
    id, within which lists are fused.
    """
    k = k if k > 0 else 60.0
    weight = F.lit(1.0)
    for i, w in enumerate(weights):
        weight = F.when(F.col("list_id") == i, F.lit(float(w) if w > 0 else 1.0)).otherwise(weight)
    keys = [F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in KEY]
    return lists.select(*by, *keys, (weight / (F.lit(float(k)) + F.col("rank"))).alias("_share")).groupBy(*by, *KEY).agg(F.sum("_share").alias("score"))


def union_lists(lists: Sequence[DataFrame]) -> DataFrame:
    """Ranked hits (entity_type, entity_id, language, rank) as one table with their list_id."""
    out = None
    for i, hits in enumerate(lists):
        own = hits.select(F.lit(i).alias("list_id"), "rank", "entity_type", "entity_id", "language", F.lit("").alias("model"))
        out = own if out is None else out.unionByName(own)
    return out


def best_of(lists: Sequence[DataFrame]) -> DataFrame:
    """The greatest score of each (entity_type, entity_id, language)."""
    out = None
    for hits in lists:
        own = hits.select("entity_type", "entity_id", "language", "score")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("entity_type", "entity_id", "language").agg(F.max("score").alias("score"))


def diversified(scores: Sequence[float], similarity: Callable[[int, int], float], k: int, weight: float) -> list[int]:
    """Maximal marginal relevance: places of the chosen hits, in the order in which they are chosen.

    The first hit is the first of the list. Then always the one of greatest
    ``weight`` * score - (1 - ``weight``) * (greatest similarity to a chosen one, 0 at least)
    follows, the earliest of those that are equal to twelve digits: sums of floats depend on their order. ``weight`` is kept within 0 and 1.
    """
    n, k, weight = len(scores), min(k, len(scores)), min(1.0, max(0.0, weight))
    if k <= 0:
        return []
    chosen, left, close = [0], list(range(1, n)), [0.0] * n
    while len(chosen) < k:
        top, at = -float("inf"), -1
        for i in left:
            close[i] = max(close[i], similarity(i, chosen[-1]))
            value = round(weight * scores[i] - (1 - weight) * close[i], 12)
            if value > top:
                top, at = value, i
        if at < 0:
            break
        chosen.append(at)
        left.remove(at)
    return chosen


def diversify(hits: DataFrame, k: int, weight: float, by: str = "query_id") -> DataFrame:
    """``diversified`` for every query of a table (``by``, rank, score, embedding, ...) at once, by cosine similarity: its columns and ``place`` from 1.

    A query's hits are a list that a retriever has cut, so a group is small; the
    groups are spread over the cluster. Null scores and vectors count as 0.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)

    def pick(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["rank"])).combine_chunks()
        vectors = group["embedding"].combine_chunks()
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        size = int(lengths.max(initial=0))
        m = np.zeros((len(group), size))
        if size:
            whole = np.flatnonzero(lengths == size)
            m[whole] = matrix(vectors.take(pa.array(whole)), size)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        m /= np.where(length > 0, length, 1)
        close = (m @ m.T).tolist()
        scores = group["score"].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
        chosen = diversified(np.where(np.isnan(scores), 0.0, scores).tolist(), lambda i, j: close[i][j], k, weight)
        return group.take(pa.array(chosen, pa.int64())).append_column("place", pa.array(range(1, len(chosen) + 1), pa.int64()))

    return hits.groupBy(by).applyInArrow(pick, f"{fields}, place long")


def partial_batches(values: Sequence, size: int) -> Iterator[Sequence]:
    """``values`` in runs of ``size``."""
    for i in range(0, len(values), size):
        yield values[i : i + size]
