"""Retrieval metrics, for one case and for whole tables of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at(got: Sequence, expected: Sequence, k: int) -> float:
    """Hits among the first k / number expected; 1 without expectations, 0 for k <= 0."""
    if not expected:
        return 1.0
    wanted = set(expected)
    return sum(x in wanted for x in got[: max(0, k)]) / len(expected)


def reciprocal_rank(got: Sequence, expected: Sequence) -> float:
    """1 / rank of the first hit, 0 without one, 1 without expectations."""
    if not expected:
        return 1.0
    wanted = set(expected)
    return next((1.0 / (i + 1) for i, x in enumerate(got) if x in wanted), 0.0)


def evaluate(got: DataFrame, expected: DataFrame, k: int, keys: Sequence[str] = ("entity_type", "entity_id")) -> DataFrame:
    """query_id, recall and reciprocal_rank of every query in ``got`` (query_id, rank, keys) or ``expected`` (query_id, keys).

    As ``recall_at`` and ``reciprocal_rank``: repeated expectations count in the
    denominator and repeated hits each time.
    """
    wanted = expected.select("query_id", *keys).distinct().withColumn("_hit", F.lit(True))
    sizes = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    marked = got.select("query_id", "rank", *keys).join(wanted, ["query_id", *keys], "left")
    hits = marked.groupBy("query_id").agg(F.count(F.when(F.col("_hit") & (F.col("rank") <= k), 1)).alias("_hits"), F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_first"))
    return _metrics(sizes.join(hits, "query_id", "full"))


def evaluate_groups(got: DataFrame, queries: DataFrame, items: DataFrame, k: int, group: str, keys: Sequence[str] = ("entity_type", "entity_id")) -> DataFrame:
    """``evaluate`` where a query (query_id, ``group``) expects all ``items`` (keys, ``group``) of its group.

    As if items and queries were joined by group, without their pairs: those would grow with the square of a group. Items are
    counted for each group, and a hit is held against its own group. A null group expects nothing.
    """
    items = items.select(*keys, F.col(group).alias("_group"))
    counts = items.filter(F.col("_group").isNotNull()).groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    asked = queries.select("query_id", F.col(group).alias("_group"))
    times = asked.filter(F.col("_group").isNotNull()).groupBy("query_id", "_group").agg(F.count(F.lit(1)).alias("_times"))
    sizes = times.join(counts, "_group").groupBy("query_id").agg(F.sum(F.col("_n") * F.col("_times")).alias("_n"))
    hits = got.select("query_id", "rank", *keys).join(items.distinct(), list(keys), "left").join(times.select("query_id", "_group", F.lit(True).alias("_hit")), ["query_id", "_group"], "left")
    hits = hits.groupBy("query_id", "rank").agg(F.max(F.coalesce("_hit", F.lit(False))).alias("_hit"))
    hits = hits.groupBy("query_id").agg(F.count(F.when(F.col("_hit") & (F.col("rank") <= k), 1)).alias("_hits"), F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_first"))
    return _metrics(sizes.join(hits, "query_id", "full"))


def _metrics(both: DataFrame) -> DataFrame:
    recall = F.when(F.col("_n").isNull(), F.lit(1.0)).otherwise(F.coalesce("_hits", F.lit(0)) / F.col("_n"))
    first = F.when(F.col("_n").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)))
    return both.select("query_id", recall.alias("recall"), first.alias("reciprocal_rank"))
