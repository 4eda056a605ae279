"""What all retrievers share: which rows are searched, and the order of hits."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESERVED = frozenset({"language", "model", "entity_types", "exclude_ids", "q", "limit", "min_similarity", "query_vec"})


def merged_args(own: dict, extra: dict | None) -> dict:
    """Named arguments together; an empty name or one that is taken is an error."""
    out = dict(own)
    for k, v in (extra or {}).items():
        if not k.strip():
            raise ValueError("a named argument has an empty name")
        if k in out or k in RESERVED:
            raise ValueError(f"the named argument {k!r} is taken")
        out[k] = v
    return out


@dataclass(frozen=True)
class Scope:
    """The rows to search: a language, types (none: all), ids to leave out, and a trusted SQL condition.

    The condition refers to the rows by the alias that the operator documents
    (``sd`` documents, ``ev`` vectors); its ``:name`` or ``@name`` arguments are literals from
    ``args``. It is applied before the best hits are taken.
    """

    language: str
    entity_types: tuple[str, ...] = ()
    exclude_ids: tuple[str, ...] = ()
    condition: str = ""
    args: dict = field(default_factory=dict)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def condition(sql: str, args: dict) -> Column:
    """A SQL condition with its named arguments put in; string literals of the condition aren't touched."""
    args = merged_args({}, args)

    def put(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in args:
            raise ValueError(f"the condition needs the argument {m[1]!r}")
        return _literal(args[m[1]])

    return F.expr(re.sub(r"'(?:[^'\\]|\\.|'')*'|(?<![\w:@])[:@](\w+)", put, sql))


def scoped(rows: DataFrame, scope: Scope, alias: str) -> DataFrame:
    """The rows within the scope; plain comparisons, so they reach the Parquet scan."""
    if not scope.language:
        raise ValueError("language is required")
    out = rows.alias(alias).filter(F.col(f"{alias}.language") == scope.language)
    if scope.entity_types:
        out = out.filter(F.col(f"{alias}.entity_type").isin(*scope.entity_types))
    if scope.exclude_ids:
        out = out.filter(~F.col(f"{alias}.entity_id").isin(*scope.exclude_ids))
    if scope.condition.strip():
        out = out.filter(condition(scope.condition, scope.args))
    return out


HIT = ("entity_type", "entity_id", "language", "score")
#: Scores that agree to so many digits are tied: sums of floats depend on their order.
DIGITS = 9


def _order(hits: DataFrame, score: str) -> list[Column]:
    keys = ["entity_type", "entity_id", "language", *(["model"] if "model" in hits.columns else [])]
    return [F.round(F.col(score), DIGITS).desc_nulls_last(), *map(F.col, keys)]


def best(hits: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The ``limit`` hits of greatest score, ties by type, id, language and, where there is one, model: one partial top-k per task."""
    return hits.orderBy(*_order(hits, score)).limit(max(0, limit))


def ranked(hits: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``rank``, from 1. For lists that ``best`` has cut: they are small and lie in one partition."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*_order(hits, score))))


class Top:
    """The ``limit`` best rows of each of many queries, of rows that come batch by batch: at most some multiple of queries times ``limit`` is held.

    Scores tie at ``digits``, ties go by the keys. ``edge`` has, for every query, the score that a row must
    reach to be of use; a row below it can't be among the best.
    """

    def __init__(self, queries: int, limit: int, digits: int):
        self.limit, self.digits = max(0, limit), digits
        self.edge = np.full(queries, -np.inf)
        self.most = max(1 << 16, 2 * queries * self.limit)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Table]] = []
        self.n = 0

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.RecordBatch, at: np.ndarray) -> None:
        """Pairs of a query's number and the row ``at`` of ``keys``."""
        fit = np.round(score, self.digits) >= self.edge[query]
        query, score, at = query[fit], score[fit], at[fit]
        for a in range(0, len(query), self.most):
            b = slice(a, a + self.most)
            self.held.append((query[b], score[b], pa.Table.from_batches([keys.take(pa.array(at[b]))])))
            self.n += len(query[b])
            if self.n > 2 * self.most:
                self._cut()

    def _cut(self) -> None:
        query, score = (np.concatenate([x[k] for x in self.held]) for k in (0, 1))
        keys = pa.concat_tables([x[2] for x in self.held])
        tied = np.round(score, self.digits)
        order = np.lexsort((-tied, query))
        place = self._places(query[order])
        last = order[place == self.limit - 1]
        self.edge[query[last]] = tied[last]
        kept = np.sort(order[tied[order] >= self.edge[query[order]]])
        if len(kept) > self.most:  # more rows are equal than are wanted: only now their keys decide
            own = keys.take(pa.array(kept))
            by = pa.table([pa.array(query[kept]), pa.array(-tied[kept]), *own.columns], ["_q", "_s", *own.column_names])
            order = kept[pc.sort_indices(by, sort_keys=[(c, "ascending") for c in by.column_names]).to_numpy()]
            kept = np.sort(order[self._places(query[order]) < self.limit])
        self.held = [(query[kept], score[kept], keys.take(pa.array(kept)).combine_chunks())]
        self.n = len(kept)

    @staticmethod
    def _places(query: np.ndarray) -> np.ndarray:
        """From 0, the place of each row among those of its query, which stand together."""
        head = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        return np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Table] | None:
        """Numbers of queries, scores and keys; of rows that are equal to a query's last, more than ``limit`` may be left."""
        if self.held:
            self._cut()
        return self.held[0] if self.n else None


def small_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``df``, in whose session an Arrow batch has ``size`` bytes at most from now on: workers hold a few batches, each beside its results."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df
