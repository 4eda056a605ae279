"""The tables that search and its maintenance work on."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, TS, I = T.StringType(), T.TimestampType(), T.IntegerType()


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_STAMPS = {"created_at": TS, "updated_at": TS}
TABLES: dict[str, T.StructType] = {
    "search_documents": _table(entity_type=S, entity_id=S, language=S, document=S, raw_document=S, lexemes=T.ArrayType(S), **_STAMPS),
    "search_dirty": _table(entity_type=S, entity_id=S, language=S, is_deleted=T.BooleanType(), reason=S, **_STAMPS),
    "embedding_tasks": _table(entity_type=S, entity_id=S, model=S, language=S, reason=S, attempts=I, next_run_at=TS, started_at=TS, **_STAMPS),
    "embedding_vectors": _table(entity_type=S, entity_id=S, model=S, language=S, embedding=T.ArrayType(T.FloatType()), **_STAMPS),
    "embedding_models": _table(model=S, dims=I, modality=S),
    "embedding_vectors_backfill_state": _table(model=S, entity_type=S, language=S, cursor=S, state=S, last_error=S, updated_at=TS),
    "search_documents_backfill_state": _table(entity_type=S, language=S, cursor=S, state=S, last_error=S, updated_at=TS),
    "embedding_dead_letters": _table(entity_type=S, entity_id=S, model=S, language=S, reason=S, error=S, attempts=I, failed_at=TS, **_STAMPS),
}
KEYS: dict[str, tuple[str, ...]] = {
    "search_documents": ("entity_type", "entity_id", "language"),
    "search_dirty": ("entity_type", "entity_id", "language"),
    "embedding_tasks": ("entity_type", "entity_id", "model", "language"),
    "embedding_vectors": ("entity_type", "entity_id", "model", "language"),
    "embedding_models": ("model",),
    "embedding_vectors_backfill_state": ("model", "entity_type", "language"),
    "search_documents_backfill_state": ("entity_type", "language"),
    "embedding_dead_letters": ("entity_type", "entity_id", "model", "language"),
}
#: How the large tables lie on disk, so that a scan of one language reads its own files.
PARTITIONS: dict[str, tuple[str, ...]] = {"search_documents": ("language",), "embedding_vectors": ("model", "language")}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def identifier(name: str) -> str:
    """A trimmed name of letters, digits and underscores; anything else is an error."""
    name = name.strip()
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def index_suffix(model: str, dims: int) -> str:
    """The ending of the names of a model's indexes: 16 hexadecimal digits."""
    return hashlib.sha1(f"{model}:{dims}".encode()).hexdigest()[:16]
