"""The documents and vectors tables as functions from one state to the next."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import lexemes as L
from lodestar.functions import text as T
from lodestar.sources import schemas

DOC_KEY = list(schemas.KEYS["search_documents"])
VECTOR_KEY = list(schemas.KEYS["embedding_vectors"])


def latest(rows: DataFrame, keys: Iterable[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    keys = list(keys)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c) == "")


def prepared(raw: DataFrame, config: str | None = None) -> DataFrame:
    """Host texts (entity_type, entity_id, language, text) as documents: folded text, trimmed text and lexemes.

    Without ``config`` every language has its own; rows of blank ids, types or
    languages go. A text without letters has an empty document. Documents are folded
    as queries are, whatever their script.
    """
    rows = raw.filter(~blank("entity_type") & ~blank("entity_id") & ~blank("language"))
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = rows.select(*DOC_KEY, text.alias("raw_document"), F.coalesce(T.fold_column(text), F.lit("")).alias("document"))
    return rows.withColumn("lexemes", L.lexemes_by_language("raw_document", "language") if config is None else L.lexemes("raw_document", config))


def _created(rows: DataFrame, keys: list[str], batch: DataFrame, bounded: bool) -> DataFrame:
    """When the rows of a batch's keys were created; with ``bounded`` the batch is small and the table isn't shuffled."""
    wanted = batch.select(*keys)
    return rows.select(*keys, F.col("created_at").alias("_created")).join(F.broadcast(wanted) if bounded else wanted, keys, "left_semi")


def document_changes(documents: DataFrame, batch: DataFrame, now: Column, bounded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to be put in, keys to be deleted) for a batch of ``prepared`` rows; ``bounded``: it is a page or the like.

    Keys keep their created_at; those whose document is empty are deleted. Of
    a key that the batch repeats the greatest text counts.
    """
    batch = latest(batch, DOC_KEY, F.col("document").desc(), F.col("raw_document").desc())
    fresh = batch.filter(F.col("document") != "").join(_created(documents, DOC_KEY, batch, bounded), DOC_KEY, "left")
    fresh = fresh.select(*DOC_KEY, "document", "raw_document", "lexemes", F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))
    return fresh, batch.filter(F.col("document") == "").select(*DOC_KEY)


def upsert_documents(documents: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The documents table after ``document_changes``."""
    fresh, _ = document_changes(documents, batch, now)
    return documents.join(batch.select(*DOC_KEY).distinct(), DOC_KEY, "left_anti").unionByName(fresh)


def delete_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of no key in ``keys``, by the columns that ``keys`` has."""
    return rows.join(keys.distinct(), keys.columns, "left_anti")


def delete_ids(rows: DataFrame, entity_type: str, language: str, ids: Iterable[str]) -> DataFrame:
    """The table without some ids of a type and language; without ids, or with a blank type or language, as it was."""
    ids = [i for i in ids if i and i.strip()]
    if not ids or not entity_type.strip() or not language.strip():
        return rows
    return rows.filter(~((F.col("entity_type") == entity_type) & (F.col("language") == language) & F.col("entity_id").isin(*ids)))


def vector_changes(vectors: DataFrame, batch: DataFrame, now: Column, bounded: bool = False) -> DataFrame:
    """The rows to be put in for a batch (key, embedding): keys keep their created_at, rows with a null vector are left out, an empty one is an error."""
    whole = F.when(F.size("embedding") == 0, F.raise_error(F.lit("a vector is empty"))).otherwise(F.col("embedding")).alias("embedding")
    batch = latest(batch.filter(F.col("embedding").isNotNull()).select(*VECTOR_KEY, whole), VECTOR_KEY, F.xxhash64("embedding"))
    old = _created(vectors, VECTOR_KEY, batch, bounded)
    return batch.join(old, VECTOR_KEY, "left").select(*VECTOR_KEY, "embedding", F.coalesce("_created", now).alias("created_at"), now.alias("updated_at"))


def upsert_vectors(vectors: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The vectors table after ``vector_changes``."""
    fresh = vector_changes(vectors, batch, now)
    return vectors.join(fresh.select(*VECTOR_KEY), VECTOR_KEY, "left_anti").unionByName(fresh)


def missing_embeddings(ids: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The rows of ``ids`` (entity_type, entity_id, language) that have no vector of the model; a row with a null vector counts as one.

    Repeated ids stay repeated, blank ones go.
    """
    own = vectors.filter(F.col("model") == model).select("entity_type", "entity_id", "language")
    return ids.filter(~blank("entity_id")).join(own, ["entity_type", "entity_id", "language"], "left_anti")


def upsert_models(models: DataFrame, active: list[tuple[str, int, str]]) -> DataFrame:
    """The models table with ``active`` (model, dims, modality) alone. A blank name, dims below 1 or another modality than text or vl is an error."""
    for name, dims, modality in active:
        if not name.strip() or dims <= 0 or modality not in ("text", "vl"):
            raise ValueError(f"not a model: {name!r}, {dims}, {modality!r}")
    if not active:
        return models
    spark = models.sparkSession
    return spark.createDataFrame([(name.strip(), dims, modality) for name, dims, modality in active], schemas.TABLES["embedding_models"]).dropDuplicates(["model"])


def of_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """The tasks, dead letters or states of models that are active; vectors of others are kept elsewhere. No active model: all rows stay."""
    any_model = models.limit(1).count() > 0
    return rows.join(F.broadcast(models.select("model")), "model", "left_semi") if any_model else rows  # a row per model
